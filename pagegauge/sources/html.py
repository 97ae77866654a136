"""Read markup once per page into arrays that Spark expressions can work on.

`with_dom` adds two columns: `elements`, the page's elements in document order,
and `texts`, its text nodes in document order.  That is all Python does; what to
select, cut or join is decided by expressions over these arrays
(`pagegauge.operators.dom` and `extract`), row by row and without a shuffle.

An element's descendants are the elements pos+1..last, its text nodes are
texts[t0:t1], its inner markup is html[h0:h1] and its whole markup html[o0:o1].
`path` lists its ancestors from the root, `nth` its place among siblings of its tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

DOM_SCHEMA = (
    "elements array<struct<pos:int,last:int,tag:string,nth:int,t0:int,t1:int,o0:int,h0:int,h1:int,o1:int,"
    "path:array<int>,classes:array<string>,attrs:map<string,string>>>, texts array<string>"
)

# --- fixed values: element groups of the markup standard ----------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style iframe noembed noframes xmp".split())
PLAIN_TEXT = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav "
    "object ol p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
CLOSES_P = SPECIAL - frozenset(
    "body button caption dd dt head html li object select tbody td template tfoot th thead tr".split()
) | {"hr"}
SCOPE = frozenset("html table td th caption template object button".split())
# A start tag in the key set first closes an open element of the named kind, but
# looks for it no further than the stop set.
IMPLIED_END = {
    "li": ({"li"}, SPECIAL - {"address", "div", "p", "li"}),
    "dd": ({"dd", "dt"}, SPECIAL - {"address", "div", "p", "dd", "dt"}),
    "dt": ({"dd", "dt"}, SPECIAL - {"address", "div", "p", "dd", "dt"}),
    "option": ({"option"}, SPECIAL),
    "td": ({"td", "th"}, {"tr", "table", "html"}),
    "th": ({"td", "th"}, {"tr", "table", "html"}),
    "tr": ({"tr"}, {"table", "html"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table", "html"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table", "html"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table", "html"}),
}
MAX_DEPTH = 512

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        if value[:1] in ('"', "'") and value[-1:] == value[:1]:
            value = value[1:-1]
        found.setdefault(name.lower(), unescape(value))
    return found


class Page:
    """Elements and text nodes of one page, as parallel lists."""

    def __init__(self, html: str):
        self.tag, self.nth, self.last = [], [], []
        self.t0, self.t1, self.o0, self.h0, self.h1, self.o1 = [], [], [], [], [], []
        self.path, self.attrs, self.texts = [], [], []
        self._siblings: list[dict[str, int]] = []
        self._stack: list[int] = []
        self._in_body = False
        self._read(html)

    def _open(self, tag: str, attrs: dict, o0: int, h0: int, void: bool = False) -> None:
        pos = len(self.tag)
        self.path.append(list(self._stack))
        if self._stack:
            seen = self._siblings[self._stack[-1]]
            seen[tag] = seen.get(tag, 0) + 1
            self.nth.append(seen[tag])
        else:
            self.nth.append(1)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self._siblings.append({})
        for column, value in (
            (self.last, pos), (self.t0, len(self.texts)), (self.t1, len(self.texts)),
            (self.o0, o0), (self.h0, h0), (self.h1, h0), (self.o1, h0),
        ):
            column.append(value)
        if not void and len(self._stack) < MAX_DEPTH:
            self._stack.append(pos)

    def _close_to(self, depth: int, h1: int, o1: int) -> None:
        """Close open elements until `depth` are left; o1 is the end of the last one closed."""
        while len(self._stack) > depth:
            pos = self._stack.pop()
            self.last[pos], self.t1[pos] = len(self.tag) - 1, len(self.texts)
            self.h1[pos], self.o1[pos] = h1, o1 if len(self._stack) == depth else h1

    def _find_open(self, names, stops) -> int | None:
        for depth in range(len(self._stack) - 1, -1, -1):
            tag = self.tag[self._stack[depth]]
            if tag in names:
                return depth
            if tag in stops:
                return None
        return None

    def _body(self, at: int) -> None:
        if not self._in_body:
            self._close_to(1, at, at)
            self._open("body", {}, at, at)
            self._in_body = True

    def _start(self, tag: str, source: str, o0: int, h0: int) -> None:
        attrs = _attributes(source) if source.strip(" \t\r\n\f/") else {}
        if tag == "html" or (tag == "body" and self._in_body):
            target = self.attrs[0 if tag == "html" else self.tag.index("body")]
            for name, value in attrs.items():
                target.setdefault(name, value)
            return
        if tag in ("head", "body"):
            if tag == "head" and not self._in_body and "head" not in self.tag:
                self._open("head", attrs, o0, h0)
            elif tag == "body":
                self._close_to(1, o0, o0)
                self._open("body", attrs, o0, h0)
                self._in_body = True
            return
        if not self._in_body:
            if tag not in HEAD_ONLY:
                self._body(o0)
            elif len(self._stack) == 1 and "head" not in self.tag:
                self._open("head", {}, o0, o0)
        if tag in CLOSES_P:
            depth = self._find_open({"p"}, SCOPE)
            if depth is not None:
                self._close_to(depth, o0, o0)
        if tag in IMPLIED_END:
            depth = self._find_open(*IMPLIED_END[tag])
            if depth is not None:
                self._close_to(depth, o0, o0)
        if tag in HEADINGS and self.tag[self._stack[-1]] in HEADINGS:
            self._close_to(len(self._stack) - 1, o0, o0)
        self._open(tag, attrs, o0, h0, tag in VOID)

    def _end(self, tag: str, h1: int, o1: int) -> None:
        if tag in ("html", "body"):
            return
        names = HEADINGS if tag in HEADINGS else {tag}
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            stops = {"table", "html"}
        elif tag == "table":
            stops = {"html"}
        elif tag in SPECIAL:
            stops = SCOPE - {tag}
        else:
            stops = SPECIAL  # an inline end tag does not close a block around it
        depth = self._find_open(names, stops)
        if depth is not None and depth > 0:
            self._close_to(depth, h1, o1)

    def _text(self, text: str, at: int) -> None:
        if not self._in_body:
            current = self.tag[self._stack[-1]]
            if current in ("html", "head"):
                if not text.strip():
                    return
                self._body(at)
        self.texts.append(text)

    def _read(self, html: str) -> None:
        self._open("html", {}, 0, 0)
        at = 0
        while True:
            found = _TAG.search(html, at)
            stop = found.start() if found else len(html)
            if stop > at:
                self._text(unescape(html[at:stop]), at)
            if not found:
                break
            at = found.end()
            tag = found["tag"] or found["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            if found["end"] or found["end2"]:
                self._end(tag, found.start(), at)
                continue
            self._start(tag, found["attrs"] or found["attrs2"] or "", found.start(), at)
            if tag in RAW_TEXT or tag in PLAIN_TEXT:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                stop = close.start() if close else len(html)
                if stop > at:
                    body = html[at:stop]
                    self.texts.append(unescape(body) if tag in PLAIN_TEXT else body)
                at = stop
        self._close_to(0, len(html), len(html))


def _offsets(lengths: list[int]) -> pa.Array:
    total, out = 0, [0]
    for n in lengths:
        total += n
        out.append(total)
    return pa.array(out, pa.int32())


def _flat(lists) -> list:
    return [x for one in lists for x in one]


def _dom_columns(pages: list[Page]) -> tuple[pa.Array, pa.Array]:
    ints = {name: pa.array(_flat(getattr(p, name) for p in pages), pa.int32())
            for name in ("last", "nth", "t0", "t1", "o0", "h0", "h1", "o1")}
    paths = _flat(p.path for p in pages)
    attrs = _flat(p.attrs for p in pages)
    classes = [a["class"].split() if "class" in a else [] for a in attrs]
    attr_map = pa.MapArray.from_arrays(
        _offsets([len(a) for a in attrs]),
        pa.array(_flat(a.keys() for a in attrs), pa.string()),
        pa.array(_flat(a.values() for a in attrs), pa.string()),
    )
    fields = {
        "pos": pa.array(_flat(range(len(p.tag)) for p in pages), pa.int32()),
        "last": ints["last"],
        "tag": pa.array(_flat(p.tag for p in pages), pa.string()),
        **{name: ints[name] for name in ("nth", "t0", "t1", "o0", "h0", "h1", "o1")},
        "path": pa.ListArray.from_arrays(_offsets([len(x) for x in paths]), pa.array(_flat(paths), pa.int32())),
        "classes": pa.ListArray.from_arrays(_offsets([len(x) for x in classes]), pa.array(_flat(classes), pa.string())),
        "attrs": attr_map,
    }
    structs = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    elements = pa.ListArray.from_arrays(_offsets([len(p.tag) for p in pages]), structs)
    texts = pa.ListArray.from_arrays(
        _offsets([len(p.texts) for p in pages]), pa.array(_flat(p.texts for p in pages), pa.string()))
    return elements, texts


# Pages per output batch are bounded by markup size, so that a batch of large
# pages does not grow with the input batch.
BATCH_CHARS = 4_000_000


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("html"))
        start, size, parsed = 0, 0, []
        for i in range(batch.num_rows):
            html = column[i].as_py() or ""
            parsed.append(Page(html))
            size += len(html)
            if size >= BATCH_CHARS or i == batch.num_rows - 1:
                elements, texts = _dom_columns(parsed)
                part = batch.slice(start, i + 1 - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, elements, texts], names=[*part.schema.names, "elements", "texts"])
                start, size, parsed = i + 1, 0, []


def with_dom(pages: DataFrame) -> DataFrame:
    """Add `elements` and `texts`. Filter and prune columns before this step, as
    Spark cannot push either through Python."""
    from pyspark.sql.types import StructType

    schema = StructType([*pages.schema.fields, *StructType.fromDDL(DOM_SCHEMA).fields])
    return pages.mapInArrow(_parse_batches, schema)
