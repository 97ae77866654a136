"""SQL expressions over the `elements` and `texts` arrays of a page (see sources.html).

These helpers write SQL text: a selector is a function from the name of an
element to a condition, and `filter_`, `transform_`, `exists_` and `let` put the
lambdas around it.  Nested selectors become one expression string that Spark
parses once, which keeps building large plans fast.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pagegauge.functions.text import SPACE_CHARS, SPACE_CLASS

Test = Callable[[str], str]

HIDDEN_STYLE = r"(?i)(^|;)[ \t\n]*display[ \t\n]*:[ \t\n]*none"
_SPACES = "'" + "".join(f"\\u{ord(c):04X}" for c in SPACE_CHARS) + "'"
_names = count()


# --- building blocks ------------------------------------------------------------

def fresh() -> str:
    return f"v{next(_names)}"


def filter_(items: str, test: Test) -> str:
    v = fresh()
    return f"filter({items}, {v} -> {test(v)})"


def transform_(items: str, make: Test) -> str:
    v = fresh()
    return f"transform({items}, {v} -> {make(v)})"


def indexed(items: str, make: Callable[[str, str], str]) -> str:
    v, i = fresh(), fresh()
    return f"transform({items}, ({v}, {i}) -> {make(v, i)})"


def exists_(items: str, test: Test) -> str:
    v = fresh()
    return f"exists({items}, {v} -> {test(v)})"


def let(value: str, use: Test) -> str:
    """use(value) with the value computed once."""
    return f"get({transform_(f'array({value})', use)}, 0)"


def trim(text: str) -> str:
    return f"btrim({text}, {_SPACES})"


def collapse(text: str) -> str:
    return trim(f"regexp_replace({text}, r'{SPACE_CLASS}+', ' ')")


def squeeze(text: str) -> str:
    return f"regexp_replace({text}, r'{SPACE_CLASS}+', '')"


def utf16_length(text: str) -> str:
    return f"cast(octet_length(encode({text}, 'UTF-16BE')) / 2 as int)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


# --- tests ----------------------------------------------------------------------

def attr(e: str, name: str) -> str:
    return f"try_element_at({e}.attrs, '{name}')"


def tag(*names: str) -> Test:
    listed = ", ".join(f"'{n}'" for n in names)
    return lambda e: f"{e}.tag IN ({listed})"


def cls(*names: str) -> Test:
    """All of the classes."""
    return lambda e: "(" + " AND ".join(f"array_contains({e}.classes, '{n}')" for n in names) + ")"


def has(name: str) -> Test:
    return lambda e: f"map_contains_key({e}.attrs, '{name}')"


def attr_is(name: str, value: str) -> Test:
    return lambda e: f"coalesce({attr(e, name)} = '{value}', false)"


def ident(name: str) -> Test:
    return attr_is("id", name)


def attr_has(name: str, part: str) -> Test:
    return lambda e: f"coalesce(contains({attr(e, name)}, '{part}'), false)"


def attr_starts(name: str, part: str) -> Test:
    return lambda e: f"coalesce(startswith({attr(e, name)}, '{part}'), false)"


def attr_like(name: str, pattern: str) -> Test:
    return lambda e: f"coalesce(rlike({attr(e, name)}, r'{pattern}'), false)"


def every(*tests: Test) -> Test:
    return lambda e: "(" + " AND ".join(t(e) for t in tests) + ")"


def some(*tests: Test) -> Test:
    return lambda e: "(" + " OR ".join(t(e) for t in tests) + ")"


def no(test: Test) -> Test:
    return lambda e: f"(NOT {test(e)})"


hidden = some(has("hidden"), attr_is("aria-hidden", "true"), attr_like("style", HIDDEN_STYLE))


# --- moving around ----------------------------------------------------------------

def node(pos: str) -> str:
    return f"get(elements, {pos})"


def select(test: Test) -> str:
    """Elements of the page that pass, in document order."""
    return filter_("elements", test)


def first(items: str, test: Test) -> str:
    return f"get({filter_(items, test)}, 0)"


def first_lazy(items: str, test: Test, value: Test, kind: str) -> str:
    """value of the first item that passes; a costly test is not run beyond it."""
    acc, v = fresh(), fresh()
    return (f"aggregate({items}, cast(null as {kind}), ({acc}, {v}) -> "
            f"CASE WHEN {acc} IS NOT NULL THEN {acc} WHEN {test(v)} THEN {value(v)} END)")


def below(e: str) -> str:
    """Descendants in document order."""
    return f"slice(elements, {e}.pos + 2, {e}.last - {e}.pos)"


def any_below(test: Test) -> Test:
    return lambda e: exists_(below(e), test)


def up(e: str) -> str:
    """Positions of the element and its ancestors, nearest first."""
    return f"reverse(concat({e}.path, array({e}.pos)))"


def closest(e: str, test: Test) -> str:
    """Position of the nearest element upwards, itself included, that passes."""
    return first(up(e), lambda p: test(node(p)))


def inside(test: Test) -> Test:
    """The element or one of its ancestors passes."""
    return lambda e: exists_(up(e), lambda p: test(node(p)))


# --- text and markup ----------------------------------------------------------------

def text_of(e: str) -> str:
    """All text below the element, as it stands in the page."""
    return f"array_join(slice(texts, {e}.t0 + 1, {e}.t1 - {e}.t0), '')"


def _gaps(first: str, last: str, dropped: str, start: str, stop: str, cut: Callable[[str, str], str]) -> str:
    """cut(from, to) for the ranges between `first` and `last` that no dropped element
    covers. The dropped ones do not overlap and stand in document order, so this
    takes one step per dropped element, however much lies between them."""
    a, b = fresh(), fresh()
    starts = f"concat(array({first}), {transform_(dropped, lambda d: f'greatest({d}.{stop}, {first})')})"
    stops = f"concat({transform_(dropped, lambda d: f'least({d}.{start}, {last})')}, array({last}))"
    return f"zip_with({starts}, {stops}, ({a}, {b}) -> {cut(a, f'greatest({b} - {a}, 0)')})"


def texts_without(e: str, dropped: str) -> str:
    """Text nodes below the element without those of the dropped elements."""
    part = f"slice(texts, {e}.t0 + 1, {e}.t1 - {e}.t0)"
    kept = _gaps(f"{e}.t0", f"{e}.t1", dropped, "t0", "t1", lambda a, n: f"slice(texts, {a} + 1, {n})")
    return f"CASE WHEN size({dropped}) = 0 THEN {part} ELSE flatten({kept}) END"


def text_without(e: str, dropped: str) -> str:
    """Text below the element without that of the dropped elements."""
    return f"array_join({texts_without(e, dropped)}, '')"


def below_without(e: str, dropped: str) -> str:
    """Descendants in document order without the dropped elements and theirs."""
    kept = _gaps(f"({e}.pos + 1)", f"({e}.last + 1)", dropped, "pos", "next", lambda a, n: f"slice(elements, {a} + 1, {n})")
    return f"CASE WHEN size({dropped}) = 0 THEN {below(e)} ELSE flatten({kept}) END"


def html_without(e: str, dropped: str) -> str:
    """Inner markup without the dropped elements."""
    pieces = _gaps(f"{e}.h0", f"{e}.h1", dropped, "o0", "o1", lambda a, n: f"substring(html, {a} + 1, {n})")
    return f"array_join({pieces}, '')"


def dropped_of(e: str, unwanted: Test) -> str:
    """Ranges of the unwanted descendants, outermost only, in document order."""
    def outermost(x: str) -> str:
        inner = exists_(f"{x}.path", lambda p: f"{p} > {e}.pos AND {unwanted(node(p))}")
        return f"{unwanted(x)} AND NOT {inner}"
    fields = {f: f for f in ("pos", "t0", "t1", "o0", "o1")}
    return transform_(filter_(below(e), outermost), lambda d: struct(
        next=f"{d}.last + 1", **{f: f"{d}.{f}" for f in fields}))


def xpath(e: str) -> str:
    """/html/body/div[2]: own tag and those of all ancestors; the place is written only if it is not the first of its tag."""
    def step(p: str) -> str:
        n = node(p)
        return f"concat({n}.tag, CASE WHEN {n}.nth > 1 THEN concat('[', {n}.nth, ']') ELSE '' END)"
    return f"concat('/', array_join({transform_(f'reverse({up(e)})', step)}, '/'))"
