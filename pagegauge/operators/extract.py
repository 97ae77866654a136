"""Pages to chunks.

One Python pass reads the markup (`sources.html`); everything else is expressions
over the page's own row, so cutting, dedup and limits need no shuffle.  Each step
adds one array column.  Texts are built for all candidates, the other chunk
fields only for those that remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegauge import fixed_values as V
from pagegauge.functions import text as T
from pagegauge.functions.urls import host_of, is_external, is_platform_host, url_host, url_origin, url_resolve
from pagegauge.operators import dom as D
from pagegauge.operators.chunks import AD_CLASS, ad_text, signature, tag_chunks
from pagegauge.operators.platforms import LINK, NO_BOXES, PLATFORMS, UNWANTED, Piece, Platform, platform_of, ranked
from pagegauge.operators.sponsored import MARK_COLUMNS, is_sponsored, post_root, with_marks
from pagegauge.sources.html import with_dom

# --- fixed values: selectors of ordinary pages ---------------------------------
ARTICLES = [
    D.tag("article"), D.attr_is("role", "article"), D.cls("post"), D.cls("article"), D.cls("entry"),
    D.cls("story"), D.cls("content-item"), D.has("data-post-id"), D.has("data-article-id"),
]
SOCIAL = [
    D.attr_has("data-testid", "post"), D.attr_has("data-testid", "tweet"), D.cls("status"), D.cls("comment"),
    D.cls("reply"), D.cls("thread"),
]
MAIN = D.some(D.tag("main"), D.attr_is("role", "main"), D.cls("content"), D.ident("content"), D.cls("main"))
HEADINGS = D.tag("h1", "h2", "h3", "h4", "h5", "h6")
UNWANTED_IN_ARTICLES = D.some(
    UNWANTED, D.tag("aside"), D.cls("ad"), D.cls("advertisement"), D.attr_has("class", "ad-"), D.attr_has("id", "ad-"))
CODE = D.tag("script", "style", "noscript")
MAIN_TEXT = [
    D.tag("article"), D.tag("main"), D.attr_is("role", "main"), D.cls("content"), D.cls("post"), D.cls("article"),
]
ARTICLE = D.some(D.tag("article", "main"), D.attr_is("role", "article"))
PICTURE = D.every(
    D.tag("img"), lambda e: f"coalesce({D.attr(e, 'src')}, '') <> ''", D.no(D.attr_starts("src", "data:")))
MIN_ELEMENT_CHARS = 50

NO_CANDIDATES = "cast(array() as array<struct<pos:int,marker:int,text:string,heading:string,kind:string>>)"


# --- adverts by element ------------------------------------------------------------

def _ad_word(text: str) -> str:
    return f"coalesce(rlike(lower({text}), r'{AD_CLASS}'), false)"


def _near_classes(e: str) -> str:
    """Classes of the three nearest ancestors."""
    return f"flatten({D.transform_(f'slice(reverse({e}.path), 1, 3)', lambda p: f'{D.node(p)}.classes')})"


HAS_AD_CLASS = lambda e: D.exists_(f"{e}.classes", _ad_word)
HAS_AD_MARK = D.some(
    lambda e: _ad_word(D.attr(e, "id")), D.attr_is("data-sponsored", "true"), D.attr_is("data-ad", "true"))
LIKELY_AD = D.some(HAS_AD_CLASS, HAS_AD_MARK, lambda e: D.exists_(_near_classes(e), _ad_word))


def _nearest_ad(e: str) -> str:
    """Position of the nearest element, itself or above, that looks like an advert."""
    return D.first(D.up(e), lambda p: LIKELY_AD(D.node(p)))


# --- pieces ---------------------------------------------------------------------

def _use_piece(box: str, use) -> str:
    """use(Piece) for a struct<pos, marker, dropped>."""
    def with_element(e: str) -> str:
        return D.let(D.below_without(e, f"{box}.dropped"), lambda inner: use(
            Piece(e, inner, f"{box}.dropped", D.node(f"{box}.marker"))))
    return D.let(D.node(f"{box}.pos"), with_element)


def _each_piece(boxes: str, use) -> str:
    return D.transform_(boxes, lambda b: _use_piece(b, use))


def _with_boxes(df: DataFrame, name: str, boxes: str, unwanted: D.Test) -> DataFrame:
    """Add visible containers with the ranges that their text leaves out."""
    shown = df.withColumn(name, F.expr(D.filter_(boxes, lambda b: "NOT " + D.hidden(D.node(f"{b}.pos")))))
    return shown.withColumn(name, F.expr(D.transform_(name, lambda b: D.struct(
        pos=f"{b}.pos", marker=f"{b}.marker", dropped=D.dropped_of(D.node(f"{b}.pos"), unwanted)))))


def _candidate(pos: str, text: str, kind: str, marker: str = "-1", heading: str = "cast(null as string)") -> str:
    return D.struct(pos=pos, marker=marker, text=text, heading=heading, kind=kind)


def _long(found: str, least: str | int) -> str:
    return D.filter_(found, lambda c: f"{D.utf16_length(f'{c}.text')} >= {least}")


def _with_platform_chunks(
    df: DataFrame, platforms: dict[str, Platform], min_text: int
) -> DataFrame:
    """Add `by_platform`: candidates found by the page's platform."""
    def switch(make, other: str) -> str:
        branches = " ".join(f"WHEN '{key}' THEN {make(p)}" for key, p in platforms.items())
        return f"CASE platform {branches} ELSE {other} END"
    df = _with_boxes(df, "_boxes", switch(lambda p: p.containers(), NO_BOXES), UNWANTED)
    df = df.withColumn("_parts", F.expr(switch(
        lambda p: _each_piece("_boxes", p.parts), "cast(array() as array<array<string>>)")))
    keep = lambda xs: D.filter_(xs, lambda x: f"coalesce({x}, '') <> ''")
    b, t = D.fresh(), D.fresh()
    joined = D.transform_("_parts", lambda xs: D.trim(f"array_join({keep(xs)}, '\\n')"))
    df = df.withColumn("_found", F.expr(
        f"zip_with(_boxes, {joined}, ({b}, {t}) -> "
        + _candidate(f"{b}.pos", t, "platform", f"{b}.marker") + ")"))
    least = switch(lambda p: str(max(p.min_chars, min_text)), str(min_text))
    return df.withColumn("by_platform", F.expr(_long("_found", least))).drop("_boxes", "_parts", "_found")


def _with_article_chunks(
    df: DataFrame, into: str, tests: list[D.Test], needed: str, min_text: int, include_ads: bool
) -> DataFrame:
    """Add candidates of the first selectors that match, where `needed` holds."""
    df = df.withColumn("_boxes", F.expr(f"CASE WHEN {needed} THEN {ranked(*tests)} ELSE {NO_BOXES} END"))
    if not include_ads:
        df = df.withColumn("_boxes", F.expr(D.filter_("_boxes", lambda b: "NOT " + LIKELY_AD(D.node(f"{b}.pos")))))
    text = lambda b: D.trim(D.text_without(D.node(f"{b}.pos"), f"{b}.dropped"))
    if min_text < MIN_ELEMENT_CHARS:
        # Otherwise implied: the text that counts below is part of this one.
        df = _with_boxes(df, "_boxes", "_boxes", CODE)
        df = df.withColumn("_boxes", F.expr(D.filter_(
            "_boxes", lambda b: f"{D.utf16_length(text(b))} >= {MIN_ELEMENT_CHARS}")))
    df = _with_boxes(df, "_boxes", "_boxes", UNWANTED_IN_ARTICLES)
    found = D.transform_("_boxes", lambda b: _candidate(f"{b}.pos", text(b), "'element'", f"{b}.marker"))
    return df.withColumn(into, F.expr(_long(found, max(min_text, 1)))).drop("_boxes")


def _with_sections(df: DataFrame, into: str, needed: str, min_text: int) -> DataFrame:
    """Add candidates of the main region, split by headings or packed from paragraphs."""
    df = df.withColumn("_main", F.expr(f"CASE WHEN {needed} THEN {D.first('elements', MAIN)} END"))
    texts = D.transform_(D.filter_(D.below("_main"), D.tag("p")), lambda p: D.struct(
        text=D.trim(D.text_of(p)), pos=f"{p}.pos"))
    df = df.withColumns({
        "_heads": F.expr(D.filter_(D.below("_main"), HEADINGS)),
        "_paragraphs": F.expr(D.filter_(texts, lambda x: f"{x}.text <> ''")),
    })
    found = (
        f"CASE WHEN _main IS NULL THEN {NO_CANDIDATES} WHEN size(_heads) > 0 THEN {split_by_headings()} "
        f"ELSE {pack_paragraphs(min_text)} END")
    df = df.withColumn(into, F.expr(found))
    return df.withColumn(into, F.expr(_long(into, min_text))).drop("_main", "_heads", "_paragraphs")


def split_by_headings() -> str:
    """Sections of _main: each starts at a heading and holds the text up to the next
    one, every text node once. The part before the first heading counts too."""
    def section(i: str) -> str:
        head, following = f"get(_heads, {i} - 1)", f"get(_heads, {i})"
        own = lambda field: f"(CASE WHEN {i} = 0 THEN _main.{field} ELSE {head}.{field} END)"
        # The stretch from this heading to the next one, in the shape of an element.
        part = D.struct(
            t0=own("t0"), t1=f"coalesce({following}.t0, _main.t1)",
            pos=own("pos"), last=f"coalesce({following}.pos - 1, _main.last)")
        def leaves(p: str) -> str:
            code = D.let(D.dropped_of(p, CODE), lambda c: D.texts_without(p, c))
            return f"array_join(array_remove({D.transform_(code, D.trim)}, ''), ' ')"
        return _candidate(
            own("pos"), D.let(part, leaves), "'section'",
            heading=f"CASE WHEN {i} > 0 THEN {D.trim(D.text_of(head))} END")
    return D.transform_("sequence(0, size(_heads))", section)


def pack_paragraphs(min_text: int) -> str:
    """_paragraphs joined until twice the minimum is reached; the rest if it reaches the minimum."""
    acc, x, end = D.fresh(), D.fresh(), D.fresh()
    numbered = D.indexed("_paragraphs", lambda p, i: D.struct(
        i=i, n=D.utf16_length(f"{p}.text"), pos=f"{p}.pos"))
    chars = f"({acc}.chars + 1 + {x}.n)"
    done = f"{chars} >= {min_text * 2}"
    group = D.struct(start=f"{acc}.start", stop=f"{x}.i", pos=f"{x}.pos")
    add = D.struct(
        start=f"CASE WHEN {done} THEN {x}.i + 1 ELSE {acc}.start END",
        chars=f"CASE WHEN {done} THEN -1 ELSE {chars} END",
        out=f"CASE WHEN {done} THEN concat({acc}.out, array({group})) ELSE {acc}.out END")
    rest = D.struct(start=f"{end}.start", stop="size(_paragraphs) - 1", pos="_main.pos")
    flush = f"CASE WHEN {end}.chars >= {min_text} THEN concat({end}.out, array({rest})) ELSE {end}.out END"
    zero = D.struct(start="0", chars="-1", out="cast(array() as array<struct<start:int,stop:int,pos:int>>)")
    groups = f"aggregate({numbered}, {zero}, ({acc}, {x}) -> {add}, {end} -> {flush})"
    def joined(g: str) -> str:
        members = f"slice(_paragraphs, {g}.start + 1, {g}.stop - {g}.start + 1)"
        return _candidate(f"{g}.pos", f"array_join({D.transform_(members, lambda p: f'{p}.text')}, ' ')", "'section'")
    return D.transform_(groups, joined)


# --- dedup, adverts, limit ---------------------------------------------------------

def _with_unique(df: DataFrame, name: str) -> DataFrame:
    """Keep the first candidate of each signature, in order. Sorted by signature
    rather than compared pair by pair, so long lists stay cheap."""
    df = df.withColumn("_sorted", F.array_sort(F.transform(name, lambda c, i: F.struct(
        signature(c["text"]).alias("sig"), i.alias("i")))))
    df = df.withColumn("_keep", F.expr(
        "array_sort(transform(filter(_sorted, (k, j) -> j = 0 OR get(_sorted, j - 1).sig <> k.sig), k -> k.i))"))
    return df.withColumn(name, F.expr(f"transform(_keep, i -> get({name}, i))")).drop("_sorted", "_keep")


def _with_sponsored(df: DataFrame, name: str) -> DataFrame:
    """Add `_roots` and `_sponsored`: the feed post around each candidate and whether
    it is sponsored; null off the feed platform."""
    root = D.transform_(name, lambda c: (
        f"CASE WHEN _on_feed THEN coalesce({post_root(D.node(f'{c}.pos'))}, {c}.pos) END"))
    df = df.withColumn("_roots", F.expr(root))
    return df.withColumn("_sponsored", F.expr(D.transform_(
        "_roots", lambda r: f"CASE WHEN {r} IS NOT NULL THEN {is_sponsored(D.node(r))} ELSE false END")))


def _with_finished(df: DataFrame, name: str, include_ads: bool, max_chunks: int | None) -> DataFrame:
    """Dedup, take out adverts unless wanted, limit."""
    df = _with_unique(df, name)
    if not include_ads:
        df = _with_sponsored(df, name)
        by_element = D.transform_(name, lambda c: (
            f"({c}.kind <> 'section' AND {HAS_AD_CLASS(D.node(f'{c}.pos'))}) "
            f"OR ({c}.kind = 'element' AND {HAS_AD_MARK(D.node(f'{c}.pos'))})"))
        df = df.withColumn("_ads", F.zip_with(
            F.expr(by_element), F.transform(name, lambda c: ad_text(c["text"])), lambda a, b: a | b))
        df = df.withColumn("_zipped", F.arrays_zip(name, "_ads", "_sponsored"))
        df = df.withColumn(name, F.expr(
            f"transform(filter(_zipped, x -> NOT x._ads AND NOT x._sponsored), x -> x.{name})"
        )).drop("_sponsored", "_roots", "_ads", "_zipped")
    return df if max_chunks is None else df.withColumn(name, F.slice(name, 1, max_chunks))


# --- chunk fields --------------------------------------------------------------------

def _first_of(array: str, n: int | None) -> str:
    return array if n is None else f"slice({array}, 1, {n})"


def _with_details(df: DataFrame, platforms: dict[str, Platform], with_html: bool, max_links: int | None,
                  max_images: int | None, link_chars: int | None) -> DataFrame:
    """Add `chunks`: all fields of the remaining candidates in `found`."""
    df = _with_sponsored(df, "found").drop(*MARK_COLUMNS)
    element = lambda c: D.node(f"{c}.pos")
    df = df.withColumn("_boxes", F.expr(D.transform_("found", lambda c: D.struct(
        pos=f"{c}.pos", marker=f"{c}.marker", kind=f"{c}.kind",
        dropped=f"CASE WHEN {c}.kind = 'element' THEN {D.dropped_of(element(c), UNWANTED_IN_ARTICLES)} "
                f"ELSE {D.dropped_of(element(c), UNWANTED)} END"))))

    def per_box(use, empty: str) -> str:
        return D.transform_("_boxes", lambda b: f"CASE WHEN {b}.kind = 'section' THEN {empty} ELSE {use(b)} END")

    def links(b: str) -> str:
        def of(p: Piece) -> str:
            wanted = lambda a: f"{LINK(a)} AND ({b}.kind = 'element' OR {D.attr(a, 'href')} <> '')"
            shown = lambda a: p.text(a) if link_chars is None else f"substring({p.text(a)}, 1, {link_chars})"
            return D.transform_(_first_of(D.filter_(p.inner, wanted), max_links), lambda a: D.struct(
                url=D.attr(a, "href"), text=shown(a)))
        return _use_piece(b, of)

    def images(b: str) -> str:
        return _use_piece(b, lambda p: D.transform_(_first_of(D.filter_(p.inner, PICTURE), max_images), _image))

    def heading(b: str) -> str:
        return _use_piece(b, lambda p: "coalesce(" + ", ".join(
            f"nullif({D.collapse(p.text_at(D.tag(h)))}, '')" for h in ("h1", "h2", "h3")) + ")")

    def target(b: str) -> str:
        known = [f"WHEN '{n}' THEN {_use_piece(b, p.target)}" for n, p in platforms.items() if p.target]
        return f"CASE {b}.kind {' '.join(known)} END" if known else "cast(null as string)"

    data = lambda e: f"map_filter({e}.attrs, (k, v) -> startswith(k, 'data-'))"

    def meta(c: str) -> str:
        e = element(c)
        return D.struct(
            element_type=f"CASE WHEN {c}.kind <> 'section' THEN {e}.tag END",
            classes=f"CASE WHEN {c}.kind <> 'section' THEN {e}.classes ELSE cast(array() as array<string>) END",
            id=f"CASE WHEN {c}.kind = 'element' THEN {D.attr(e, 'id')} END",
            data_attributes=f"CASE WHEN {c}.kind = 'element' THEN {data(e)} END")

    def content_tag(c: str) -> str:
        return (f"CASE {c}.kind WHEN 'section' THEN 'article' WHEN 'element' THEN "
                f"CASE WHEN {ARTICLE(element(c))} THEN 'article' ELSE 'other' END END")

    columns = {
        "links": per_box(links, "cast(array() as array<struct<url:string,text:string>>)"),
        "images": per_box(images, "cast(array() as array<struct<src:string,alt:string,title:string>>)"),
        "heading_title": per_box(heading, "cast(null as string)"),
        "target_url": D.transform_("_boxes", target),
        "metadata": D.transform_("found", meta),
        "content_tag": D.transform_("found", content_tag),
        "xpath": D.transform_("found", lambda c: D.xpath(element(c))),
        "parent_classes": D.transform_("found", lambda c: _near_classes(element(c))),
        "ad_pos": D.transform_("found", lambda c: f"coalesce({_nearest_ad(element(c))}, {c}.pos)"),
    }
    if with_html:
        columns["chunk_html"] = D.transform_("_boxes", lambda b: (
            f"CASE WHEN {b}.kind <> 'section' THEN {D.html_without(D.node(f'{b}.pos'), f'{b}.dropped')} END"))
    df = df.withColumns({name: F.expr(sql) for name, sql in columns.items()})
    df = df.withColumn("ad_root", F.expr(
        "transform(zip_with(_roots, ad_pos, (r, a) -> coalesce(r, a)), p -> " + D.xpath(D.node("p")) + ")"))
    parts = ["found", "_sponsored", "ad_root", *(name for name in columns if name != "ad_pos")]
    return df.withColumn("chunks", F.arrays_zip(*parts))


def _image(e: str) -> str:
    return D.struct(
        src=D.attr(e, "src"), alt=f"coalesce({D.attr(e, 'alt')}, '')", title=f"coalesce({D.attr(e, 'title')}, '')")


def _absolute_images(images: Column, url: Column) -> Column:
    return F.transform(images, lambda i: F.struct(
        F.coalesce(url_resolve(i["src"], url), i["src"]).alias("src"), i["alt"].alias("alt"), i["title"].alias("title")))


def extract_chunks(
    pages: DataFrame,
    min_text: int = V.MIN_CHUNK_CHARS,
    max_chunks: int | None = None,
    include_ads: bool = False,
    strategy: str = "auto",
    platforms: dict[str, Platform] | None = None,
    with_html: bool = False,
    carry: list[str] | None = None,
    max_links: int | None = None,
    max_images: int | None = None,
    link_chars: int | None = None,
) -> DataFrame:
    """Chunks of pages(page_id, url, html): one row per chunk, key (page_id, chunk_pos).

    strategy "auto" tries the page's platform first and the generic selectors if
    that yields nothing; "regex" uses the generic selectors only.  The chunk's
    markup is added with with_html=True; leave it out of tables that are shuffled.
    Page columns named in `carry` are kept on the chunks.  Every link and image of a
    chunk is kept, with whole link texts, unless the last three arguments say less.
    """
    carry = carry or []
    if strategy not in ("auto", "regex"):
        raise ValueError(strategy)
    platforms = PLATFORMS if platforms is None else platforms
    if strategy == "regex":
        platforms = {}
    df = with_dom(pages.select("page_id", "url", "html", *carry))
    df = df.withColumns({
        "_on_feed": is_platform_host(F.coalesce("url", F.lit(""))),
        "platform": F.expr(platform_of(platforms)),
    })
    df = with_marks(df, "_on_feed")
    needed = "true"
    if platforms:
        df = _with_platform_chunks(df, platforms, min_text)
        df = _with_finished(df, "by_platform", include_ads, max_chunks)
        needed = "size(by_platform) = 0"
    df = _with_article_chunks(df, "_articles", ARTICLES, needed, min_text, include_ads)
    needed += " AND size(_articles) = 0"
    df = _with_article_chunks(df, "_social", SOCIAL, needed, min_text, include_ads)
    needed += " AND size(_social) = 0"
    df = _with_sections(df, "_sections", needed, min_text)
    df = df.withColumn("found", F.concat("_articles", "_social", "_sections")).drop("_articles", "_social", "_sections")
    df = _with_finished(df, "found", include_ads, max_chunks)
    if platforms:
        # The platform counts for tags only if its own selectors found the chunks.
        own = F.size("by_platform") > 0
        df = df.withColumns({
            "found": F.when(own, F.col("by_platform")).otherwise(F.col("found")),
            "platform": F.when(own, F.col("platform")),
        }).drop("by_platform")
    built = _with_details(df, platforms, with_html, max_links, max_images, link_chars)
    # The outer form keeps Spark from evaluating all of the above again in a filter.
    rows = built.select("page_id", "url", *carry, "platform", F.posexplode_outer("chunks").alias("chunk_pos", "x")).where(
        "x is not null")
    url, origin = F.col("url"), url_origin(F.col("url"))
    own_title = F.coalesce(F.col("x.heading_title"), T.nullif_blank(T.collapse_space(F.col("x.found.heading"))))
    flat = rows.select(
        "page_id", "chunk_pos", "url", host_of(url).alias("domain"), "platform", "x.found.text",
        F.coalesce(own_title, T.first_sentence(F.col("x.found.text"))).alias("title"),
        "x.found.heading",
        F.transform("x.links", lambda a: F.struct(
            a["url"].alias("url"), a["text"].alias("text"), is_external(a["url"], origin).alias("is_external"))).alias("links"),
        _absolute_images(F.col("x.images"), url).alias("images"),
        "x.metadata", "x.xpath", "x.parent_classes", "x.target_url", F.col("x._sponsored").alias("sponsored"), "x.ad_root",
        *([F.col("x.chunk_html").alias("html")] if with_html else []),
        F.array_compact(F.array(F.col("x.content_tag"))).alias("tags"),
        *carry,
    )
    return tag_chunks(flat)


def detect_platform(pages: DataFrame, platforms: dict[str, Platform] | None = None) -> DataFrame:
    """page_id, url and the platform (null for none)."""
    parsed = with_dom(pages.select("page_id", "url", "html"))
    found = F.expr(platform_of(PLATFORMS if platforms is None else platforms))
    return parsed.select("page_id", "url", found.alias("platform"))


def extract_page_metadata(pages: DataFrame, max_links: int | None = None, max_images: int | None = None,
                          link_chars: int | None = None) -> DataFrame:
    """Title, description, author, times, site name, domain, main text, images and
    links of each page: all of them, with whole link texts, unless told otherwise."""
    parsed = with_dom(pages.select("page_id", "url", "html"))
    url = F.col("url")
    origin = url_origin(url)

    def meta(name: str) -> Column:
        named = D.every(D.tag("meta"), D.some(D.attr_is("property", name), D.attr_is("name", name)))
        return F.expr(f"coalesce({D.attr(D.first('elements', named), 'content')}, '')")

    code = D.tag("script", "style", "noscript", "iframe")
    main = "coalesce(" + ", ".join(D.first("elements", t) for t in [*MAIN_TEXT, D.tag("body")]) + ")"
    anchors = D.transform_(D.select(LINK), lambda a: D.struct(href=D.attr(a, "href"), text=D.trim(D.text_of(a))))
    read = parsed.select(
        "page_id", "url", "elements", "texts",
        F.expr(main).alias("_main"), F.expr(anchors).alias("_anchors"),
        F.expr(D.transform_(_first_of(D.select(PICTURE), max_images), _image)).alias("_images"),
        F.expr(D.let(D.first("elements", D.tag("title")), lambda t: D.collapse(D.text_of(t)))).alias("_title"),
        meta("description").alias("description"), meta("author").alias("author"),
        meta("article:published_time").alias("published_time"),
        meta("article:modified_time").alias("modified_time"), meta("og:site_name").alias("site_name"),
    )
    main_text = D.trim(D.let(D.dropped_of("_main", code), lambda gone: D.text_without("_main", gone)))
    absolute = F.transform("_anchors", lambda a: F.struct(
        _absolute(a["href"], url).alias("url"), (a["text"] if link_chars is None else F.substring(a["text"], 1, link_chars)).alias("text")))
    web = F.filter(absolute, lambda a: F.startswith(a["url"], F.lit("http")))
    if max_links is not None:
        web = F.slice(web, 1, max_links)
    return read.select(
        "page_id", "url", F.coalesce("_title", F.lit("")).alias("title"), "description", "author",
        "published_time", "modified_time", "site_name", url_host(url).alias("domain"),
        F.expr(main_text).alias("text"),
        _absolute_images(F.col("_images"), url).alias("images"),
        F.transform(web, lambda a: F.struct(
            a["url"].alias("url"), a["text"].alias("text"), (~F.startswith(a["url"], origin)).alias("is_external"))).alias("links"),
    )


def _absolute(href: Column, base: Column) -> Column:
    """Absolute form of a link; empty links and page anchors lead to the page itself."""
    page = F.regexp_replace(base, r"#.*\z", "")
    return F.when(href == "", page).when(F.startswith(href, F.lit("#")), F.concat(page, href)).otherwise(
        url_resolve(href, base))
