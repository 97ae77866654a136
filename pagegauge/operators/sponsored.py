"""Sponsored posts and side panels of feed pages. Selectors write SQL, see `dom`."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagegauge.functions.urls import is_platform_host
from pagegauge.operators import dom as D
from pagegauge.sources.html import with_dom

# --- fixed values: markup of sponsored feed content ----------------------------
AD_MARKERS = D.some(
    D.has("data-ad-rendering-role"), D.has("data-ad-preview"), D.has("data-ad-comet-preview"), D.has("data-ad-video"))
FEED_POSTS = [
    D.attr_is("role", "article"),
    D.every(D.tag("div"), D.attr_starts("data-pagelet", "FeedUnit_")),
    D.every(D.tag("div"), D.attr_starts("id", "hyperfeed_story_id_")),
]
PROFILE = D.attr_is("data-ad-rendering-role", "profile_name")
AD_BODY = D.some(
    D.attr_is("data-ad-rendering-role", "story_message"), D.attr_is("data-ad-preview", "message"),
    D.attr_is("data-ad-comet-preview", "message"), D.has("data-ad-video"))
FEED = D.attr_is("role", "feed")
SIDE = D.attr_is("role", "complementary")
FLEX_SPAN = D.every(D.tag("span"), D.some(D.attr_has("style", "display: flex"), D.attr_has("style", "display:flex")))
AD_LINK = D.every(D.tag("a"), D.attr_has("href", "l.facebook.com/l.php"))
RAIL = D.attr_like("data-pagelet", r"(?i)ego|right.?rail|RightRail")
LABEL = "Sponsored"
WORD = "sponsored"


def _text(e: str) -> str:
    return D.trim(D.text_of(e))


LABEL_SPAN = D.every(D.tag("span"), lambda e: D.let(
    _text(e), lambda t: f"({t} = '{LABEL}' OR startswith({t}, '{LABEL} '))"))


def _spelled(e: str) -> str:
    """The child spans spell out the label."""
    letters = D.filter_(D.below(e), lambda c: f"{D.tag('span')(c)} AND size({c}.path) = size({e}.path) + 1")
    word = f"array_join({D.transform_(letters, D.text_of)}, '')"
    return f"startswith(lower({D.squeeze(word)}), '{WORD}')"


SPLIT_LETTERS = D.every(FLEX_SPAN, _spelled)
SHORT_LABEL = D.every(D.has("aria-labelledby"), lambda e: D.let(
    D.squeeze(D.text_of(e)), lambda t: f"(length({t}) <= 24 AND startswith(lower({t}), '{WORD}'))"))
# A hidden <b> inside a span whose text starts with the label.
HIDDEN_LETTER = D.every(D.tag("b"), D.attr_has("style", "display: none"), lambda e: (
    f"coalesce(startswith({D.let(D.node(D.closest(e, D.tag('span'))), _text)}, '{LABEL}'), false)"))

MARK = D.some(AD_MARKERS, D.attr_is("aria-label", LABEL), LABEL_SPAN, SPLIT_LETTERS, SHORT_LABEL, HIDDEN_LETTER)


def with_marks(df: DataFrame, on_feed: str = "true") -> DataFrame:
    """Add the positions of sponsored marks, profile names and advert bodies, once per
    page and on feed pages only; the tests below look them up."""
    def positions(test: D.Test):
        found = D.transform_(D.select(test), lambda e: f"{e}.pos")
        return F.expr(f"CASE WHEN {on_feed} THEN {found} ELSE cast(array() as array<int>) END")
    return df.withColumns({"_marks": positions(MARK), "_profiles": positions(PROFILE), "_bodies": positions(AD_BODY)})


MARK_COLUMNS = ["_marks", "_profiles", "_bodies"]


def _within(e: str) -> D.Test:
    return lambda m: f"({m} > {e}.pos AND {m} <= {e}.last)"


def is_sponsored(e: str) -> str:
    """Some descendant marks the element as sponsored."""
    return D.exists_("_marks", _within(e))


def _is_shell(e: str) -> str:
    """Holds exactly one profile name and an advert body; not the page itself."""
    return (f"({D.no(D.tag('html', 'body'))(e)} AND size({D.filter_('_profiles', _within(e))}) = 1 "
            f"AND {D.exists_('_bodies', _within(e))})")


SIDE_HEADING = D.every(
    D.tag("span"), lambda e: f"{_text(e)} = '{LABEL}'", D.no(D.inside(FEED)), D.no(D.inside(PROFILE)))


def post_root(e: str) -> str:
    """Position of the feed post around an element: a known post element; else the
    nearest advert shell or direct child of the feed above; else a pagelet."""
    known = [D.closest(e, test) for test in FEED_POSTS]
    def step(p: str) -> str:
        parent = D.node(f"get(reverse({D.node(p)}.path), 0)")
        return f"({_is_shell(D.node(p))} OR coalesce({FEED(parent)}, false))"
    walked = D.first_lazy(D.up(e), step, lambda p: p, "int")
    return f"coalesce({', '.join(known)}, {walked}, {D.closest(e, D.has('data-pagelet'))})"


def _panel_root(heading: str) -> str:
    """Side column, right rail, or the box with the advert links around a heading."""
    numbered = D.indexed(f"reverse({heading}.path)", lambda p, i: D.struct(p=p, i=i))
    def is_root(x: str) -> str:
        n = D.node(f"{x}.p")
        return f"({SIDE(n)} OR {D.ident('rightCol')(n)} OR {RAIL(n)} OR ({x}.i >= 2 AND {D.any_below(AD_LINK)(n)}))"
    near = D.first_lazy(numbered, is_root, lambda x: f"{x}.p", "int")
    return f"coalesce({near}, {D.closest(heading, SIDE)}, get(reverse({heading}.path), 1))"


def sponsored_post_roots() -> str:
    """Positions of the sponsored posts, each once."""
    marker = D.some(
        AD_MARKERS, D.attr_is("aria-label", LABEL), D.every(LABEL_SPAN, D.no(SIDE_HEADING)), SPLIT_LETTERS)
    roots = f"array_compact(array_distinct({D.transform_(D.select(marker), post_root)}))"
    return f"array_sort({D.filter_(roots, lambda r: is_sponsored(D.node(r)))})"


def sponsored_panel_roots() -> str:
    """Positions of the sponsored side panels outside the feed, outermost only."""
    roots = f"array_compact(array_distinct({D.transform_(D.select(SIDE_HEADING), _panel_root)}))"
    outside = D.filter_(roots, lambda r: D.no(D.inside(FEED))(D.node(r)))
    def outermost(rs: str) -> str:
        return D.filter_(rs, lambda r: "NOT " + D.exists_(
            rs, lambda o: f"{o} < {r} AND {D.node(o)}.last >= {D.node(r)}.last"))
    return f"array_sort({D.let(outside, outermost)})"


def _rooted(pages: DataFrame, roots: str, kind: str) -> DataFrame:
    """(page_id, kind, xpath) of the roots on pages of the feed platform."""
    feed = with_marks(with_dom(pages.where(is_platform_host(F.col("url"))).select("page_id", "html")))
    paths = feed.withColumn("roots", F.expr(roots)).select(
        "page_id", F.explode_outer(F.expr(D.transform_("roots", lambda r: D.xpath(D.node(r))))).alias("xpath"))
    return paths.where("xpath is not null").select("page_id", F.lit(kind).alias("kind"), "xpath")


def sponsored_posts(pages: DataFrame) -> DataFrame:
    return _rooted(pages, sponsored_post_roots(), "post")


def sponsored_panels(pages: DataFrame) -> DataFrame:
    return _rooted(pages, sponsored_panel_roots(), "panel")
