"""How each platform's pages are cut into chunks: a table of selectors.

A Platform says which URLs and marker elements give it away, where its
containers are, and which parts of a container make up the chunk text.  Add an
entry to PLATFORMS, or pass your own table to extract_chunks, for a new one.
All selectors write SQL, see `dom`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pagegauge.operators import dom as D

# --- fixed values: marker classes and attributes of the platforms --------------
LINK = D.every(D.tag("a"), D.has("href"))
GOOGLE_TAB = D.cls("MgQdud")
GOOGLE_LINK = D.some(D.tag("cite"), D.cls("tjvcx", "GvPZzd", "cHaqb"), LINK)
GOOGLE_TITLE = D.some(D.tag("h3", "h2"), D.cls("LC20lb"), D.cls("DKV0Md"))
GOOGLE_SITE = D.cls("VuuXrf")
GOOGLE_SNIPPET = D.some(D.cls("VwiC3b"), D.cls("yXK7lf"), D.cls("s"), D.cls("st"))
GOOGLE_RELATED = D.some(D.every(D.tag("a"), D.inside(D.cls("KTAFWb"))), D.cls("qXOWAb"))
DDG_TAB = D.cls("SnptgjT2zdOhGYfNng6g")
DDG_TITLE = D.some(D.tag("h2", "h3"), D.every(D.tag("a"), D.attr_is("data-testid", "result-title-a")))
DDG_LINK = D.some(LINK, D.cls("xS2NxE06pIznLuh2xjH0"), D.has("data-link"))
DDG_SITE = D.some(D.cls("OQ_6vPwNhCeusNiEDcGp"), D.cls("pAgARfGNTRe_uaK72TAD"))
DDG_SNIPPET = D.some(
    D.attr_is("data-result", "snippet"), D.cls("E2eLOJr8HctVnDOTM8fs"), D.cls("OgdwYG6KE2qthn9XQWFC"))
DDG_AREA = D.some(D.attr_is("data-testid", "links"), D.ident("links"), D.cls("results"), D.tag("main"))
REDDIT_POST = D.some(D.attr_is("data-testid", "post-content"), D.cls("usertext-body"), D.cls("md"))
THREADS_LINK = D.cls("x1lliihq", "x193iq5w", "x6ikm8r", "x10wlt62", "xlyipyv", "xuxw1ft")
FACEBOOK_LINK = D.cls("x1e56ztr", "xtvhhri")
FACEBOOK_AUTHOR = D.some(D.attr_is("data-testid", "story-subtitle"), D.cls("x1i10hfl"))
FACEBOOK_MESSAGE = D.some(
    D.attr_is("data-ad-preview", "message"), D.attr_is("data-testid", "post_message"), D.cls("userContent"))
BLUESKY_AUTHOR = D.some(
    D.attr_is("data-testid", "authorName"), D.cls("author-name"), D.attr_is("data-testid", "userName"))
UNWANTED = D.tag("script", "style", "noscript", "iframe", "nav", "header", "footer")

NO_BOXES = "cast(array() as array<struct<pos:int,marker:int>>)"


@dataclass(frozen=True)
class Piece:
    """Names of one container's element, its kept descendants, the ranges dropped
    from it, and the marker element that led to it (for platforms that have one)."""

    element: str
    inner: str
    dropped: str
    marker: str

    def text(self, e: str) -> str:
        return D.trim(D.text_without(e, self.dropped))

    def text_at(self, test: D.Test) -> str:
        return D.let(D.first(self.inner, test), self.text)

    def texts_at(self, test: D.Test) -> str:
        return D.transform_(D.filter_(self.inner, test), self.text)


@dataclass(frozen=True)
class Platform:
    name: str
    url_parts: list[str]
    marker: D.Test
    # SQL for array<struct<pos, marker>> of the containers, in order
    containers: Callable[[], str]
    # SQL for array<string> of the text parts; blank ones are left out
    parts: Callable[[Piece], str]
    min_chars: int = 50
    target: Callable[[Piece], str] | None = None


def boxes(items: str) -> str:
    return D.transform_(items, lambda e: D.struct(pos=f"{e}.pos", marker="-1"))


def _case(*branches: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {other} END"


def ranked(*tests: D.Test) -> str:
    """Containers in the order of the tests, then of the page; an element that
    passes several tests counts for the first."""
    def which(e: str) -> str:
        return "CASE " + " ".join(f"WHEN {t(e)} THEN {i}" for i, t in enumerate(tests)) + " END"
    hits = D.filter_(
        D.transform_("elements", lambda e: D.struct(rank=which(e), pos=f"{e}.pos")), lambda x: f"{x}.rank IS NOT NULL")
    return boxes(f"array_sort({hits})")


# --- search pages ---------------------------------------------------------------

def _google_containers() -> str:
    tab = D.let(D.first("elements", GOOGLE_TAB), D.text_of)
    results = D.filter_(
        D.select(D.some(D.cls("tF2Cxc"), D.cls("g"))),
        D.every(D.any_below(GOOGLE_TITLE), D.any_below(GOOGLE_LINK)))
    cards = D.select(D.some(D.cls("WlydOe"), D.cls("ddkIM", "c30Ztd")))
    return D.let(tab, lambda t: _case(
        (f"{t} = 'News'", boxes(D.select(D.cls("WlydOe")))),
        (f"{t} = 'Videos'", boxes(D.select(D.cls("iUh30")))),
        other=boxes(f"concat({results}, {cards})")))


def _google_parts(p: Piece) -> str:
    picture = D.trim(D.attr(D.first(p.inner, D.every(D.tag("img"), D.has("alt"))), "alt"))
    one = [p.text_at(t) for t in (GOOGLE_TITLE, GOOGLE_SITE, GOOGLE_LINK, GOOGLE_SNIPPET)]
    return f"concat(array({', '.join(one)}, {picture}), {p.texts_at(GOOGLE_RELATED)})"


def _google_target(p: Piece) -> str:
    return D.let(D.first(p.inner, GOOGLE_LINK), lambda e: f"coalesce(nullif({D.attr(e, 'href')}, ''), {p.text(e)})")


def _ddg_containers() -> str:
    tab = f"coalesce({D.let(D.first('elements', DDG_TAB), D.text_of)}, '')"
    article = D.tag("article")
    marked = D.select(D.every(article, D.attr_is("data-testid", "result")))
    in_area = D.let(D.first("elements", DDG_AREA), lambda a: D.filter_(D.below(a), article))
    found = D.let(marked, lambda m: f"CASE WHEN size({m}) > 0 THEN {m} ELSE " + D.let(
        in_area, lambda n: f"CASE WHEN coalesce(size({n}), 0) > 0 THEN {n} ELSE {D.select(article)} END") + " END")
    results = D.filter_(found, D.every(D.any_below(DDG_TITLE), D.any_below(LINK)))
    cards = D.select(D.cls("module--carousel__item", "has-image"))
    return D.let(tab, lambda t: _case(
        (f"contains({t}, 'News')", boxes(D.select(D.cls("result--news")))),
        (f"contains({t}, 'Videos')", boxes(D.select(D.cls("tile--vid")))),
        other=boxes(f"concat({results}, {cards})")))


def _ddg_parts(p: Piece) -> str:
    return f"array({', '.join(p.text_at(t) for t in (DDG_SITE, DDG_LINK, DDG_TITLE, DDG_SNIPPET))})"


def _ddg_target(p: Piece) -> str:
    return D.let(D.first(p.inner, DDG_LINK), lambda e: (
        f"coalesce(nullif({D.attr(e, 'href')}, ''), nullif({D.attr(e, 'data-link')}, ''), {p.text(e)})"))


# --- feeds ----------------------------------------------------------------------

def reddit_layout() -> str:
    return _case(
        (D.exists_("elements", D.cls("post-link")), "'card'"),
        (D.exists_("elements", D.every(D.tag("div"), D.attr_is("slot", "overflow-menu-bar"))), "'compact'"),
        (D.exists_("elements", D.ident("header-bottom-left")), "'old'"),
        (D.exists_("elements", D.cls("styled-outbound-link")), "'new'"),
        other="'unknown'")


def _reddit_containers() -> str:
    return boxes(D.let(reddit_layout(), lambda x: _case(
        (f"{x} = 'old'", D.select(D.every(D.tag("p"), D.cls("title")))),
        (f"{x} = 'card'", D.select(D.cls("post-link"))),
        (f"{x} = 'compact'", D.select(D.tag("shreddit-post"))),
        other=D.select(D.cls("styled-outbound-link")))))


def _subreddit(p: Piece) -> D.Test:
    """Marked as such, or a span under a link under span.relative within the container."""
    own = lambda a: f"{a} >= {p.element}.pos"
    relative = D.every(D.tag("span"), D.cls("relative"))
    def chain(e: str) -> str:
        link = D.exists_(f"{e}.path", lambda a: f"{own(a)} AND {D.tag('a')(D.node(a))} AND " + D.exists_(
            f"{D.node(a)}.path", lambda r: f"{own(r)} AND {relative(D.node(r))}"))
        return f"({D.tag('span')(e)} AND {link})"
    return D.some(D.attr_is("data-click-id", "subreddit"), D.cls("subreddit"), chain)


def _reddit_parts(p: Piece) -> str:
    title = D.let(reddit_layout(), lambda x: _case(
        (f"{x} = 'old'", p.text_at(D.tag("a"))),
        (f"{x} = 'compact'", p.text_at(D.some(D.tag("a"), D.has("content-href")))),
        other=p.text(p.element)))
    return f"array({p.text_at(_subreddit(p))}, {title}, {p.text_at(REDDIT_POST)})"


def _reddit_target(p: Piece) -> str:
    return (
        f"CASE WHEN {reddit_layout()} = 'compact' THEN {D.attr(p.element, 'content-href')} "
        f"ELSE {D.attr(D.first(p.inner, D.tag('a')), 'href')} END")


def _facebook_containers() -> str:
    found = D.transform_(D.select(FACEBOOK_LINK), lambda e: D.struct(
        pos=f"coalesce({D.closest(e, D.has('data-pagelet'))}, get(reverse({e}.path), 4))", marker=f"{e}.pos"))
    return D.filter_(found, lambda b: f"{b}.pos IS NOT NULL")


def _facebook_parts(p: Piece) -> str:
    return f"array({p.text_at(FACEBOOK_AUTHOR)}, {p.text_at(FACEBOOK_MESSAGE)}, {D.trim(D.text_of(p.marker))})"


def _marker_target(p: Piece) -> str:
    return D.attr(D.node(D.closest(p.marker, D.tag("a"))), "href")


def _threads_containers() -> str:
    found = D.transform_(D.select(D.cls("x1j9u4d2")), lambda e: D.struct(
        pos=f"{e}.pos", marker=f"{D.first(D.below(e), THREADS_LINK)}.pos"))
    return D.filter_(found, lambda b: f"{b}.marker IS NOT NULL")


def _threads_parts(p: Piece) -> str:
    author = D.some(D.attr_is("data-testid", "user-name"), D.cls("x1i10hfl"))
    post = D.some(D.attr_is("data-testid", "post-text"), D.cls("x1lliihq"))
    return f"array({p.text_at(author)}, {p.text_at(post)}, {D.trim(D.text_of(p.marker))})"


def _bluesky_containers() -> str:
    post = D.attr_is("data-testid", "post")
    return ranked(
        D.every(D.tag("article"), post), D.every(D.tag("article"), D.attr_is("data-testid", "feedItem")),
        post, D.cls("post"), D.tag("article"))


def _bluesky_parts(p: Piece) -> str:
    links = f"array_join(array_remove({p.texts_at(LINK)}, ''), ' ')"
    post = D.some(D.attr_is("data-testid", "postText"), D.cls("post-text"))
    time = D.some(D.tag("time"), D.attr_is("data-testid", "timestamp"))
    return f"array({p.text_at(BLUESKY_AUTHOR)}, {p.text_at(post)}, {links}, {p.text_at(time)})"


PLATFORMS: dict[str, Platform] = {p.name: p for p in (
    Platform(
        "google", ["google.com/search", "google.com/webhp"],
        D.some(D.cls("tjvcx", "GvPZzd", "cHaqb"), D.cls("WlydOe"), GOOGLE_TAB),
        _google_containers, _google_parts, 10, _google_target,
    ),
    Platform(
        "duckduckgo", ["duckduckgo.com"], D.some(D.cls("wLL07_0Xnd1QZpzpfR4W"), DDG_TAB),
        _ddg_containers, _ddg_parts, target=_ddg_target,
    ),
    Platform(
        "facebook", ["facebook.com", "fb.com"], D.some(FACEBOOK_LINK, D.has("data-pagelet")),
        _facebook_containers, _facebook_parts, target=_marker_target,
    ),
    Platform(
        "reddit", ["reddit.com"],
        D.some(D.cls("post-link"), D.tag("shreddit-post"), D.cls("styled-outbound-link"), D.ident("header-bottom-left")),
        _reddit_containers, _reddit_parts, target=_reddit_target,
    ),
    Platform(
        "threads", ["threads.net"], D.some(D.cls("x1j9u4d2"), THREADS_LINK), _threads_containers, _threads_parts,
    ),
    Platform(
        "bluesky", ["bsky.app", "bluesky.social"],
        D.some(D.attr_is("data-testid", "post"), D.every(D.tag("article"), D.attr_is("data-testid", "feedItem"))),
        _bluesky_containers, _bluesky_parts,
    ),
)}


def platform_of(platforms: dict[str, Platform], url: str = "url") -> str:
    """SQL for the first platform whose URL part and marker element are both there."""
    branches = []
    for name, p in platforms.items():
        in_url = " OR ".join(f"contains(lower({url}), '{part}')" for part in p.url_parts)
        branches.append((f"({in_url}) AND {D.exists_('elements', p.marker)}", f"'{name}'"))
    return _case(*branches, other="cast(null as string)") if branches else "cast(null as string)"
