"""Page extraction on hand-written markup."""

import pytest
from pyspark.sql import functions as F

from pagegauge.operators import chunks as C, extract as X
from pagegauge.operators.sponsored import sponsored_panels, sponsored_posts
from pagegauge.sources.html import Page

LONG = "A sentence about the town and its river that goes on for quite a while, so that it is long enough to count. "


def pages(spark, *rows):
    return spark.createDataFrame([(i, url, html) for i, (url, html) in enumerate(rows)], "page_id long, url string, html string")


def cut(spark, url, html, **options):
    rows = X.extract_chunks(pages(spark, (url, html)), **options).orderBy("chunk_pos").collect()
    return rows


def test_reader_repairs_markup():
    page = Page("<p>one<p>two<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></div><b>x")
    assert page.tag == ["html", "body", "p", "p", "ul", "li", "li", "table", "tr", "td", "td", "tr", "td", "b"]
    depth = [len(p) for p in page.path]
    assert depth[2:7] == [2, 2, 2, 3, 3]
    assert page.texts == ["one", "two", "a", "b", "1", "2", "3", "x"]
    odd = Page('<!-- <p>no</p> --><script>"<p>"</script><a title="a > b" HREF=x>t</a><br/><a title="open>u</a>')
    assert odd.tag[:5] == ["html", "head", "script", "body", "a"]
    assert odd.attrs[4] == {"title": "a > b", "href": "x"}
    assert Page("").tag == ["html"] and Page("plain").texts == ["plain"]


def test_deep_nesting_is_bounded():
    page = Page("<div>" * 5000 + "x")
    assert max(len(p) for p in page.path) <= 512 and page.texts == ["x"]


def test_article_with_unwanted_parts(spark):
    html = f"""<html><body><article id="s1" class="story" data-id="7"><h1>The  title</h1><nav>menu</nav>
      <p>{LONG}<a href="/more"> read
      on </a><a href="https://other.org/x">other</a></p><div class="ad-box">buy</div>
      <img src="pic.png" alt="p"><img src="data:image/png;x"></article></body></html>"""
    row, = cut(spark, "https://news.org/a/b", html, with_html=True)
    assert row.title == "The title" and "menu" not in row.text and "buy" not in row.text
    assert [(l.url, l.text, l.is_external) for l in row.links] == [
        ("/more", "read\n      on", False), ("https://other.org/x", "other", True)]
    assert [i.src for i in row.images] == ["https://news.org/a/pic.png"]
    assert row.metadata.id == "s1" and row.metadata.data_attributes == {"data-id": "7"}
    assert row.xpath == "/html/body/article" and row.tags == ["article"]
    assert "menu" not in row.html and "<h1>The  title</h1>" in row.html


def test_hidden_short_and_repeated_articles(spark):
    html = (f"<article hidden>{LONG}</article><article>short</article><article>{LONG}first</article>"
            f"<div class='post'>{LONG}first</div><article style='color:red; display : none'>{LONG}</article>")
    rows = cut(spark, "https://x.org", f"<body>{html}</body>")
    assert [r.xpath for r in rows] == ["/html/body/article[3]"]


def test_social_markup_only_without_articles(spark):
    html = f'<div class="comment">{LONG}one</div><div data-testid="x-tweet">two {LONG}</div>'
    rows = cut(spark, "https://x.org", html)
    # In the order of the selectors: the tweet comes first.
    assert [r.text[:3] for r in rows] == ["two", "A s"] and rows[0].tags == ["other"]


def test_sections_hold_every_text_once(spark):
    html = f"""<main><p>intro {LONG}</p><h2>First</h2><div>{LONG}<p>inner</p></div><script>var x;</script><h3>Second</h3><p>short</p></main>"""
    rows = cut(spark, "https://x.org", html)
    assert [r.heading for r in rows] == [None, "First"]
    assert rows[1].text == f"First {LONG.strip()} inner" and rows[1].xpath == "/html/body/main/h2"
    assert rows[0].xpath == "/html/body/main"


def test_paragraphs_are_packed(spark):
    one = "x" * 90
    html = f"<div id=content><p>{one}</p><p> </p><p>{one}</p><p>{one}</p><p>{'y' * 120}</p></div>"
    rows = cut(spark, "https://x.org", html)
    assert [len(r.text) for r in rows] == [272, 120]
    assert rows[0].xpath.endswith("/p[4]") and rows[1].xpath == "/html/body/div"


def test_adverts_are_left_out_unless_wanted(spark):
    html = f"""<div class="promo"><section><div class="post">{LONG}a</div></section></div>
      <div class="post load adtqx">{LONG}b</div><div class="post" data-ad="true">c {LONG}</div><div class="post">d sponsored {LONG}</div>"""
    assert [r.text[-1] for r in cut(spark, "https://x.org", html)] == ["b"]
    rows = X.extract_chunks(pages(spark, ("https://x.org", html)), include_ads=True)
    content, ads = C.partition_ads(rows)
    # A parent's class hides an element while cutting; the split itself looks at the chunk only.
    assert content.count() == 2 and ads.count() == 2
    assert all(r.tags[-1] == "advert" for r in ads.collect())


def test_ad_rules(spark):
    cases = [
        ("x", ["ad"], None, {}, [], True), ("x", ["ad-banner"], None, {}, [], True), ("x", ["adtqday"], None, {}, [], False),
        ("x", ["load"], None, {}, [], False), ("x", ["My_PROMO"], None, {}, [], True), ("x", [], "top-advert", {}, [], True),
        ("x", [], None, {"data-ad": "true"}, [], True), ("x", [], None, {"data-ad": "no"}, [], False), ("x", [], None, {}, ["sponsored"], True),
    ]
    df = spark.createDataFrame(cases, "text string, classes array<string>, id string, data map<string,string>, up array<string>, want boolean")
    got = df.select(C.ad_element(F.col("classes"), F.col("id"), F.col("data"), F.col("up")), "want").collect()
    assert all(r[0] == r[1] for r in got)


GOOGLE = f"""<div class="MgQdud">All</div><div class="g"><a href="https://r.org/1"><h3>Result</h3></a><cite>r.org</cite>
  <span class="VuuXrf">Site</span><div class="VwiC3b">{LONG}</div><img alt="pic"><div class="KTAFWb"><a href="/r">rel</a></div></div>
  <div class="g">no title {LONG}</div><div class="ddkIM c30Ztd"><h3>Card</h3><a href="/c">{LONG}</a></div>"""
PLATFORM_HTML = [
    ("google", "https://www.google.com/search?q=a", GOOGLE,
     [f"Result\nSite\nResult\n{LONG.strip()}\npic\nrel", f"Card\n{LONG.strip()}"], ["https://r.org/1", "/c"]),
    ("google", "https://www.google.com/search?q=a", f'<i class="MgQdud">News</i><a class="WlydOe"><h3>N</h3><b class="st">{LONG}</b></a><div class="g"><h3>x</h3><a href="">{LONG}</a></div>',
     [f"N\n{LONG.strip()}"], [None]),
    ("google", "https://www.google.com/search?q=a", f'<i class="MgQdud">Videos</i><div class="iUh30"><h3>V</h3><b class="s">{LONG}</b></div>',
     [f"V\n{LONG.strip()}"], [None]),
    ("duckduckgo", "https://duckduckgo.com/?q=a", f'<b class="SnptgjT2zdOhGYfNng6g">All News</b><div class="result--news"><h2>N</h2><a href="u">{LONG}</a></div>',
     [f"{LONG.strip()}\nN"], ["u"]),
    ("duckduckgo", "https://duckduckgo.com/?q=a", f'<b class="wLL07_0Xnd1QZpzpfR4W"></b><article>{LONG}</article><div id="links"><article><h2>T</h2><a href="u">{LONG}</a></article></div>',
     [f"{LONG.strip()}\nT"], ["u"]),
    ("reddit", "https://old.reddit.com/r/x", f'<i id="header-bottom-left"></i><p class="title"><a href="/t">{LONG}</a></p>', [LONG.strip()], ["/t"]),
    ("reddit", "https://www.reddit.com/r/x", f'<div class="post-link"><span class="relative"><a><span>r/x</span></a></span>{LONG}</div>',
     [f"r/x\nr/x{LONG.strip()}"], [None]),
    ("reddit", "https://www.reddit.com/r/x", f'<a class="styled-outbound-link">{LONG}</a>', [LONG.strip()], [None]),
    ("facebook", "https://www.facebook.com/", f'<div data-pagelet="F"><b class="x1i10hfl">Jane</b><div class="userContent">{LONG}</div><a href="/l"><i class="x1e56ztr xtvhhri">l.org</i></a></div>',
     [f"Jane\n{LONG.strip()}\nl.org"], ["/l"]),
    ("threads", "https://www.threads.net/", f'<div class="x1j9u4d2"><b class="x1i10hfl">Al</b><p data-testid="post-text">{LONG}</p><i class="x1lliihq x193iq5w x6ikm8r x10wlt62 xlyipyv xuxw1ft">l.org</i></div>',
     [f"Al\n{LONG.strip()}\nl.org"], [None]),
    ("bluesky", "https://bsky.app/", f'<article data-testid="feedItem"><b class="author-name">Bo</b><p class="post-text">{LONG}</p><a href="/a">x</a><a href="/b"> y</a><time>2h</time></article>',
     [f"Bo\n{LONG.strip()}\nx y\n2h"], [None]),
]


def test_platforms(spark):
    rows = X.extract_chunks(pages(spark, *[(url, html) for _, url, html, _, _ in PLATFORM_HTML])).orderBy("page_id", "chunk_pos").collect()
    for i, (name, _, _, texts, targets) in enumerate(PLATFORM_HTML):
        mine = [r for r in rows if r.page_id == i]
        assert [r.text for r in mine] == texts, (i, name)
        assert {r.platform for r in mine} == {name}
        assert [r.target_url for r in mine] == targets
        assert mine[0].tags[0] == ("search_result" if name in ("google", "duckduckgo") else "post")


def test_platform_without_hits_falls_back(spark):
    row, = cut(spark, "https://www.reddit.com/r/x", f'<i class="post-link">short</i><article>{LONG}</article>')
    assert row.platform is None and row.tags == ["article"]
    found = X.detect_platform(pages(spark, ("https://bsky.app", "<p>"), ("https://bsky.app", '<p data-testid="post">'))).orderBy("page_id")
    assert [r.platform for r in found.collect()] == [None, "bluesky"]


FEED = """<main><div role="feed">
  <div data-pagelet="FeedUnit_7"><span>Sponsored</span><p>Boots, half price</p></div>
  <div data-pagelet="FeedUnit_8"><h4>Choir</h4><p>We sing on Monday</p></div>
  <div role="article"><p>My cat was sponsored by nobody, said Lee</p></div>
  <div role="article"><div><div><a aria-label="Sponsored" href="/x">i</a></div></div><p>Nested mark</p></div>
  <div role="article"><p>Garden club</p></div>
  <div data-pagelet="FeedUnit_9"><span style="display:flex"><span>Spo</span><span>nso</span><span>red</span></span><p>Pieces</p></div>
</div></main><div role="complementary"><section><div><span>Sponsored</span></div><a href="https://l.facebook.com/l.php?u=7">y</a></section></div>"""


def test_sponsored_feed(spark):
    df = pages(spark, ("https://www.facebook.com/", FEED), ("https://other.org/", FEED))
    posts = {r.xpath for r in sponsored_posts(df).collect()}
    assert posts == {f"/html/body/main/div/div{i}" for i in ("", "[4]", "[6]")}
    panels = sponsored_panels(df).collect()
    assert [(r.page_id, r.xpath) for r in panels] == [(0, "/html/body/div")]


def test_page_metadata(spark):
    html = f"""<html><head><title> A  page </title><meta name="author" content="Ann"><meta property="og:site_name" content="S">
      <meta name="description" content="D"></head><body><div class="content">no</div><main>{LONG}<script>x</script></main>
      <a href="/a">a</a><a href="#b">b</a><a href="mailto:x">c</a><a href="https://o.org">d</a><img src="//i.org/p.png"></body></html>"""
    row = X.extract_page_metadata(pages(spark, ("https://www.site.org/p?q#f", html))).first()
    assert (row.title, row.author, row.site_name, row.description, row.published_time) == ("A page", "Ann", "S", "D", "")
    assert row.text == LONG.strip() and row.domain == "www.site.org"
    assert [(l.url, l.is_external) for l in row.links] == [
        ("https://www.site.org/a", False), ("https://www.site.org/p?q#b", False), ("https://o.org/", True)]
    assert row.images[0].src == "https://i.org/p.png"


@pytest.mark.parametrize("n", [1, 3])
def test_limit(spark, n):
    html = "".join(f"<article>{i} {LONG}</article>" for i in range(5))
    assert [r.chunk_pos for r in cut(spark, "https://x.org", html, max_chunks=n)] == list(range(n))
    assert cut(spark, "https://x.org", None) == []


def test_nothing_is_cut_by_default(spark):
    alike = "same beginning " * 20
    html = "".join(f"<article>{alike} {LONG} number {i}</article>" for i in range(60))
    assert len(cut(spark, "https://x.org", html)) == 60


def test_links_images_and_paths_are_whole(spark):
    links = "".join(f'<a href="/l{i}">{"word " * 30}{i}</a>' for i in range(30))
    images = "".join(f'<img src="/i{i}.png">' for i in range(12))
    row, = cut(spark, "https://x.org", f"<article>{LONG}{links}{images}</article>")
    assert [l.text.split()[-1] for l in row.links] == [str(i) for i in range(30)] and len(row.images) == 12
    row, = cut(spark, "https://x.org", f"<article>{LONG}{links}{images}</article>", max_links=3, max_images=2, link_chars=10)
    assert [l.text for l in row.links] == ["word word "] * 3 and len(row.images) == 2
    page = pages(spark, ("https://x.org", f"<main>{LONG}{links}{images}</main>"))
    assert [len(x) for x in X.extract_page_metadata(page).select("links", "images").first()] == [30, 12]
    deep = "<div>" * 80 + f"<article>{LONG}</article>" + "</div>" * 80
    row, = cut(spark, "https://x.org", deep)
    assert row.xpath == "/html/body" + "/div" * 80 + "/article"


def test_own_platform_table(spark):
    from pagegauge.operators import dom as D
    from pagegauge.operators.platforms import PLATFORMS, Platform, boxes

    mine = Platform(
        "board", ["board.example"], D.cls("thread-item"), lambda: boxes(D.select(D.cls("thread-item"))),
        lambda p: f"array({p.text_at(D.tag('h4'))}, {p.text_at(D.cls('said'))})")
    html = f'<div class="thread-item"><h4>Head</h4><p class="said">{LONG}</p></div>'
    row, = cut(spark, "https://board.example/1", html, platforms={**PLATFORMS, "board": mine})
    assert (row.platform, row.text, row.tags) == ("board", f"Head\n{LONG.strip()}", ["other"])
