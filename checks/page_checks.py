"""Checked queries over pages and documents: text, titles, chunks, adverts, dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.oracle import SQL, flat, lit, trim, u16
from checks.queries import query
from pagegauge import fixed_values as V
from pagegauge.functions import text as T, urls as U
from pagegauge.operators import chunks as C, extract as X

STRIP = "regexp_replace({0}, '<[^>]+>', ' ', 'g')"


def decode(x: str) -> str:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


def inner(tag: str, x: str = "html") -> str:
    return f"regexp_extract({x}, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)"


TITLE = flat(decode(STRIP.format(f"coalesce(nullif({inner('title')}, ''), {inner('h1')})")))
NO_CODE = "html"
for _tag in ("script", "style", "noscript"):
    NO_CODE = f"regexp_replace({NO_CODE}, '(?is)<{_tag}.*?</{_tag}>', ' ', 'g')"
EXCERPT = flat(decode(STRIP.format(NO_CODE)))
# Text of an element whose markup holds no unwanted parts: tags vanish, entities decode.
ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
TAGLESS = "replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&quot;', '\"'), '&amp;', '&')"
ARTICLE_TEXT = trim(TAGLESS.format(ARTICLE))
FIRST_SENTENCE = lambda x: (
    f"coalesce(nullif({trim(f'''regexp_extract({flat(x)}, '(?s)^(.+?[.!?])(?: |\\z)', 1)''')}, ''), nullif({flat(x)}, ''))")
HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
SIGNATURE = trim("lower(text)")


# --- text from markup ---------------------------------------------------------

@query
def page_text(spark, sf):
    return C.html_to_text(I.pages(spark, sf)).select("page_id", "title", "text")


SQL["page_text"] = f"SELECT page_id, {TITLE} AS title, {EXCERPT} AS text FROM pages"


@query
def page_titles(spark, sf):
    pages = I.pages(spark, sf).withColumn("text", C.html_text(F.col("html")))
    return C.infer_title(pages.select("page_id", "html", "text")).select("page_id", "title")


SQL["page_titles"] = f"""SELECT page_id, coalesce({', '.join(f"nullif({flat(STRIP.format(inner(h)))}, '')" for h in ('h1', 'h2', 'h3'))},
    {FIRST_SENTENCE(EXCERPT)}) AS title FROM pages"""


@query
def document_titles(spark, sf):
    return C.infer_title(I.chunks(spark, sf).select("doc_id", "title", "text")).select("doc_id", "title")


SQL["document_titles"] = f"""SELECT doc_id, coalesce(nullif({flat('title')}, ''), {FIRST_SENTENCE('text')}) AS title
    FROM ({I.CHUNKS})"""


@query
def text_functions(spark, sf):
    text = F.col("text")
    return I.documents(spark, sf).select(
        "doc_id", T.utf16_length(text).alias("units"), T.longer_than(text, 500).alias("long"),
        T.truncate(text, 100, "...").alias("cut"), T.first_line(text).alias("line"),
        T.first_sentence(text).alias("sentence"), T.format_count(F.col("n_chars")).alias("badge"),
        F.md5(T.collapse_space(text)).alias("flat_md5"))


SQL["text_functions"] = f"""SELECT doc_id, {u16('text')}::INT AS units, {u16('text')} > 500 AS long,
    concat(substr(text, 1, 100), CASE WHEN length(text) > 100 THEN '...' ELSE '' END) AS cut,
    {flat("split_part(text, chr(10), 1)")} AS line, {FIRST_SENTENCE('text')} AS sentence,
    CASE WHEN n_chars <= 0 THEN '' WHEN n_chars > 999 THEN '999+' ELSE n_chars::VARCHAR END AS badge,
    md5({flat('text')}) AS flat_md5 FROM documents"""


@query
def url_functions(spark, sf):
    url = F.col("url")
    link = F.concat(F.lit("../x/./y?q="), F.col("page_id").cast("string"))
    return I.table(spark, sf, "pages").select(
        "page_id", U.host_of(url).alias("host"), U.url_origin(url).alias("origin"), U.url_path(url).alias("path"),
        U.url_key(url).alias("key"), U.url_resolve(F.lit("/top#a"), url).alias("from_root"),
        U.url_resolve(link, F.concat(U.url_origin(url), F.lit("/a/b/c.html?z#t"))).alias("from_here"),
        U.url_resolve(F.lit("//other.example.com"), url).alias("other"),
        U.url_resolve(F.lit("#top"), url).alias("anchor"),
        U.is_external(F.lit("http://elsewhere.example"), U.url_origin(url)).alias("external"))


ORIGIN = f"concat(lower(split_part(url, '://', 1)), '://', {HOST})"
PATH = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"
SQL["url_functions"] = f"""SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS host, {ORIGIN} AS origin, {PATH} AS path,
    concat({ORIGIN}, {PATH}, regexp_extract(url, '(\\?[^#]*)', 1)) AS key, concat({ORIGIN}, '/top#a') AS from_root,
    concat({ORIGIN}, '/a/x/y?q=', page_id) AS from_here, concat(split_part(url, '://', 1), '://other.example.com/') AS other,
    NULL::VARCHAR AS anchor, true AS external FROM pages"""


@query
def chunk_fingerprint(spark, sf):
    pages = C.html_to_text(I.pages(spark, sf))
    return pages.select(
        "page_id", T.fingerprint(F.col("url"), F.col("title")).alias("fingerprint"),
        T.hash31(F.col("title")).alias("hash31"))


UNITS = """flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '' THEN []::BIGINT[] WHEN unicode(c) > 65535 THEN
    [(55296 + (unicode(c) - 65536) // 1024)::BIGINT, (56320 + (unicode(c) - 65536) % 1024)::BIGINT] ELSE [unicode(c)::BIGINT] END))"""
SQL["chunk_fingerprint"] = f"""WITH p AS (SELECT page_id, url, {TITLE} AS title FROM pages)
    SELECT page_id, format('{{:08x}}', list_reduce(list_prepend(2166136261::BIGINT, {UNITS.format('concat(url, title)')}),
      lambda h, u: (xor(h, u) * 16777619) % 4294967296)) AS fingerprint,
    (list_reduce(list_prepend(0::BIGINT, {UNITS.format('title')}), lambda h, u: (h * 31 + u) % 4294967296) + 2147483648)
      % 4294967296 - 2147483648 AS hash31 FROM p"""


# --- dedup and limits -------------------------------------------------------------

@query
def dedup_documents(spark, sf):
    return C.dedup_chunks(I.documents(spark, sf), [], ["doc_id"]).select("doc_id")


SQL["dedup_documents"] = f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {SIGNATURE}"


@query
def dedup_by_source(spark, sf):
    return C.dedup_chunks(I.documents(spark, sf), ["source"], ["doc_id"]).groupBy("source").agg(
        F.count("*").alias("n"))


SQL["dedup_by_source"] = f"""SELECT source, count(*) AS n FROM (SELECT DISTINCT source, {SIGNATURE} AS sig FROM documents) GROUP BY source"""


@query
def limit_per_source(spark, sf):
    return C.limit_per_page(I.documents(spark, sf), ["source"], ["doc_id"], 5, min_text=100).select("source", "doc_id")


SQL["limit_per_source"] = f"""SELECT source, doc_id FROM documents WHERE {u16('text')} >= 100
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5"""


@query
def turn_sections(spark, sf):
    turns = I.table(spark, sf, "conversations")
    numbered = C.section_number(turns, ["conv_id"], "turn", F.col("role") == "user", block=2)
    return numbered.groupBy("conv_id", "section").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


SQL["turn_sections"] = """SELECT conv_id, section, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT *,
    sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS section
    FROM conversations) GROUP BY conv_id, section"""


@query
def chunk_tags(spark, sf):
    """Content and advert tags by platform, on chunks with and without tags of their own."""
    docs = I.chunks(spark, sf)
    platform = F.element_at(F.array(*[F.lit(p) for p in ("google", "reddit", "none")]), (F.col("doc_id") % 3 + 1).cast("int"))
    own = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("comment"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("advert")))
    tagged = C.tag_chunks(docs.select("doc_id", "text", platform.alias("platform"), own.alias("tags")))
    return tagged.select("doc_id", joined("tags").alias("tags"))


_OWN = "CASE doc_id % 3 WHEN 0 THEN 'search_result' WHEN 1 THEN 'post' ELSE 'other' END"
_SPOKEN = " OR ".join(f"contains(lower(text), {lit(w)})" for w in V.AD_TEXT_WORDS)
SQL["chunk_tags"] = f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('comment', CASE WHEN {_SPOKEN} THEN ',advert' ELSE '' END)
    WHEN doc_id % 4 = 1 THEN CASE WHEN doc_id % 3 = 2 THEN 'advert,other' ELSE concat({_OWN}, ',advert') END
    ELSE concat({_OWN}, CASE WHEN {_SPOKEN} THEN ',advert' ELSE '' END) END AS tags FROM ({I.CHUNKS})"""


@query
def page_status(spark, sf):
    """Status lines of pages whose counts and faults come from the key."""
    from pagegauge.operators import rollup as R
    n = F.col("page_id")
    states = I.table(spark, sf, "pages").select(
        "page_id", (n % 9 != 0).alias("site_enabled"), F.when(n % 7 == 0, "boom").alias("error"),
        F.when(n % 5 > 0, n % 5).alias("n_chunks"), (n * n % 1100).alias("neutralised"),
        R.ads_hidden(n % 3, F.when(n % 2 == 0, n % 4)).alias("ads_hidden"),
        R.verdict((n % 11) / 10).alias("overall"), F.when(n % 13 == 0, "analyzing").alias("status"), (n % 100).alias("progress"))
    return R.page_status(states).select("page_id", "status", "flagged", "badge", "color", "line")


SQL["page_status"] = """WITH a AS (SELECT page_id AS n, greatest(page_id % 3, CASE WHEN page_id % 2 = 0 THEN page_id % 4 ELSE 0 END) AS ads, page_id * page_id % 1100 AS hits,
      CASE WHEN page_id % 9 = 0 THEN 'excluded' WHEN page_id % 13 = 0 THEN 'analyzing' WHEN page_id % 7 = 0 THEN 'error' WHEN page_id % 5 = 0 THEN 'no_chunks' ELSE 'completed' END AS status FROM pages)
    SELECT n AS page_id, status, hits + ads AS flagged, CASE status WHEN 'error' THEN '!' WHEN 'analyzing' THEN '…' WHEN 'completed' THEN
        CASE WHEN hits + ads = 0 THEN '' WHEN hits + ads > 999 THEN '999+' ELSE (hits + ads)::VARCHAR END ELSE '' END AS badge,
      CASE status WHEN 'error' THEN 'red' WHEN 'analyzing' THEN 'blue' WHEN 'completed' THEN CASE WHEN n % 11 > 7 THEN 'red' WHEN n % 11 > 4 THEN 'orange' ELSE 'green' END ELSE 'grey' END AS color,
      concat('Page check', CASE status WHEN 'excluded' THEN ' is off for this site' WHEN 'error' THEN ': analysis failed' WHEN 'no_chunks' THEN ': no content to analyze'
        WHEN 'analyzing' THEN concat(': analyzing page (', n % 100, '%)') ELSE CASE WHEN hits + ads = 0 THEN ': analysis complete, nothing flagged'
          ELSE concat(': ', concat_ws(', ', CASE WHEN hits > 0 THEN concat(hits, ' labelled') END, CASE WHEN ads > 0 THEN concat(ads, ' ads hidden') END), ' on this page') END END) AS line FROM a"""


# --- chunks from pages --------------------------------------------------------------

@query
def page_chunks(spark, sf):
    return X.extract_chunks(I.pages(spark, sf)).select(
        "page_id", "chunk_pos", "text", "title", "domain", "xpath", joined("tags").alias("tags"))


def joined(col, sep=","):
    return F.array_join(col, sep)


H1 = "regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)"
SQL["page_chunks"] = f"""SELECT page_id, 0 AS chunk_pos, text, coalesce(nullif({flat(TAGLESS.format(H1))}, ''),
      {FIRST_SENTENCE('text')}) AS title, regexp_replace({HOST}, '^www\\.', '') AS domain, '/html/body/article' AS xpath,
    'article' AS tags FROM (SELECT *, {ARTICLE_TEXT} AS text FROM pages) WHERE {u16('text')} >= 100"""


@query
def page_metadata(spark, sf):
    meta = X.extract_page_metadata(I.pages(spark, sf))
    return meta.select(
        "page_id", "title", "domain", "text", F.size("images").alias("n_images"),
        F.array_join(F.transform("links", lambda x: x["text"]), "|").alias("link_texts"),
        F.array_join(F.transform("links", lambda x: x["url"]), "|").alias("links"))


_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)"
_TEXTS = "regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)"
SQL["page_metadata"] = f"""SELECT page_id, {flat(TAGLESS.format(inner('title')))} AS title, {HOST} AS domain,
    {ARTICLE_TEXT} AS text, 0 AS n_images,
    array_to_string(list_transform({_TEXTS}, lambda x: substr({trim(TAGLESS.format('x'))}, 1, 100)), '|') AS link_texts,
    array_to_string(list_transform({_HREFS}, lambda x: concat({ORIGIN}, {TAGLESS.format('x')})), '|') AS links FROM pages"""


@query
def chunks_of_pages(spark, sf):
    """Page p owns the documents with its id, and those stored under its URL."""
    pages = I.table(spark, sf, "pages")
    n = F.lit(7)
    stored = pages.select(
        F.col("page_id").alias("url_of"), "url").withColumn("doc_id", F.explode(F.array(F.col("url_of"), F.col("url_of") * n)))
    docs = I.table(spark, sf, "documents").join(stored, "doc_id", "left").select(
        "doc_id", (F.col("doc_id") + 1).alias("page_id"), "url")
    return C.chunks_of_pages(pages, docs, ["doc_id"]).select("of_page", "doc_id")


SQL["chunks_of_pages"] = """WITH s AS (SELECT url, unnest([page_id, page_id * 7]) AS doc_id FROM pages),
    d AS (SELECT doc_id, doc_id + 1 AS page_id, url FROM documents LEFT JOIN s USING (doc_id))
    SELECT DISTINCT p.page_id AS of_page, d.doc_id FROM pages p JOIN d ON p.url = d.url OR p.page_id = d.page_id"""


_PAGES_N = "(SELECT count(*) * 6 // 5 + 1 FROM pages)"


@query
def chunk_page_metadata(spark, sf):
    pages = C.html_to_text(I.pages(spark, sf)).withColumn("domain", U.host_of(F.col("url")))
    # More page numbers than there are pages, so some chunks have no page.
    docs = I.chunks(spark, sf).select(
        "doc_id", (F.col("doc_id") % (pages.count() * 6 // 5 + 1)).alias("page_id"), T.nullif_blank(F.col("title")).alias("title"))
    return C.with_page_metadata(docs, pages).select("doc_id", "page_id", "url", "title", "domain")


SQL["chunk_page_metadata"] = f"""WITH p AS (SELECT page_id, url, {TITLE} AS page_title, regexp_replace({HOST}, '^www\\.', '') AS domain FROM pages)
    SELECT doc_id, doc_id % {_PAGES_N} AS page_id, url, coalesce(nullif(title, ''), page_title) AS title, p.domain
    FROM ({I.CHUNKS}) c LEFT JOIN p ON doc_id % {_PAGES_N} = p.page_id"""


# --- platform pages built from the documents -----------------------------------------
# Every ten documents make a search page, a feed page, and so on.

def esc(col):
    """Text as markup. Line breaks stay, so the text comes back unchanged."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def platform_pages(spark, sf, item, head, tail, url):
    """Pages of ten items each; `item` is the markup of one document."""
    docs = I.chunks(spark, sf).select("doc_id", "title", "text", "domain", "lang", item.alias("item"))
    # Ten rows per page: the lists are bounded by construction.
    pages = docs.groupBy(F.floor(F.col("doc_id") / 10).alias("page_id")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), "\n")
    return pages.select("page_id", F.lit(url).alias("url"), F.concat(F.lit(head), body, F.lit(tail)).alias("html"))


PLATFORM_COLUMNS = ["page_id", "chunk_pos", "platform", "text", "target_url", "tags", "xpath"]


def _platform(spark, sf, item, head, tail, url, **options):
    chunks = X.extract_chunks(platform_pages(spark, sf, item, head, tail, url), include_ads=True, **options)
    return chunks.select(
        "page_id", "chunk_pos", "platform", "text", "target_url", joined("tags").alias("tags"), "xpath")


def _platform_sql(text: str, target: str, xpath: str, platform: str, tag: str, least: int = 100, keep: str = "true",
                  number: str = "row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id)") -> str:
    """Dedup by the whole text within the page, then number the chunks."""
    advert = " OR ".join(f"contains(lower(text), {lit(w)})" for w in V.AD_TEXT_WORDS)
    sig = trim("lower(text)")
    return f"""WITH raw AS (SELECT doc_id, doc_id // 10 AS page_id, {number} AS nr, * EXCLUDE (doc_id) FROM ({I.CHUNKS})),
      t AS (SELECT *, {trim(text)} AS chunk FROM raw WHERE {keep}),
      u AS (SELECT page_id, doc_id, nr, chunk AS text, {target} AS target_url FROM t WHERE {u16('chunk')} >= {least}),
      d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY page_id, {sig} ORDER BY doc_id) = 1)
      SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY doc_id) - 1)::INT AS chunk_pos, {lit(platform)} AS platform,
        text, target_url, concat({lit(tag)}, CASE WHEN {advert} THEN ',advert' ELSE '' END) AS tags, {xpath} AS xpath FROM d"""


def _lines(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(f"nullif({trim(p)}, '')" for p in parts) + ")"


@query
def search_page_chunks(spark, sf):
    item = F.concat(
        F.lit('<div class="g"><a href="https://r.example/'), F.col("doc_id").cast("string"), F.lit('"><h3>'), esc(F.col("title")),
        F.lit('</h3></a><span class="VuuXrf">'), esc(F.col("domain")), F.lit("</span><cite>r.example</cite><script>x=1</script>"),
        F.lit('<div class="VwiC3b st">'), esc(F.col("text")), F.lit('</div><img alt=" a picture " src="/i.png">'),
        F.lit('<div class="KTAFWb"><a href="/m">more</a></div></div>'))
    return _platform(spark, sf, item, '<html><body><div class="MgQdud">All</div>', "</body></html>",
                     "https://www.google.com/search?q=x")


_DIV = lambda n: f"concat('/html/body/div[', {n} + 1, ']')"
# The first link of a result is its title link.
SQL["search_page_chunks"] = _platform_sql(
    _lines("title", "domain", "title", "text", "'a picture'", "'more'"), "concat('https://r.example/', doc_id)", _DIV("nr"),
    "google", "search_result")


@query
def result_list_chunks(spark, sf):
    item = F.concat(
        F.lit('<article data-testid="result"><h2><a data-testid="result-title-a" href="https://d.example/'),
        F.col("doc_id").cast("string"), F.lit('">'), esc(F.col("title")), F.lit('</a></h2><span class="OQ_6vPwNhCeusNiEDcGp">'),
        esc(F.col("domain")), F.lit('</span><div data-result="snippet">'), esc(F.col("text")), F.lit("</div></article>"))
    return _platform(spark, sf, item, '<html><body><ul class="SnptgjT2zdOhGYfNng6g"></ul>', "</body></html>",
                     "https://duckduckgo.com/?q=x")


_NTH = lambda tag: f"concat('/html/body/{tag}', CASE WHEN nr > 1 THEN concat('[', nr, ']') ELSE '' END)"
SQL["result_list_chunks"] = _platform_sql(
    _lines("domain", "title", "title", "text"), "concat('https://d.example/', doc_id)", _NTH("article"),
    "duckduckgo", "search_result")


@query
def forum_chunks(spark, sf):
    item = F.concat(
        F.lit('<shreddit-post content-href="https://f.example/'), F.col("doc_id").cast("string"),
        F.lit('"><span class="relative"><a href="/r/x"><span>'), F.col("lang"), F.lit("</span></a></span>"),
        F.lit('<div slot="overflow-menu-bar"></div><div class="md">'), esc(F.col("text")), F.lit("</div></shreddit-post>"))
    return _platform(spark, sf, item, "<html><body>", "</body></html>", "https://www.reddit.com/r/x")


SQL["forum_chunks"] = _platform_sql(
    _lines("lang", "lang", "text"), "concat('https://f.example/', doc_id)", _NTH("shreddit-post"), "reddit", "post")


@query
def microblog_chunks(spark, sf):
    item = F.concat(
        F.lit('<div class="x1j9u4d2"><span class="x1i10hfl">@'), F.col("lang"), F.lit('</span><p data-testid="post-text">'),
        esc(F.col("text")), F.lit('</p><span class="x1lliihq x193iq5w x6ikm8r x10wlt62 xlyipyv xuxw1ft">'),
        F.col("domain"), F.lit("</span></div>"))
    return _platform(spark, sf, item, "<html><body>", "</body></html>", "https://www.threads.net/@x")


SQL["microblog_chunks"] = _platform_sql(
    _lines("concat('@', lang)", "text", "domain"), "NULL::VARCHAR", _NTH("div"), "threads", "post")


@query
def sky_chunks(spark, sf):
    item = F.concat(
        F.lit('<article data-testid="feedItem"><b data-testid="authorName">'), F.col("lang"), F.lit("</b>"),
        F.lit('<div class="post-text">'), esc(F.col("text")), F.lit('</div><a href="https://s.example">link</a><a href="#"> two </a>'),
        F.lit("<time>1h</time></article>"))
    return _platform(spark, sf, item, "<html><body>", "</body></html>", "https://bsky.app/")


SQL["sky_chunks"] = _platform_sql(
    _lines("lang", "text", "'link two'", "'1h'"), "NULL::VARCHAR", _NTH("article"), "bluesky", "post")


def feed_pages(spark, sf):
    """Feed pages: every third post is sponsored, with a side panel on every page."""
    sponsored = F.col("doc_id") % 3 == 0
    label = F.when(F.col("doc_id") % 2 == 0, '<a aria-label="Sponsored" href="#">Brand</a>').otherwise(
        '<span style="display: flex"><span>S</span><span>pon</span><span>sored</span></span>')
    item = F.concat(
        F.lit('<div data-pagelet="FeedUnit_'), F.col("doc_id").cast("string"), F.lit('"><i class="x1i10hfl">'), F.col("lang"),
        F.lit("</i>"), F.when(sponsored, label).otherwise(""), F.lit('<div data-testid="post_message">'), esc(F.col("text")),
        F.lit('</div><a href="https://n.example/'), F.col("doc_id").cast("string"), F.lit('"><span class="x1e56ztr xtvhhri">'),
        F.col("domain"), F.lit("</span></a></div>"))
    side = '<div role="complementary"><div><span>Sponsored</span></div><a href="https://l.facebook.com/l.php?u=1">x</a></div>'
    return platform_pages(spark, sf, item, '<html><body><div role="feed">', f"</div>{side}</body></html>", "https://www.facebook.com/")


@query
def feed_chunks(spark, sf):
    chunks = X.extract_chunks(feed_pages(spark, sf))
    return chunks.select(
        "page_id", "chunk_pos", "platform", "text", "target_url", joined("tags").alias("tags"), "xpath")


_FEED_DIV = "concat('/html/body/div/div', CASE WHEN nr > 1 THEN concat('[', nr, ']') ELSE '' END)"
# Without adverts: sponsored posts go first, then duplicates, then advert words.
SQL["feed_chunks"] = _platform_sql(
    _lines("lang", "text", "domain"), "concat('https://n.example/', doc_id)", _FEED_DIV, "facebook", "post",
    keep="doc_id % 3 <> 0") + " WHERE NOT (" + " OR ".join(
    f"contains(lower(text), {lit(w)})" for w in V.AD_TEXT_WORDS) + ")"


@query
def sponsored_posts(spark, sf):
    from pagegauge.operators.sponsored import sponsored_panels, sponsored_posts as posts
    pages = feed_pages(spark, sf)
    return posts(pages).unionByName(sponsored_panels(pages))


SQL["sponsored_posts"] = f"""WITH raw AS (SELECT doc_id, doc_id // 10 AS page_id,
      row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS nr FROM documents)
    SELECT page_id, 'post' AS kind, {_FEED_DIV} AS xpath FROM raw WHERE doc_id % 3 = 0
    UNION ALL SELECT DISTINCT page_id, 'panel', '/html/body/div[2]' FROM raw"""


@query
def heading_sections(spark, sf):
    """Pages whose main region has headings: one section per document."""
    item = F.concat(F.lit("<h2>"), esc(F.col("title")), F.lit("</h2><p>"), esc(F.col("text")), F.lit("</p><script>var a;</script>"))
    pages = platform_pages(spark, sf, item, "<html><body><main>", "</main></body></html>", "https://plain.example.org/")
    return X.extract_chunks(pages, include_ads=True, strategy="regex").select(
        "page_id", "chunk_pos", "text", "heading", "title", "xpath", joined("tags").alias("tags"))


_SECTION = _platform_sql(
    f"concat_ws(' ', nullif({trim('title')}, ''), nullif({trim('text')}, ''))",
    f"{trim('title')}", "concat('/html/body/main/h2', CASE WHEN nr > 1 THEN concat('[', nr, ']') ELSE '' END)", "", "article")
SQL["heading_sections"] = f"""SELECT page_id, chunk_pos, text, target_url AS heading,
    coalesce(nullif({flat('target_url')}, ''), {FIRST_SENTENCE('text')}) AS title, xpath, tags FROM ({_SECTION})"""


@query
def packed_paragraphs(spark, sf):
    """Pages without headings: paragraphs are packed to twice the minimum length."""
    item = F.concat(F.lit("<p>"), esc(T.collapse_space(F.col("text"))), F.lit("</p>"))
    pages = platform_pages(spark, sf, item, '<html><body><div id="content">', "</div></body></html>", "https://plain.example.org/")
    return X.extract_chunks(pages, include_ads=True, strategy="regex").select("page_id", "chunk_pos", "text")


@query
def ad_partition(spark, sf):
    """Adverts among the chunks of pages whose boxes carry advert classes by key."""
    kind = F.element_at(F.array(*[F.lit(c) for c in (
        "post", "post ad-banner", "post adtqd", "post load", "post Sponsored_box")]), (F.col("doc_id") % 5 + 1).cast("int"))
    item = F.concat(
        F.lit('<div class="'), kind, F.when(F.col("doc_id") % 7 == 0, '" data-ad="true').otherwise(""),
        F.lit('">'), esc(F.col("text")), F.lit("</div>"))
    pages = platform_pages(spark, sf, item, "<html><body>", "</body></html>", "https://plain.example.org/")
    content, ads = C.partition_ads(X.extract_chunks(pages, include_ads=True))
    both = content.withColumn("is_ad", F.lit(False)).unionByName(ads.withColumn("is_ad", F.lit(True)))
    return both.select("page_id", "chunk_pos", "is_ad", "text", joined("tags").alias("tags"), "ad_root")


_AD = ("(doc_id % 5 IN (1, 4) OR doc_id % 7 = 0 OR "
       + " OR ".join(f"contains(lower(text), {lit(w)})" for w in V.AD_TEXT_WORDS) + ")")
_BOX = "concat('/html/body/div', CASE WHEN nr > 1 THEN concat('[', nr, ']') ELSE '' END)"
_ADS = _platform_sql("text", "NULL", _BOX, "", "other")
SQL["ad_partition"] = _ADS.replace(
    f"SELECT page_id, (row_number()", f"SELECT {_AD} AS is_ad, page_id, (row_number()").replace(
    "text, target_url, concat('other', CASE WHEN " + " OR ".join(
        f"contains(lower(text), {lit(w)})" for w in V.AD_TEXT_WORDS) + " THEN ',advert' ELSE '' END) AS tags",
    f"text, concat('other', CASE WHEN {_AD} THEN ',advert' ELSE '' END) AS tags").replace(
    "'' AS platform,", "").replace(" AS xpath FROM d", " AS ad_root FROM d")


@query
def blocked_ads(spark, sf):
    """Adverts hidden per page, inside a box that itself looks like an advert."""
    item = F.concat(F.lit('<div class="post">'), esc(F.col("text")), F.lit("</div>"))
    pages = platform_pages(spark, sf, item, '<html><body><div class="promo">', "</div></body></html>", "https://plain.example.org/")
    _, ads = C.partition_ads(X.extract_chunks(pages, include_ads=True))
    return C.blocked_count(ads, ["page_id"])


@query
def site_results(spark, sf):
    """The whole path, as the job that writes each table once: pages to verdict and status line."""
    from pagegauge.plans.analysis import run_analysis
    from pagegauge.sources.tables import work_dir
    result = run_analysis(I.pages(spark, sf), work_dir(spark, "site_results")).pages
    return result.select(
        "page_id", "site_enabled", F.round("score", 6).alias("score"), "overall", "neutralised", "n_chunks",
        "ads_hidden", "status", "badge", "color", "line")


# --- SQL twins that need more than one step ------------------------------------------

_WORDS = " OR ".join(f"contains(lower(text), {lit(w)})" for w in V.AD_TEXT_WORDS)
SQL["blocked_ads"] = f"""SELECT page_id, count(DISTINCT xpath) AS ads_hidden
    FROM ({_platform_sql("text", "NULL", "nr", "", "other")}) WHERE {_WORDS} GROUP BY page_id"""
_PARA = flat("text")
SQL["packed_paragraphs"] = f"""WITH RECURSIVE p AS (SELECT doc_id // 10 AS page_id, t AS text, {u16('t')} AS n,
      row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS i FROM (SELECT doc_id, {_PARA} AS t FROM ({I.CHUNKS})) WHERE t <> ''),
    r AS (SELECT page_id, i, n AS chars, 0 AS g FROM p WHERE i = 1 UNION ALL
      SELECT p.page_id, p.i, CASE WHEN r.chars >= 200 THEN p.n ELSE r.chars + 1 + p.n END, CASE WHEN r.chars >= 200 THEN r.g + 1 ELSE r.g END
      FROM r JOIN p ON p.page_id = r.page_id AND p.i = r.i + 1),
    c AS (SELECT page_id, g, string_agg(text, ' ' ORDER BY i) AS text FROM r JOIN p USING (page_id, i) GROUP BY page_id, g HAVING max(chars) >= 100),
    d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page_id, {SIGNATURE} ORDER BY g) = 1)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY g) - 1)::INT AS chunk_pos, text FROM d"""


def site_results_sql() -> str:
    from checks.oracle import RULES
    def value(module: str) -> str:
        return "(" + " + ".join(f"(CASE WHEN {c} THEN {w}::DOUBLE ELSE 0::DOUBLE END)" for _, w, c in RULES[module]) + ")"
    heading = flat(TAGLESS.format(H1))
    return f"""WITH p AS (SELECT page_id, {ARTICLE_TEXT} AS text, lower(coalesce(nullif({heading}, ''), {FIRST_SENTENCE(ARTICLE_TEXT)})) AS lt FROM pages),
      b AS (SELECT page_id, lower(text) AS l, lt, {_WORDS} AS ad FROM p WHERE {u16('text')} >= 100),
      s AS (SELECT page_id, 0.5::DOUBLE + {value('biasDetector')} + {value('defuseRagebait')} + {value('clickUnbait')} AS total FROM b WHERE NOT ad),
      f AS (SELECT p.page_id, s.total / 5 AS score, CASE WHEN s.total IS NULL THEN 0 ELSE 1 END AS n,
        (SELECT count(*) FROM b WHERE b.ad AND b.page_id = p.page_id) AS ads FROM p LEFT JOIN s USING (page_id)),
      k AS (SELECT *, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS hits, CASE WHEN n = 0 THEN 'no_chunks' ELSE 'completed' END AS status FROM f)
      SELECT page_id, true AS site_enabled, round(score, 6) AS score,
        CASE WHEN score IS NULL THEN NULL WHEN score > 0.7 THEN 'high-risk' WHEN score > 0.4 THEN 'caution' ELSE 'safe' END AS overall,
        hits AS neutralised, CASE WHEN n > 0 THEN n END AS n_chunks, ads AS ads_hidden, status,
        CASE WHEN n > 0 AND hits + ads > 0 THEN (hits + ads)::VARCHAR ELSE '' END AS badge,
        CASE WHEN n = 0 THEN 'grey' WHEN score > 0.7 THEN 'red' WHEN score > 0.4 THEN 'orange' ELSE 'green' END AS color,
        CASE WHEN n = 0 THEN 'Page check: no content to analyze' WHEN hits + ads = 0 THEN 'Page check: analysis complete, nothing flagged'
          ELSE concat('Page check: ', concat_ws(', ', CASE WHEN hits > 0 THEN concat(hits, ' labelled') END,
            CASE WHEN ads > 0 THEN concat(ads, ' ads hidden') END), ' on this page') END AS line FROM k"""


SQL["site_results"] = site_results_sql()
