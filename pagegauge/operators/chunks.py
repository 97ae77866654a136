"""Operators on a chunk table: titles, tags, adverts, dedup, limits, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagegauge import fixed_values as V
from pagegauge.functions import text as T
from pagegauge.functions.joins import first_by, salted_join, top_by
from pagegauge.functions.urls import is_platform_host

AD_CLASS = f"(?:^|[^a-z])(?:{'|'.join(V.AD_CLASS_WORDS)})(?:[^a-z]|\\z)"


# --- page text from markup -------------------------------------------------

def html_title(html: Column) -> Column:
    """Text of <title>, else of the first <h1>; '' if neither has any."""
    def inner(tag: str) -> Column:
        return F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    raw = F.coalesce(T.nullif_blank(inner("title")), inner("h1"))
    return T.collapse_space(T.decode_entities(T.strip_tags(raw)))


def html_text(html: Column, max_chars: int | None = None) -> Column:
    """Plain text of a page without script, style and noscript parts; the first max_chars characters if given."""
    for tag in ("script", "style", "noscript"):
        html = F.regexp_replace(html, f"(?is)<{tag}.*?</{tag}>", " ")
    text = T.collapse_space(T.decode_entities(T.strip_tags(html)))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def html_to_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """page_id, url, title and text excerpt, by regex only."""
    return pages.select(
        "page_id", "url",
        html_title(F.col("html")).alias("title"),
        html_text(F.col("html"), max_chars).alias("text"),
    )


# --- titles ---------------------------------------------------------------------

def heading_title(html: Column) -> Column:
    """First h1 with text, else first h2, else first h3."""
    found = [
        T.nullif_blank(T.collapse_space(T.strip_tags(
            F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))))
        for tag in ("h1", "h2", "h3")
    ]
    return F.coalesce(*found)


def infer_title(chunks: DataFrame, into: str = "title") -> DataFrame:
    """Existing title, heading in the html, section heading, first sentence, in this order."""
    options = []
    if "title" in chunks.columns:
        options.append(T.nullif_blank(T.collapse_space(F.col("title"))))
    if "html" in chunks.columns:
        options.append(heading_title(F.col("html")))
    if "heading" in chunks.columns:
        options.append(T.nullif_blank(T.collapse_space(F.col("heading"))))
    options.append(T.first_sentence(F.col("text")))
    return chunks.withColumn(into, F.coalesce(*options))


# --- adverts -----------------------------------------------------------------

def ad_class(classes: Column) -> Column:
    """Some class holds an advert word as a whole word."""
    return F.coalesce(F.exists(classes, lambda c: F.rlike(F.lower(c), F.lit(AD_CLASS))), F.lit(False))


def ad_element(
    classes: Column, element_id: Column, data_attributes: Column, parent_classes: Column | None = None
) -> Column:
    """Element looks like an advert by class, id, data attribute or a near parent's class."""
    flagged = [
        F.coalesce(F.try_element_at(data_attributes, F.lit(name)) == "true", F.lit(False))
        for name in ("data-sponsored", "data-ad")
    ]
    result = ad_class(classes) | F.coalesce(
        F.rlike(F.lower(element_id), F.lit(AD_CLASS)), F.lit(False)
    ) | flagged[0] | flagged[1]
    return result | ad_class(parent_classes) if parent_classes is not None else result


def ad_text(text: Column) -> Column:
    """Text holds one of the advert words."""
    return T.contains_any(F.lower(F.coalesce(text, F.lit(""))), V.AD_TEXT_WORDS)


def infer_advert(chunks: DataFrame, into: str = "is_ad") -> DataFrame:
    """Tagged as advert, sponsored feed post, advert element, or advert words in the text.

    Columns that the table lacks count as giving no sign.
    """
    have = set(chunks.columns)
    signs = []
    if "tags" in have:
        signs.append(F.coalesce(F.array_contains("tags", "advert"), F.lit(False)))
    if {"sponsored", "url"} <= have:
        signs.append(F.coalesce(F.col("sponsored"), F.lit(False)) & is_platform_host(F.col("url")))
    if "metadata" in have:
        meta = F.col("metadata")
        signs.append(ad_element(meta["classes"], meta["id"], meta["data_attributes"]))
    signs.append(ad_text(F.col("text")))
    return chunks.withColumn(into, T.any_of(signs))


def add_tags(tags: Column, more: Column) -> Column:
    """Set union that keeps the order of first appearance."""
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), more)


def tag_chunks(chunks: DataFrame) -> DataFrame:
    """Content tag by platform unless the chunk has one, then the advert tag."""
    by_platform = (
        F.when(F.col("platform").isin("google", "duckduckgo"), "search_result")
        .when(F.col("platform").isin("facebook", "reddit", "threads", "bluesky"), "post")
        .otherwise("other")
    )
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    content = F.array_remove(tags, "advert")
    tagged = chunks.withColumn("tags", F.when(F.size(content) > 0, tags).when(
        by_platform == "other", F.array_union(tags, F.array(by_platform))
    ).otherwise(F.array_union(F.array(by_platform), tags)))
    marked = infer_advert(tagged, "_ad")
    return marked.withColumn(
        "tags", F.when(F.col("_ad"), add_tags(F.col("tags"), F.array(F.lit("advert")))).otherwise(F.col("tags"))
    ).drop("_ad")


def partition_ads(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content, adverts); adverts carry the advert tag. Two filters on one flag."""
    flagged = infer_advert(chunks, "_ad")
    content = flagged.where("not _ad").drop("_ad")
    tagged = add_tags(F.col("tags"), F.array(F.lit("advert")))
    return content, flagged.where("_ad").drop("_ad").withColumn("tags", tagged)


def blocked_count(ads: DataFrame, page: list[str]) -> DataFrame:
    """Adverts hidden per page; several adverts under one root count once."""
    return ads.groupBy(*page).agg(F.count_distinct("ad_root").alias("ads_hidden"))


# --- dedup and limits --------------------------------------------------------

def signature(text: Column) -> Column:
    """Hash of the whole text, lower case, trimmed."""
    return F.sha2(T.js_trim(F.lower(text)), 256)


def dedup_chunks(chunks: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """First chunk of each signature within the scope ([] for the whole table)."""
    keyed = chunks.withColumn("_sig", signature(F.col("text")))
    return first_by(keyed, [*scope, "_sig"], order).drop("_sig")


def limit_per_page(chunks: DataFrame, page: list[str], order: list[str], n: int,
                   min_text: int = 0) -> DataFrame:
    """First n chunks per page with at least min_text characters."""
    enough = chunks.where(T.longer_than(F.col("text"), min_text - 1)) if min_text else chunks
    return top_by(enough, page, order, n)


# --- joins onto chunks ---------------------------------------------------------

def with_preview(scores: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """Add the first 120 characters of the chunk text to its results.

    The preview is cut before the join, so whole texts are not shuffled.
    """
    previews = chunks.select(*key, T.truncate(F.coalesce("text", F.lit("")), 120).alias("text_preview"))
    joined = scores.join(previews, key, "left")
    return joined.withColumn("text_preview", F.coalesce("text_preview", F.lit("")))


def with_page_metadata(chunks: DataFrame, pages: DataFrame, on: str = "page_id", sketch: bool = True) -> DataFrame:
    """Fill url, title, domain, author and description of chunks from their page.

    The ids of `chunks` are read once more to find pages with very many chunks;
    without `sketch`, the pages are repeated for every chunk's salt instead.
    """
    fields = [f for f in ("url", "title", "domain", "author", "description") if f in pages.columns]
    narrow = pages.select(on, *[F.col(f).alias(f"_page_{f}") for f in fields])
    joined = salted_join(chunks, narrow, [on], sketch=sketch)
    filled = {
        f: F.coalesce(F.col(f), F.col(f"_page_{f}")) if f in chunks.columns else F.col(f"_page_{f}")
        for f in fields
    }
    return joined.withColumns(filled).drop(*[f"_page_{f}" for f in fields])


def chunks_of_pages(pages: DataFrame, chunks: DataFrame, chunk_key: list[str], sketch: bool = True) -> DataFrame:
    """Chunks of each page by page id or by URL: (page_id, chunk key), each pair once.

    Two equi-joins and a distinct; one join on "id or url" would compare every
    page with every chunk.
    """
    ids = pages.select("page_id")
    urls = pages.select(F.col("page_id").alias("of_page"), "url").where("url is not null")
    by_id = salted_join(chunks.select("page_id", *[c for c in chunk_key if c != "page_id"]), ids, ["page_id"], "inner", sketch=sketch)
    by_id = by_id.withColumn("of_page", F.col("page_id"))
    by_url = salted_join(chunks.select("url", *chunk_key), urls, ["url"], "inner", sketch=sketch).drop("url")
    columns = ["of_page", *chunk_key]
    return by_id.select(*columns).unionByName(by_url.select(*columns)).distinct()


def list_view(chunks: DataFrame) -> DataFrame:
    """Columns of a chunk list: 100-character preview and whether an analysis exists."""
    dash = lambda c: F.coalesce(T.nullif_blank(F.col(c)), F.lit("-"))
    return chunks.select(
        "id", dash("url").alias("url"), dash("title").alias("title"),
        F.coalesce(T.nullif_blank(T.truncate(F.col("text"), 100, "...")), F.lit("-")).alias("preview"),
        F.col("analysis").isNotNull().alias("has_analysis"),
    )


def section_number(
    elements: DataFrame, page: list[str], order: str, is_heading: Column, block: int = 10_000
) -> DataFrame:
    """Running count of headings in page order: which section an element belongs to.

    `order` is a position, unique per page. A page is counted in blocks of positions,
    so that a very long one is not one task's work: first the headings per block,
    then the sum over the blocks before, then the count inside each block.
    """
    marked = elements.withColumns({
        "_block": F.floor(F.col(order) / block), "_heading": F.coalesce(is_heading, F.lit(False)).cast("int")})
    before = W.partitionBy(*page).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = marked.groupBy(*page, "_block").agg(F.sum("_heading").alias("_n")).select(
        *page, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*page, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    counted = marked.withColumn("_inside", F.sum("_heading").over(inside))
    return counted.join(offsets, [*page, "_block"]).withColumn(
        "section", F.col("_before") + F.col("_inside")).drop("_block", "_heading", "_before", "_inside")
