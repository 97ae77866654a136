"""Unravel clickbait: follow the link of a clickbait chunk to its destination
page and put an honest summary of that page before the headline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegauge import fixed_values as V
from pagegauge.functions import text as T, urls as U
from pagegauge.functions.joins import first_by, salted_join
from pagegauge.operators.chunks import html_to_text


def is_clickbait(flags: Column, problem_score: Column) -> Column:
    return F.coalesce(F.array_contains(flags, "clickbait"), F.lit(False)) | (
        F.coalesce(problem_score, F.lit(0.0)) >= V.CLICKBAIT_THRESHOLD
    )


def pick_destination(links: Column, page_url: Column) -> Column:
    """First link that resolves to http(s) and leaves the page."""
    resolved = F.transform(links, lambda x: U.url_resolve(x["url"], page_url))
    leaves = F.filter(
        resolved,
        lambda u: F.rlike(u, F.lit("(?i)^https?:")) & ~U.same_page(u, page_url),
    )
    return F.get(leaves, F.lit(0))


def original_title(title: Column, links: Column, text: Column) -> Column:
    """Chunk title, else the first link text of more than 8 characters, else the first line."""
    link_texts = F.filter(
        F.transform(links, lambda x: T.js_trim(F.coalesce(x["text"], F.lit("")))),
        lambda t: T.longer_than(t, 8),
    )
    return F.coalesce(
        T.nullif_blank(T.js_trim(title)), F.get(link_texts, F.lit(0)), T.nullif_blank(T.first_line(text))
    )


def _first_words(text: Column, n: int = 8) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def honest_summary(dest_title: Column, dest_text: Column, original: Column) -> Column:
    """Start of the destination's title, up to a bar or colon, if it says something
    else than the headline; otherwise the start of its first sentence."""
    title = T.collapse_space(F.coalesce(dest_title, F.lit("")))
    from_title = T.nullif_blank(T.js_trim(F.regexp_replace(_first_words(title), r"[|:].*\z", "")))
    sentence = T.collapse_space(F.regexp_extract(F.coalesce(dest_text, F.lit("")), r"(?s)^([^.!?]*)", 1))
    return F.when((title != "") & (F.lower(title) != F.lower(original)), from_title).when(
        T.longer_than(sentence, 12), _first_words(sentence)
    )


def clean_summary(text: Column) -> Column:
    """Drop outer brackets and quotes, collapse spaces, 60 characters."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\[+|\]+\z", ""), r"""^["']|["']\z""", "")
    return F.substring(T.collapse_space(bare), 1, 60)


def parse_summary_reply(reply: Column) -> Column:
    """Summary in a model reply: its JSON field, else its first plain line."""
    found = T.first_json_object(reply)
    parsed = F.try_parse_json(found)
    field = lambda name: T.nullif_blank(T.js_trim(F.try_variant_get(parsed, f"$.{name}", "string")))
    summary = F.coalesce(field("summary"), field("honestSummary"))
    lines = F.filter(
        F.transform(F.split(reply, "\n"), T.js_trim),
        lambda x: (x != "") & ~F.startswith(x, F.lit("{")),
    )
    return clean_summary(F.coalesce(summary, F.get(lines, F.lit(0))))


def format_unbait_title(summary: Column, original: Column, max_len: int = V.UNBAIT_MAX_CHARS) -> Column:
    """struct(display_title, hover_title, rewritten): "[summary] original", the
    original cut to the budget; the summary is kept whole."""
    short = T.js_trim(F.regexp_replace(T.js_trim(F.coalesce(summary, F.lit(""))), r"^\[+|\]+\z", ""))
    full = T.collapse_space(F.coalesce(original, F.lit("")))
    prefix = F.concat(F.lit("["), short, F.lit("] "))
    room = F.lit(max_len - len(V.ELLIPSIS)) - F.length(prefix)
    # Only the end is trimmed: the headline has no space at its start.
    cut = F.when(
        room > 0, F.concat(F.rtrim(F.substring(full, F.lit(1), F.greatest(room, F.lit(0)))), F.lit(V.ELLIPSIS))
    ).otherwise(V.ELLIPSIS)
    usable = (short != "") & (full != "")
    display = (
        F.when(~usable, full)
        .when(F.length(prefix) + F.length(full) <= max_len, F.concat(prefix, full))
        .otherwise(F.concat(prefix, cut))
    )
    return F.struct(display.alias("display_title"), full.alias("hover_title"), usable.alias("rewritten"))


def destinations(pages: DataFrame) -> DataFrame:
    """One narrow row per page URL: title and text start. Built before any shuffle,
    so that no markup is shuffled. The first page of a URL counts."""
    texts = html_to_text(pages)
    rows = texts.where((F.col("title") != "") | (F.col("text") != "")).select(
        U.url_key(F.col("url")).alias("dest_key"),
        F.col("page_id").alias("dest_page_id"),
        F.col("title").alias("dest_title"),
        # The summary needs the first sentence only.
        F.regexp_extract(F.col("text"), r"(?s)^([^.!?]*)", 1).alias("dest_text"),
    ).where("dest_key is not null")
    return first_by(rows, ["dest_key"], ["dest_page_id"])


def join_destinations(chunks: DataFrame, pages: DataFrame, sketch: bool = True) -> DataFrame:
    """Left join of chunks with column dest_url to the page it names. With `sketch`,
    only pages that very many chunks point to are repeated (see salted_join)."""
    keyed = chunks.withColumn("dest_key", U.url_key(F.col("dest_url")))
    return salted_join(keyed, destinations(pages), ["dest_key"], sketch=sketch).drop("dest_key")


def unravel_clickbait(
    chunks: DataFrame, pages: DataFrame, replies: DataFrame | None = None, key: list[str] | None = None
) -> DataFrame:
    """Clickbait chunks with destination, honest summary, new title and outcome.

    chunks: key, title, text, links, page_url and the clickbait result columns
    flags, problem_score, explanation (see scorers.score). Rows that are not
    clickbait are dropped.  replies (key, reply) holds model summaries, if any.
    """
    key = key or ["page_id", "chunk_pos"]
    bait = chunks.where(is_clickbait(F.col("flags"), F.col("problem_score")))
    aimed = bait.select(
        *key, "problem_score", "explanation",
        F.array_union("flags", F.array(F.lit("clickbait"))).alias("flags"),
        original_title(F.col("title"), F.col("links"), F.col("text")).alias("original_title"),
        pick_destination(F.col("links"), F.col("page_url")).alias("dest_url"),
    )
    found = join_destinations(aimed, pages)
    summary = honest_summary(F.col("dest_title"), F.col("dest_text"), F.col("original_title"))
    if replies is not None:
        found = found.join(replies.select(*key, "reply"), key, "left")
        summary = F.coalesce(
            F.when(F.col("dest_page_id").isNotNull(), T.nullif_blank(parse_summary_reply(F.col("reply")))), summary
        )
    found = found.withColumn("summary", summary)
    outcome = (
        F.when(F.col("dest_url").isNull() | F.col("original_title").isNull(), "no_link")
        .when(F.col("dest_page_id").isNull(), "no_page")
        .when(F.col("summary").isNull(), "no_summary")
        .when(~F.col("shown")["rewritten"], "no_rewrite")
        .otherwise("unbaited")
    )
    shown = found.withColumn("shown", format_unbait_title(F.col("summary"), F.col("original_title")))
    done = shown.withColumn("outcome", outcome)
    is_done = F.col("outcome") == "unbaited"
    has_link = F.col("outcome") != "no_link"
    E = V.UNBAIT_EXPLANATIONS
    fallback = F.create_map(*[F.lit(x) for k in ("no_link", "no_page", "no_summary") for x in (k, E[k])])
    return done.select(
        *key, "problem_score",
        F.when(is_done, F.array_union("flags", F.array(F.lit("unbaited")))).otherwise(F.col("flags")).alias("flags"),
        "outcome",
        F.when(is_done, F.concat(F.lit(E["unbaited"]), F.col("summary"))).otherwise(
            F.coalesce(T.nullif_blank(F.col("explanation")), F.try_element_at(fallback, F.col("outcome")))
        ).alias("explanation"),
        F.when(has_link, F.col("dest_url")).alias("destination_url"),
        F.when(has_link, F.col("original_title")).alias("original_title"),
        F.when(is_done, F.col("summary")).alias("honest_summary"),
        F.when(is_done, F.col("shown")["display_title"]).alias("display_title"),
        F.when(is_done, F.col("shown")["hover_title"]).alias("hover_title"),
    )


def title_target(links: Column, title: Column, headings: Column | None = None) -> Column:
    """struct(kind, pos) of the link, else heading, that carries the title: equal,
    inside it, or holding its first 40 characters; else the first link with more
    than 10 characters of text. links and headings are arrays of texts."""
    wanted = F.lower(T.collapse_space(title))
    start = F.substring(wanted, 1, 40)
    def position(texts: Column, test) -> Column:
        low = F.transform(texts, lambda t: F.lower(T.collapse_space(F.coalesce(t, F.lit("")))))
        hits = F.transform(low, lambda t: F.coalesce((t != "") & test(t), F.lit(False)))
        return T.let(F.array_position(hits, F.lit(True)), lambda p: F.when(p > 0, p - 1))
    carries = lambda t: (t == wanted) | F.contains(wanted, t) | F.contains(t, start)
    holds = lambda t: (t == wanted) | F.contains(t, start)
    def pick(kind: str, pos: Column) -> Column:
        return T.let(pos, lambda p: F.when(p.isNotNull(), F.struct(F.lit(kind).alias("kind"), p.alias("pos"))))
    options = [pick("link", position(links, carries))]
    if headings is not None:
        options.append(pick("heading", position(headings, holds)))
    long = F.transform(links, lambda t: F.coalesce(T.longer_than(T.js_trim(t), 10), F.lit(False)))
    options.append(pick("link", T.let(F.array_position(long, F.lit(True)), lambda p: F.when(p > 0, p - 1))))
    return F.coalesce(*options)
