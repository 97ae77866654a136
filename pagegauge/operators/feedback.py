"""User feedback on aspect scores: build, validate, link to chunks, tally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegauge import fixed_values as V
from pagegauge.functions import text as T
from pagegauge.functions.joins import first_by, salted_join

FEEDBACK_SCHEMA = (
    "feedback_id long, chunk_fingerprint string, chunk_url string, chunk_title string, "
    "aspect_type string, module_id string, analysis_id string, applies boolean, message string, "
    "problem_score double, confidence double, user_id string, created timestamp"
)


def build_feedback(events: DataFrame, aspects: dict[str, str] | None = None) -> DataFrame:
    """Fill aspect_type from the module and clean the note; `error` says why a row
    cannot be sent. A thumbs-up carries no note."""
    aspects = aspects or V.FEEDBACK_MODULE_ASPECT
    lookup = F.create_map(*[F.lit(x) for kv in aspects.items() for x in kv])
    aspect = F.try_element_at(lookup, F.col("module_id"))
    too_long = F.coalesce(T.longer_than(F.col("message"), V.MAX_FEEDBACK_MESSAGE), F.lit(False))
    return events.withColumns({
        "aspect_type": aspect,
        "error": F.when(aspect.isNull(), "Unknown analysis module").when(
            too_long, f"Message too long (max {V.MAX_FEEDBACK_MESSAGE})"),
        "message": F.when(~F.col("applies"), T.nullif_blank(T.js_trim(F.col("message")))),
    })


def reject_reason() -> Column:
    """First broken rule of a feedback row, null if it is fine."""
    E = V.FEEDBACK_ERRORS
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(blank("chunk_fingerprint"), E["fingerprint"])
        .when(blank("chunk_url"), E["url"])
        .when(blank("module_id"), E["module"])
        .when(~F.coalesce(F.col("aspect_type").isin(V.ASPECTS), F.lit(False)), E["aspect"])
        .when(F.col("applies").isNull(), E["applies"])
        .when(F.coalesce(T.longer_than(F.col("message"), V.MAX_FEEDBACK_MESSAGE), F.lit(False)), E["message_long"])
    )


def ingest_feedback(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reject_reason)."""
    checked = feedback.withColumn("reject_reason", reject_reason())
    return (
        checked.where("reject_reason is null").drop("reject_reason"),
        checked.where("reject_reason is not null"),
    )


def resolve_feedback(feedback: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feedback with chunk_id and stub_id, stub chunks for fingerprints without a chunk).

    chunks: chunk_id, fingerprint. The first chunk of a fingerprint counts. Feedback
    on a new chunk has a null chunk_id and the stub_id of the stub made for it.
    """
    # Two columns of the chunk table, and of those only the fingerprints asked for:
    # a small batch of feedback is broadcast and the chunk table is only scanned.
    wanted = feedback.select(F.col("chunk_fingerprint").alias("fingerprint")).distinct()
    asked = chunks.select("chunk_id", "fingerprint").join(wanted, "fingerprint", "left_semi")
    known = first_by(asked, ["fingerprint"], ["chunk_id"]).select(
        F.col("fingerprint").alias("chunk_fingerprint"), "chunk_id")
    linked = salted_join(feedback, known, ["chunk_fingerprint"])
    linked = linked.withColumn("stub_id", F.when(F.col("chunk_id").isNull(), stub_id("chunk_fingerprint")))
    return linked, stub_chunks(linked.where("chunk_id is null"))


def stub_id(fingerprint: str) -> Column:
    """The same fingerprint has the same id in every batch: 60 bits of its md5."""
    return F.conv(F.substring(F.md5(fingerprint), 1, 15), 16, 10).cast("long")


def stub_chunks(feedback: DataFrame) -> DataFrame:
    """One stub chunk per fingerprint from its first feedback."""
    first = feedback.groupBy(F.col("chunk_fingerprint").alias("fingerprint")).agg(
        F.min_by(F.struct("chunk_url", "chunk_title"), F.struct("created", "feedback_id")).alias("f")
    )
    return first.select(
        stub_id("fingerprint").alias("stub_id"), "fingerprint", F.col("f.chunk_url").alias("url"), F.col("f.chunk_title").alias("title"),
        F.coalesce(T.nullif_blank(F.col("f.chunk_title")), F.col("f.chunk_url")).alias("text"),
    )


def latest_votes(feedback: DataFrame) -> DataFrame:
    """Newest vote of each user per chunk and aspect. Without a user each vote stands alone."""
    voter = F.coalesce(F.col("user_id"), F.concat(F.lit("#"), F.col("feedback_id").cast("string")))
    return feedback.withColumn("voter", voter).groupBy("chunk_fingerprint", "aspect_type", "voter").agg(
        F.max_by("applies", F.struct("created", "feedback_id")).alias("applies"),
        F.count("*").alias("n_events"),
    )


def tally_feedback(feedback: DataFrame) -> DataFrame:
    """Votes for and against per chunk and aspect; a user's latest vote counts, the
    number of all events is kept beside it."""
    return latest_votes(feedback).groupBy("chunk_fingerprint", "aspect_type").agg(
        F.count_if(F.col("applies")).alias("applies"),
        F.count_if(~F.col("applies")).alias("applies_not"),
        F.sum("n_events").alias("n_events"),
    )
