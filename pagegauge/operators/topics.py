"""Topics of texts by a weighted lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegauge.functions.joins import salted_join

#: What separates words.
BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-cased words of the whole text, in order and with repeats; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def topic_weights(chunks: DataFrame, lexicon: DataFrame, key: list[str]) -> DataFrame:
    """key, topic, weight: the weights of all occurrences of a topic's terms, added up.
    A chunk without any term has one row, whose topic is null.

    lexicon: topic, term (one word, in any case), weight (to six decimals; added up
    exactly, so that sums do not depend on the order of rows). A term may belong to
    several topics. Words meet the lexicon in one join whose hot words are spread,
    unless Spark broadcasts the lexicon; sums are combined before they are shuffled.
    """
    terms = lexicon.where("topic is not null").select(
        F.lower("term").alias("term"), "topic", F.col("weight").cast("decimal(18,6)").alias("weight"))
    # The null keeps a chunk without words.
    marked = F.concat(F.array(F.lit(None).cast("string")), words_of(F.col("text")))
    words = chunks.select(*key, F.explode(marked).alias("term"))
    met = salted_join(words, terms, ["term"], sketch=True)
    return met.groupBy(*key, "topic").agg(F.sum("weight").alias("weight"))


def topics(chunks: DataFrame, lexicon: DataFrame, key: list[str], least: float = 0.0) -> DataFrame:
    """key, topic, weight: the topic of each chunk with the largest weight, of equal ones
    the first by name; both are null where no topic has `least` or more."""
    weights = topic_weights(chunks, lexicon, key)
    usable = F.col("topic").isNotNull() & (F.col("weight") >= F.lit(least).cast("decimal(18,6)"))
    best = F.min(F.when(usable, F.struct((-F.col("weight")).alias("minus"), "topic")))
    return weights.groupBy(*key).agg(best.alias("best")).select(
        *key, F.col("best.topic").alias("topic"), (-F.col("best.minus")).cast("double").alias("weight"))
