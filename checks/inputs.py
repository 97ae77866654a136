"""Inputs that both sides of a check derive from the given tables.

The tables hold hardly any of the phrases that the operators look for, so each
row gets some by its key. The expressions are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagegauge.sources.tables import spread

ADDED_TEXT = """CASE doc_id % 11
  WHEN 1 THEN ' Act now, limited time, last chance, urgent! Enter your password and verify your account'
  WHEN 2 THEN ' guaranteed returns, get rich quick, free money. You will regret this. damn'
  WHEN 3 THEN ' The progressive and liberal view of inequality. Obviously, clearly, undoubtedly, everyone knows'
  WHEN 4 THEN ' Conservative and republican ideas, free market; you are an idiot, all of them are stupid'
  WHEN 5 THEN ' However, outrageous disgusting appalling shocking terrible amazing news. Doctors hate one weird trick'
  WHEN 6 THEN ' Congratulation, click below. Nobody likes you. I will hurt you. shut up'
  WHEN 7 THEN ' You won''t believe what happened next! This is why 7 ways will shock you?'
  WHEN 8 THEN ' According to experts it is a hoax; sponsored'
  WHEN 9 THEN ' gone wrong, you need to see 10 secrets, f*ck off yourself'
  ELSE '' END"""
TITLE = """CASE doc_id % 5
  WHEN 0 THEN 'The one thing you''re doing wrong'
  WHEN 1 THEN 'This will amaze those readers'
  WHEN 2 THEN '  A plain   headline '
  WHEN 3 THEN 'What happens next?'
  ELSE '' END"""
DOMAIN = """CASE doc_id % 4 WHEN 0 THEN 'shop.example.tk' WHEN 1 THEN 'news12345.com'
  WHEN 2 THEN 'bit.ly' ELSE 'www.example.org' END"""
LINK = """CASE doc_id % 6 WHEN 0 THEN 'https://win.prize.ml/a' WHEN 1 THEN 'http://TinyURL.com/x'
  WHEN 2 THEN '/local/page' ELSE 'https://example.org/story' END"""

CHUNKS = f"""SELECT doc_id, source, lang, concat(text, {ADDED_TEXT}) AS text,
  {TITLE} AS title, {DOMAIN} AS domain, {LINK} AS link FROM documents"""

RATING = """CASE {0} % 8 WHEN 0 THEN 'False' WHEN 1 THEN 'Mostly False' WHEN 2 THEN 'mixture' WHEN 3 THEN 'Half True'
  WHEN 4 THEN 'mostly true' WHEN 5 THEN 'TRUE' WHEN 6 THEN 'Pants on Fire' ELSE 'Unproven' END"""

MODULES = ["factChecker", "biasDetector", "antiManipulation", "defuseRagebait", "clickUnbait"]
MODULE_BY = """CASE {0} % 6 WHEN 0 THEN 'factChecker' WHEN 1 THEN 'biasDetector' WHEN 2 THEN 'antiManipulation'
  WHEN 3 THEN 'defuseRagebait' WHEN 4 THEN 'clickUnbait' ELSE 'someOther' END"""
ASPECT_BY = """CASE {0} % 7 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'bias' WHEN 2 THEN 'scams'
  WHEN 3 THEN 'toxicity' WHEN 4 THEN 'clickbait' WHEN 5 THEN 'boredom' ELSE 'bias' END"""

# Events as user feedback. A page view of user u in hour h is the chunk.
FEEDBACK = f"""SELECT event_id AS feedback_id,
  CASE WHEN event_id % 17 = 3 THEN '' ELSE concat('fp', cast(event_id % 40 AS string)) END AS chunk_fingerprint,
  CASE WHEN event_id % 19 = 4 THEN NULL ELSE concat('https://site', cast(event_id % 7 AS string), '.example.com/') END AS chunk_url,
  CASE WHEN event_id % 3 = 0 THEN concat('Title ', cast(event_id % 5 AS string)) END AS chunk_title,
  {ASPECT_BY.format('event_id')} AS aspect_type,
  {MODULE_BY.format('event_id')} AS module_id,
  CASE WHEN event_type = 'error' THEN NULL ELSE value >= 20 END AS applies,
  CASE WHEN event_id % 23 = 5 THEN repeat('long ', 101) WHEN event_type = 'click' THEN '  a note ' END AS message,
  CASE WHEN event_id % 29 = 6 THEN NULL ELSE cast(user_id AS string) END AS user_id,
  ts AS created FROM events"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _from(spark: SparkSession, df: DataFrame, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=df)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks: doc_id, source, lang, text, title, domain, links."""
    rows = _from(spark, documents(spark, sf), "documents", CHUNKS)
    links = F.array(F.struct(F.col("link").alias("url"), F.lit("").alias("text")))
    return rows.withColumn("links", links).drop("link")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "pages"))


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return feedback_of(spark, table(spark, sf, "events"))


def feedback_of(spark: SparkSession, events: DataFrame) -> DataFrame:
    rows = _from(spark, events, "events", FEEDBACK)
    return rows.withColumn("created", F.col("created").cast("timestamp"))


def sentences(spark: SparkSession, df: DataFrame, key: str, factor: int) -> DataFrame:
    """Sentences of at least 20 characters as fact-checked claims."""
    from pagegauge.functions import text as T
    parts = F.filter(F.transform(F.split("text", "[.!?]+"), T.js_trim), lambda s: T.longer_than(s, 19))
    rows = df.select(F.col(key).alias("id"), F.posexplode_outer(parts).alias("pos", "text")).where("text is not null")
    return rows.select((F.col("id") * factor + F.col("pos")).alias("fact_id"), "text")


DOCUMENT_FACTS = 1_000_000_000_000


def fact_checks(spark: SparkSession, sf: str, said: bool = True) -> DataFrame:
    """Fact checks: every sentence of the benchmark passages and, if `said`, of the documents; ids of
    the latter start with DOCUMENT_FACTS."""
    rows = sentences(spark, table(spark, sf, "benchmark"), "item_id", 1000)
    if said:
        more = sentences(spark, documents(spark, sf), "doc_id", 1_000_000).withColumn("fact_id", F.col("fact_id") + DOCUMENT_FACTS)
        rows = rows.unionByName(more)
    review = lambda rating, publisher, title: F.struct(
        F.lit(publisher).alias("publisher"), F.concat(F.lit("https://check.example.org/"), "fact_id").alias("url"),
        title.alias("title"), F.lit("").alias("review_date"), rating.alias("textual_rating"), F.lit("en").alias("language_code"))
    rating = F.expr(RATING.format("fact_id"))
    other = F.expr(RATING.format("(fact_id + 3)"))
    title = F.concat(F.lit("Review of: "), "text")
    reviews = F.when(F.col("fact_id") % 5 == 4, F.array(review(rating, "Desk", title)).cast("array<struct<publisher:string,url:string,title:string,review_date:string,textual_rating:string,language_code:string>>")).when(
        F.col("fact_id") % 5 == 3, F.array(review(rating, "Desk", title), review(other, "Lab", title))).when(
        F.col("fact_id") % 5 == 2, F.array(review(rating, "", title)))
    from pagegauge.operators.claims import with_review_defaults
    return with_review_defaults(rows.select(
        "fact_id", "text", F.lit(None).cast("string").alias("claimant"), F.lit(None).cast("string").alias("claim_date"),
        reviews.alias("reviews")))
