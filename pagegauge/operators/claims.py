"""Claims in chunk texts and their match against a fact-check table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegauge import fixed_values as V
from pagegauge.functions import text as T
from pagegauge.functions.joins import salted_join

REVIEWS = (
    "array<struct<publisher:string,url:string,title:string,review_date:string,"
    "textual_rating:string,language_code:string>>"
)
_STARTS, _LINKING, _FACT_WORDS = V.CLAIM_PATTERNS


def _literals(pattern: str) -> list[str]:
    return pattern.lstrip("^").strip("()").lower().split("|")


def _is_claim(sentence: Column) -> Column:
    """One of the claim patterns holds. The two that are plain word lists are
    tested with startswith and contains; only the linking-verb one is a regex."""
    def test(low: Column) -> Column:
        starts = T.any_of([F.startswith(low, F.lit(p)) for p in _literals(_STARTS)])
        fact = T.contains_any(low, _literals(_FACT_WORDS))
        return starts | fact | F.rlike(sentence, F.lit("(?i)" + T.spark_pattern(_LINKING)))
    return T.let(F.lower(sentence), test)


def with_claims(chunks: DataFrame, max_claims: int | None = None, into: str = "claims",
                max_chars: int | None = None) -> DataFrame:
    """Add the array of claims of each chunk, in text order: all of them, or the first max_claims of
    fewer than max_chars characters (a browser shows V.MAX_CLAIMS below V.MAX_CLAIM_CHARS)."""
    keep = chunks.columns
    sentences = F.filter(
        F.transform(F.split(F.coalesce("text", F.lit("")), "[.!?]+"), T.js_trim),
        lambda s: T.longer_than(s, V.MIN_CLAIM_CHARS - 1),
    )
    found = chunks.withColumn("_sentences", sentences).withColumn(
        "_claims",
        F.filter("_sentences", lambda s: _is_claim(s) if max_chars is None else ~T.longer_than(s, max_chars - 1) & _is_claim(s)),
    )
    chosen = F.when(F.size("_claims") > 0, F.col("_claims")).otherwise(F.col("_sentences"))
    return found.select(*keep, (chosen if max_claims is None else F.slice(chosen, 1, max_claims)).alias(into))


def extract_claims(
    chunks: DataFrame, key: list[str], max_claims: int | None = None, outer: bool = False
) -> DataFrame:
    """One row per claim: key, claim_pos, claim. With outer, chunks without claims stay."""
    # The outer form keeps Spark from evaluating the claims a second time in a filter.
    rows = with_claims(chunks, max_claims).select(
        *key, F.posexplode_outer("claims").alias("claim_pos", "claim")
    )
    return rows if outer else rows.where("claim is not null")


def extract_statements(chunks: DataFrame, key: list[str], max_claims: int | None = None) -> DataFrame:
    """The claims as typed statements with a place for their analyses."""
    empty = F.array().cast("array<struct<aspect:string,problem_score:double,confidence:double>>")
    statement = F.transform(
        "claims",
        lambda c: F.struct(F.lit("claim").alias("type"), c.alias("summary_text"), empty.alias("analyses")),
    )
    return with_claims(chunks, max_claims).select(*key, statement.alias("statements"))


def normalize_claim(claim: Column) -> Column:
    return F.lower(T.collapse_space(claim))


def claim_id(claim: Column) -> Column:
    """What a claim is joined by: 128 bits of the SHA-256 of its normalised text, so that texts need not be shuffled."""
    return F.substring(F.unhex(F.sha2(normalize_claim(claim), 256)), 1, 16)


def rating_value(rating: Column) -> Column:
    """Number of a rating word; unknown words count as undecided."""
    ratings = F.create_map(*[F.lit(x) for kv in V.RATING_SCORES.items() for x in kv])
    word = F.lower(F.coalesce(rating, F.lit("")))
    return F.coalesce(F.try_element_at(ratings, word), F.lit(0.5))


def rating_score(reviews: Column) -> Column:
    """Mean rating over the reviews; no reviews count as undecided."""
    total = F.aggregate(
        reviews, F.lit(0.0), lambda acc, r: acc + rating_value(r["textual_rating"])
    )
    return F.when(F.size(reviews) > 0, total / F.size(reviews)).otherwise(0.5)


def rating_band(rating: Column) -> Column:
    low = F.lower(F.coalesce(rating, F.lit("")))
    has = lambda *words: T.contains_any(low, list(words))
    return (
        F.when(has("false", "pants on fire"), "false")
        .when(has("true"), "true")
        .when(has("mixture", "half"), "mixture")
        .otherwise("other")
    )


def with_review_defaults(fact_checks: DataFrame) -> DataFrame:
    """Fill missing fields: '' for texts, Unknown publisher, en language."""
    def fill(r: Column) -> Column:
        blank = {"publisher": "Unknown", "language_code": "en"}
        return F.struct(*[
            F.coalesce(T.nullif_blank(r[f]), F.lit(blank.get(f, ""))).alias(f)
            for f in ("publisher", "url", "title", "review_date", "textual_rating", "language_code")
        ])
    reviews = F.coalesce(F.col("reviews"), F.array().cast(REVIEWS))
    return fact_checks.withColumns({
        "text": F.coalesce("text", F.lit("")),
        "claimant": F.coalesce("claimant", F.lit("")),
        "claim_date": F.coalesce("claim_date", F.lit("")),
        "reviews": F.transform(reviews, fill),
    })


def claim_verdicts(fact_checks: DataFrame, name=normalize_claim) -> DataFrame:
    """One row per normalised claim text, or what names it (claim_id): its first fact check, rating, number of checks."""
    checks = fact_checks.select(
        name(F.col("text")).alias("claim_key"),
        "fact_id",
        rating_score(F.col("reviews")).alias("rating"),
        F.get("reviews", F.lit(0)).alias("review"),
    )
    return checks.groupBy("claim_key").agg(
        F.min("fact_id").alias("fact_id"),
        F.min_by("rating", "fact_id").alias("rating"),
        F.min_by("review", "fact_id").alias("review"),
        F.count("*").alias("n_results"),
    )


def match_fact_checks(
    claims: DataFrame, fact_checks: DataFrame, how: str = "exact", threshold: float = 0.8
) -> DataFrame:
    """Left join of claims with the verdict on the same (exact) or on the most
    similar (fuzzy) claim text. Adds fact_id, rating, review and n_results."""
    keyed = claims.withColumn("claim_key", claim_id(F.col("claim")))
    if how == "exact":
        return salted_join(keyed, claim_verdicts(fact_checks, claim_id), ["claim_key"], sketch=True).drop("claim_key")
    if how != "fuzzy":
        raise ValueError(how)
    verdicts = claim_verdicts(fact_checks)
    best = nearest_texts(
        claims.select(normalize_claim(F.col("claim")).alias("claim_key")), verdicts.select("claim_key"), threshold)
    near = best.join(
        verdicts.withColumnRenamed("claim_key", "match_key"), "match_key"
    ).select(claim_id(F.col("claim_key")).alias("claim_key"), "fact_id", "rating", "review", "n_results")
    return salted_join(keyed, near, ["claim_key"]).drop("claim_key")


def word_set(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.array_remove(words, ""))


def word_signature(words: str) -> Column:
    """64 bits, one set for every word of the array."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(w), F.lit(64)))
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseOR(bit(w)))


def prefix_postings(words: DataFrame, ranks: DataFrame, threshold: float) -> DataFrame:
    """id, word, pos (from 1), n, signature: the first words of each word set in the order of ranks, rare words first.

    words: id, word, and where ranks need not name all of a set's words also its n and signature. Sets with a Jaccard
    similarity of at least the threshold share one of their first n - ceil(t n) + 1 words. Words without a rank come before
    all others: they take places, but nothing is met by them.
    """
    whole = [c for c in ("n", "signature") if c in words.columns]
    # Where ranks are few, Spark broadcasts them and the words stay where their text is.
    ranked = salted_join(words, ranks, ["word"], "inner").groupBy("id", *whole).agg(
        F.sort_array(F.collect_list(F.struct("freq", "word"))).alias("ranked")).withColumn("held", F.col("ranked.word"))
    if not whole:
        ranked = ranked.withColumns({"n": F.size("held"), "signature": word_signature("held")})
    n, before = F.col("n"), F.col("n") - F.size("held")
    # ceil with a small allowance, so rounding never shortens the prefix.
    prefix = n - F.ceil(n * threshold - 1e-9).cast("int") + 1
    return ranked.select("id", "n", "signature", before.alias("before"), F.posexplode(
        F.slice("held", F.lit(1), F.greatest(prefix - before, F.lit(0)))).alias("pos", "word")).withColumn(
        "pos", F.col("pos") + F.col("before") + 1).drop("before")


def candidate_pairs(l: DataFrame, r: DataFrame, threshold: float) -> DataFrame:
    """l_id, r_id, each pair once: sets that share a prefix word and may reach the threshold by their sizes, by the places of
    that word and by their signatures."""
    left = l.select(*(F.col(c).alias(f"l_{c}") for c in ("id", "n", "pos", "signature")), "word")
    right = r.select(*(F.col(c).alias(f"r_{c}") for c in ("id", "n", "pos", "signature")), "word")
    least = F.ceil((F.col("l_n") + F.col("r_n")) * (threshold / (1 + threshold)) - 1e-9)
    # At the first word that both share, nothing before it is shared: what follows bounds the overlap.
    by_place = 1 + F.least(F.col("l_n") - F.col("l_pos"), F.col("r_n") - F.col("r_pos"))
    # A bit of one signature that the other has not is a word that only one set has.
    only = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    by_bits = F.least(F.col("l_n") - only("l_signature", "r_signature"), F.col("r_n") - only("r_signature", "l_signature"))
    sizes = (F.col("l_n") >= F.col("r_n") * threshold - 1e-9) & (F.col("r_n") >= F.col("l_n") * threshold - 1e-9)
    return salted_join(left, right, ["word"], "inner").where(sizes & (by_place >= least) & (by_bits >= least)).select("l_id", "r_id").distinct()


def similar_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All pairs of distinct texts whose word sets have Jaccard >= threshold, a number above 0.

    Exact set-similarity join with positional prefixes: texts are known by the 128 bits of their md5, and only postings
    of fixed width (id, word, place, size, signature) meet. Words come once for each pair that may be similar, to be
    compared. Copies of one text count once, and texts meet on words that are rare on the right side, which should be the
    smaller one: a left text most of whose words are in no right text meets none.
    Columns in: claim_key on both sides. Out: claim_key, match_key, similarity.
    """
    def texts_of(side: DataFrame) -> DataFrame:
        return side.select(F.unhex(F.md5("claim_key")).alias("id"), "claim_key").where("id is not null").dropDuplicates(["id"])

    def words_of(texts: DataFrame) -> DataFrame:
        sets = texts.select("id", word_set(F.col("claim_key")).alias("held"))
        return sets.select("id", F.size("held").alias("n"), word_signature("held").alias("signature"), F.explode("held").alias("word"))

    lefts, rights = texts_of(left), texts_of(right)
    ranks = words_of(rights).groupBy("word").agg(F.count("*").alias("freq"))
    pairs = candidate_pairs(prefix_postings(words_of(lefts), ranks, threshold), prefix_postings(words_of(rights), ranks, threshold), threshold)
    lw, rw = word_set(F.col("claim_key")), word_set(F.col("match_key"))
    both = F.size(F.array_intersect(lw, rw))
    similarity = both / (F.size(lw) + F.size(rw) - both)
    met = pairs.join(lefts.withColumnRenamed("id", "l_id"), "l_id").join(
        rights.select(F.col("id").alias("r_id"), F.col("claim_key").alias("match_key")), "r_id")
    return met.select("claim_key", "match_key", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def nearest_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The most similar right text of each left text; ties go to the smaller text."""
    return similar_texts(left, right, threshold).groupBy("claim_key").agg(
        F.min_by("match_key", F.struct(-F.col("similarity"), "match_key")).alias("match_key"),
        F.max("similarity").alias("similarity"),
    )


def _ordered_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x["rating"])


def score_accuracy(
    chunks: DataFrame,
    fact_checks: DataFrame | None,
    key: list[str],
    how: str = "exact",
    max_claims: int | None = None,
) -> DataFrame:
    """Accuracy rows in the shape of score_all: 1 - mean rating of the matched claims.

    fact_checks=None means that no fact-check source is set up.
    """
    E = V.FACT_CHECK_EXPLANATIONS
    if fact_checks is None:
        return chunks.select(*key, *_accuracy_row(
            F.lit(0.5), F.lit(0.0), F.array(F.lit("no_api_key")), F.lit(E["no_source"]), None))
    long_enough = T.longer_than(F.coalesce(F.col("text"), F.lit("")), V.MIN_FACT_CHECK_TEXT - 1)
    claims = extract_claims(chunks.withColumn("_enough", long_enough), [*key, "_enough"], max_claims, outer=True)
    matched = match_fact_checks(claims, fact_checks, how)
    # As many rows as the chunk has claims; sorted to add in claim order.
    checked = F.sort_array(F.collect_list(
        F.when(F.col("rating").isNotNull(), F.struct("claim_pos", "rating"))))
    per_chunk = matched.groupBy(*key).agg(
        F.first("_enough").alias("_enough"),
        F.count("claim_pos").alias("n_claims"),
        F.count("rating").alias("n_found"),
        F.coalesce(F.sum("n_results"), F.lit(0)).alias("n_checks"),
        _ordered_sum(checked).alias("total"),
    ).withColumn("avg_rating", F.when(F.col("n_found") > 0, F.col("total") / F.col("n_found")).otherwise(0.5))

    avg, found = F.col("avg_rating"), F.col("n_found") > 0
    band = F.when(avg < 0.3, "mostly_false").when(avg < 0.5, "partially_false").when(avg > 0.7, "mostly_true")
    flags = (
        F.when(~F.col("_enough"), F.array(F.lit("insufficient_content")))
        .when(F.col("n_claims") == 0, F.array(F.lit("no_claims_found")))
        .when(~found, F.array(F.lit("no_fact_checks_found")))
        .otherwise(F.array_remove(F.array(F.lit("fact_checked"), F.coalesce(band, F.lit(""))), ""))
    )
    before, after = E["prefix"]
    verdict = (
        F.when(avg < 0.3, E["mostly_false"]).when(avg < 0.5, E["partially_false"])
        .when(avg > 0.7, E["mostly_true"]).otherwise(E["other"])
    )
    explanation = (
        F.when(~F.col("_enough"), E["too_short"]).when(F.col("n_claims") == 0, E["no_claims"])
        .when(~found, E["none_found"])
        .otherwise(F.concat(F.lit(before), F.col("n_checks").cast("string"), F.lit(after), verdict))
    )
    skipped = ~F.col("_enough") | (F.col("n_claims") == 0)
    metadata = F.create_map(
        F.lit("claimsChecked"), F.col("n_claims").cast("string"),
        F.lit("factChecksFound"), F.col("n_found").cast("string"),
        F.lit("averageRating"), avg.cast("string"),
    )
    return per_chunk.select(*key, *_accuracy_row(
        F.when(skipped, 0.5).otherwise(F.lit(1.0) - avg),
        F.when(skipped, 0.0).when(found, 0.8).otherwise(0.3),
        flags, explanation, F.when(~skipped, metadata),
    ))


def _accuracy_row(score, confidence, flags, explanation, metadata) -> list[Column]:
    none = F.lit(None).cast("map<string,string>")
    return [
        F.lit("factChecker").alias("module"), F.lit("accuracy").alias("aspect"),
        score.alias("problem_score"), confidence.alias("confidence"), flags.alias("flags"),
        explanation.alias("explanation"), (none if metadata is None else metadata).alias("metadata"),
    ]


def fact_check_report(claims: DataFrame, fact_checks: DataFrame, key: list[str]) -> DataFrame:
    """Per distinct claim and fact check of it: rating, publisher, title and link of the first
    review; one row saying so for a claim without fact checks. A claim stands at its first place
    (in the order of key and claim_pos) with n_claims, how often it is made: n places of a claim with n
    checks give n rows, not n times n.

    Only what is shown goes through the join. Its left side has one row a claim, so neither side is repeated."""
    review = F.get("reviews", F.lit(0))
    checks = fact_checks.select(
        claim_id(F.col("text")).alias("claim_key"), "fact_id",
        F.coalesce(T.nullif_blank(review["textual_rating"]), F.lit("Unknown")).alias("rating"),
        F.coalesce(T.nullif_blank(review["publisher"]), F.lit("Unknown Publisher")).alias("publisher"),
        T.truncate(review["title"], 120, "...").alias("title"), review["url"].alias("url"),
    )
    at = F.struct(*key, "claim_pos")
    keyed = claims.groupBy(claim_id(F.col("claim")).alias("claim_key")).agg(
        F.min(at).alias("at"), F.min_by(T.truncate(F.col("claim"), 150, "..."), at).alias("claim"), F.count(F.lit(1)).alias("n_claims"))
    joined = keyed.select("at.*", "claim", "n_claims", "claim_key").join(checks, "claim_key", "left")
    found = F.col("fact_id").isNotNull()
    return joined.select(
        *key, "claim_pos", "n_claims", "claim", "fact_id",
        F.when(found, F.col("rating")).otherwise("none found").alias("rating"),
        F.when(found, rating_band(F.col("rating"))).alias("band"),
        *(F.when(found, F.col(c)).alias(c) for c in ("publisher", "title", "url")),
    )


def page_fact_checks(matches: DataFrame, page: list[str]) -> DataFrame:
    """Per page, over all of its chunks: claims checked, claims with a fact check, mean rating."""
    return matches.groupBy(*page).agg(
        F.count("claim_pos").alias("claims_checked"),
        F.count("rating").alias("fact_checks_found"),
        F.avg("rating").alias("average_rating"),
    )
