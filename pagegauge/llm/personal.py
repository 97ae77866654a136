"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Base entities (e-mail, IP address, card, phone) are matched by their formats. Words that stand before identifiers are the
lexical patterns. Patterns and the identifiers after them form a graph; entities found by format seed it, and by turns
patterns are scored by their identifiers and identifiers by their patterns. What follows a pattern of high confidence is
personal data too, whatever its format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Expressions in Java's syntax. Each matches what the plain one in its comment matches from left to right, apart from matches
#: that the checks in VALID drop, but without recursion and without trying a run again from its inside.
FORMATS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 12 to 19 digits
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap expressions that a text with a match also matches, to leave most texts out at once.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]", "id": "[0-9]{3}"}
BASE = tuple(FORMATS)
#: Identifiers that patterns are sought for: 6 to 64 word-like characters with three digits in a row.
IDENTIFIER = (r"(?<![A-Za-z0-9_.@+-])(?=[A-Za-z0-9_.@+-]{0,61}?[0-9]{3})[A-Za-z0-9_.@+-]{6,64}+(?![A-Za-z0-9_.@+-])")
#: A pattern extracts if so many different identifiers follow it and its confidence is so high; rounds of scoring.
LEAST_IDENTIFIERS, LEAST_CONFIDENCE, ROUNDS = 5, 0.9, 3
#: Found identifiers that may be sent to every executor (two numbers and a key each); more are joined by shuffle.
SENT_ROWS = 100_000
#: Prefix sums are made in runs of this length.
RUN = 256


def running(array: str) -> str:
    """SQL: the running sums of an array of bigint, summed in runs so that no step copies a long array."""
    runs = f"transform(sequence(0, greatest(size({array}) - 1, 0) div {RUN}), b -> slice({array}, b * {RUN} + 1, {RUN}))"
    grow = "concat(acc, array(coalesce(try_element_at(acc, -1), 0L) + v))"
    sums = f"transform({runs}, x -> aggregate(x, cast(array() as array<bigint>), (acc, v) -> {grow}))"
    before = f"aggregate({runs}, array(0L), (acc, x) -> concat(acc, array(try_element_at(acc, -1) + aggregate(x, 0L, (s, v) -> s + v))))"
    return f"flatten(zip_with({sums}, slice({before}, 1, size({runs})), (x, o) -> transform(x, v -> v + o)))"


def matches(df: DataFrame, text: str, kind: str, expression: str) -> DataFrame:
    """Add column m_<kind>: array<struct<start, end, found, left>>, code points, with up to 64 characters before each match."""
    rx = F.lit(expression)
    # Most texts have no match: a search or two decide whether to cut the text.
    one = F.col(text).rlike(NEEDS[kind]) & F.col(text).rlike(expression)
    found, cut, deltas, starts = (f"{p}_{kind}" for p in ("f", "c", "d", "s"))
    df = df.withColumn(found, F.when(one, F.regexp_extract_all(text, rx, F.lit(0))))
    df = df.withColumn(cut, F.when(F.size(found) > 0, F.split(text, expression, -1)))
    df = df.withColumn(deltas, F.expr(f"transform({found}, (x, i) -> cast(length({cut}[i]) + if(i > 0, length({found}[i - 1]), 0) as bigint))"))
    df = df.withColumn(starts, F.when(F.size(found) > 0, F.expr(running(deltas))))
    rows = (f"transform({found}, (x, i) -> named_struct('start', {starts}[i], 'end', {starts}[i] + length(x), "
            f"'found', x, 'left', right({cut}[i], 64)))")
    none = "cast(array() as array<struct<start:bigint,end:bigint,found:string,left:string>>)"
    return df.withColumn(f"m_{kind}", F.coalesce(F.expr(rows), F.expr(none))).drop(found, cut, deltas, starts)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    turned = F.reverse(_digits(found))
    doubled = F.transform(F.split(turned, ""), lambda d, i: F.when(i % 2 == 1, F.element_at(
        F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, v: s + v) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    size = F.length(_digits(found))
    if kind == "ip":
        bare = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(bare, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(size.between(12, 19), _luhn(found)).otherwise(False)
    return size.between(9, 15) if kind == "phone" else F.lit(True)


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """Add _base: array<struct<start, rank, kind, end>> of the entities found by their formats, in order."""
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for kind, expression in FORMATS.items():
        df = matches(df, "_text", kind, expression)

    def spans(rank: int, kind: str) -> Column:
        valid = F.filter(f"m_{kind}", lambda m: _valid(kind, m.found))
        return F.transform(valid, lambda m: F.struct(
            m.start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m.end.alias("end")))

    return df.withColumn("_base", F.array_sort(F.concat(*(spans(r, k) for r, k in enumerate(BASE))))).drop(*(f"m_{k}" for k in BASE))


def occurrences(docs: DataFrame, text: str) -> DataFrame:
    """key, text_hash, start, end, instance, kind (of the entity that it is or ends, or null), pattern: one row per
    identifier and pattern."""
    df = matches(docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))), "_text", "id", IDENTIFIER)
    # explode_outer: for explode, Spark puts a filter below that works out all expressions above the text once more.
    rows = df.select("key", F.xxhash64("_text").alias("text_hash"), F.explode_outer("m_id").alias("m")).where("m is not null")
    rows = rows.select("key", "text_hash", F.col("m.start").alias("start"), F.regexp_replace("m.found", "[.@+-]+$", "").alias("instance"), "m.left")
    proven = F.when(F.col("instance").rlike(f"^(?:{FORMATS['email']})$"), F.lit("email"))
    for kind in ("ip", "card"):
        proven = proven.when(F.col("instance").rlike(f"^(?:{FORMATS[kind]})$") & _valid(kind, F.col("instance")), F.lit(kind))
    # A phone's last part, its beginning standing before it, or all of it.
    proven = proven.when(F.concat("left", "instance").rlike(r"\+[0-9][\x20().0-9-]+[0-9]$"), F.lit("phone"))
    rows = rows.select(
        "key", "text_hash", "start", (F.col("start") + F.length("instance")).alias("end"), "instance", proven.alias("kind"),
        F.lower(F.trim(F.regexp_extract("left", r"\S{1,30}\s{0,4}$", 0))).alias("one"),
        F.lower(F.trim(F.regexp_extract("left", r"(?<!\S)\S{1,30}\s{1,4}\S{1,30}\s{0,4}$", 0))).alias("two"))
    patterns = F.filter(F.array("one", "two"), lambda p: p != "")
    return rows.withColumn("pattern", F.explode(F.array_distinct(patterns))).drop("one", "two")


def confident_patterns(found: DataFrame) -> DataFrame:
    """pattern, confidence: those that extract. Scores go back and forth over the distinct (pattern, identifier) pairs."""
    edges = saved(found.groupBy("pattern", F.xxhash64("instance").alias("instance")).agg(F.max("kind").alias("kind")), "edges")
    # Seeds are what a format proves; of the rest nothing is known at first.
    known = edges.groupBy("instance").agg(F.max(F.col("kind").isNotNull().cast("double")).alias("seed"))
    belief = known.withColumn("belief", F.col("seed"))
    scored = None
    for turn in range(ROUNDS):
        scored = edges.select("pattern", "instance").join(belief, "instance").groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n"), (F.sum("belief") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.max("seed").alias("seeded"))
        scored = saved(scored.where("seeded > 0"), f"patterns_{turn}")
        if turn < ROUNDS - 1:
            # An identifier is believed as far as the best pattern before it, seeds in full.
            best = edges.join(scored.where(F.col("n") >= LEAST_IDENTIFIERS), "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
            belief = known.join(best, "instance", "left").select(
                "instance", "seed", F.greatest("seed", F.coalesce("best", F.lit(0.0))).alias("belief"))
    return scored.where((F.col("n") >= LEAST_IDENTIFIERS) & (F.col("confidence") >= LEAST_CONFIDENCE)).select("pattern", "confidence")


def find_personal(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add `spans`: array<struct<kind, start, end>> of personal data in the whole text, code points, end exclusive.

    Kinds email, ip, card and phone are what the formats match (leftmost, not overlapping within a kind, failing matches
    dropped); kind context is what follows a confident pattern and is none of those itself. Order: start, then kind as
    listed. Null and empty texts have no spans. Repeated rows get the same spans; a null id is an id; an empty table
    gives an empty one. A column named spans is replaced; all others, whatever their names, travel in one struct beside
    the columns that the search adds.

    Spans by format need no shuffle. What is shuffled are identifiers with a pattern, and finally the few found spans.
    """
    kept = [c for c in docs.columns if c != "spans"]
    plain = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("t"))
    found = saved(occurrences(plain, "t"), "identifiers")
    patterns = confident_patterns(found)
    new = found.where("kind is null").join(patterns, "pattern").select("key", "text_hash", "start", "end").distinct()
    # One row for each text with such spans: as many spans as the text holds.
    new = saved(new.groupBy("key", "text_hash").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.lit(len(BASE)).alias("rank"), F.lit("context").alias("kind"), "end"))).alias("_new")), "found")
    if new.count() <= SENT_ROWS:
        new = F.broadcast(new)
    # Joined below the expressions: constraints that the optimiser derives for a join double with each of them.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"))
    hashed = F.xxhash64(F.coalesce(f"_row.`{text}`", F.lit("")))
    on = F.col(f"_row.`{doc_id}`").eqNullSafe(F.col("key")) & (hashed == F.col("text_hash"))
    joined = rows.join(new, on, "left").select("_row", "_new")
    spans = F.array_sort(F.concat("_base", F.coalesce("_new", F.expr("slice(_base, 1, 0)"))))
    marked = with_base(joined, f"_row.`{text}`").select("_row", F.transform(spans, lambda s: F.struct(s.kind, s.start, s.end)).alias("spans"))
    return marked.select("_row.*", "spans")


def masked(text: str, spans: str) -> Column:
    """The text with each stretch of overlapping spans replaced by the kind of its first one, in brackets."""
    stretches = (
        f"aggregate({spans}, cast(array() as array<struct<kind:string,start:bigint,end:bigint>>), (acc, s) -> "
        "if(size(acc) > 0 and s.start < try_element_at(acc, -1).end, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('kind', try_element_at(acc, -1).kind, 'start', try_element_at(acc, -1).start, "
        "'end', greatest(s.end, try_element_at(acc, -1).end)))), concat(acc, array(s))))")
    parts = (
        f"transform({stretches}, (s, i) -> s)")
    return F.expr(
        f"case when size({spans}) > 0 then concat(array_join(zip_with("
        f"{parts}, concat(array(0L), transform({parts}, s -> s.end)), (s, before) -> "
        f"if(s is null, substring({text}, cast(before + 1 as int)), "
        f"concat(substring({text}, cast(before + 1 as int), cast(s.start - before as int)), '[', upper(s.kind), ']'))), ''), '') else {text} end")
