"""Mail-style search over chunk tables: words, key:value, AND, OR, brackets, quotes.

A search is a small value object. It is read once on the driver and becomes one
Column, so Spark sees an ordinary filter.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pagegauge.functions import text as T
from pagegauge.functions.joins import salted_join
from pagegauge.sources.tables import work_dir

_TOKEN = re.compile(r'\(|\)|[A-Za-z_0-9]+:"[^"]*"|"[^"]*"|[^\s()]+')
_PROP = re.compile(r"([A-Za-z_0-9]+):(.+)", re.S)


@dataclass(frozen=True)
class Term:
    value: str
    key: str | None = None

    def __str__(self) -> str:
        text = f'"{self.value}"' if " " in self.value else self.value
        return f"{self.key}:{text}" if self.key else text


@dataclass(frozen=True)
class Search:
    """op joins all terms; a term may itself be a bracketed search."""

    op: str = "AND"
    terms: tuple[Term | Search, ...] = ()

    def __str__(self) -> str:
        parts = [f"({t})" if isinstance(t, Search) and len(t.terms) > 1 else str(t) for t in self.terms]
        return f" {self.op} ".join(parts)


def _group(items: list) -> Search:
    op = "OR" if "OR" in items else "AND"
    terms = [i if isinstance(i, Search) else _term(i) for i in items if i != op]
    return Search(op, tuple(terms))


def _term(token: str) -> Term:
    prop = _PROP.fullmatch(token)
    key, value = (prop[1], prop[2]) if prop else (None, token)
    return Term(value.strip('"') if value.startswith('"') else value, key)


def parse_search(query: str | Search | None) -> Search:
    """Any OR on a level makes that level an OR; otherwise its terms are joined by AND."""
    if isinstance(query, Search):
        return query
    levels: list[list] = [[]]
    for token in _TOKEN.findall(query or ""):
        if token == "(":
            levels.append([])
        elif token == ")" and len(levels) > 1:
            inner = _group(levels.pop())
            levels[-1].append(inner)
        elif token != ")":
            levels[-1].append(token)
    while len(levels) > 1:
        inner = _group(levels.pop())
        levels[-1].append(inner)
    return _group(levels[0])


# --- combining searches -----------------------------------------------------

def _merge(op: str, a, b) -> Search:
    a, b = parse_search(a), parse_search(b)
    if not a.terms or not b.terms:
        return a if a.terms else b
    flat = lambda s: s.terms if s.op == op or len(s.terms) == 1 else (s,)
    return Search(op, flat(a) + flat(b))


def search_all(a, b) -> Search:
    return _merge("AND", a, b)


def search_any(a, b) -> Search:
    return _merge("OR", a, b)


def search_without(a, b) -> Search:
    """Take the terms of b out of a."""
    a, gone = parse_search(a), set(parse_search(b).terms)
    return Search(a.op, tuple(t for t in a.terms if t not in gone))


def search_prop(search, key: str) -> str | None:
    """Value of a top-level key:value term."""
    return next((t.value for t in parse_search(search).terms if isinstance(t, Term) and t.key == key), None)


def with_prop(search, key: str, value: str | bool | None) -> Search:
    """Set a top-level key:value term; None or '' takes it out."""
    search = parse_search(search)
    rest = Search(search.op, tuple(t for t in search.terms if not (isinstance(t, Term) and t.key == key)))
    if value is None or value == "":
        return rest
    text = str(value).lower() if isinstance(value, bool) else value
    return search_all(rest, Search("AND", (Term(text, key),)))


def with_any_prop(search, key: str, values: list[str]) -> Search:
    """Require a key to have one of several values."""
    if not values:
        raise ValueError(f"no values for {key}")
    rest = with_prop(search, key, None)
    return search_all(rest, Search("OR", tuple(Term(v, key) for v in values)))


# --- as filters -------------------------------------------------------------

def search_column(search, text_cols: list[str], columns: list[str], props: str | None = None) -> Column:
    """The search as a boolean Column. Words are looked up in text_cols without regard
    to case; key:value compares the column of that name, or the JSON field in `props`."""
    search = parse_search(search)
    if not search.terms:
        return F.lit(True)

    def one(term) -> Column:
        if isinstance(term, Search):
            return search_column(term, text_cols, columns, props)
        if term.key is None:
            word = F.lit(term.value.lower())
            return T.any_of([F.contains(F.lower(F.coalesce(c, F.lit(""))), word) for c in text_cols])
        if term.key in columns:
            return F.coalesce(F.col(term.key).cast("string") == term.value, F.lit(False))
        if props is not None:
            return F.coalesce(F.get_json_object(props, f"$.{term.key}") == term.value, F.lit(False))
        return F.lit(False)

    join = (lambda a, b: a | b) if search.op == "OR" else (lambda a, b: a & b)
    return reduce(join, [one(t) for t in search.terms])


def search(df: DataFrame, query, text_cols: list[str], props: str | None = None) -> DataFrame:
    return df.where(search_column(query, text_cols, df.columns, props))


def filter_pages(pages: DataFrame, term: str | None) -> DataFrame:
    """Pages with the term in url, title or domain, without regard to case."""
    if not term:
        return pages
    low = F.lit(term.lower())
    fields = [c for c in ("url", "title", "domain") if c in pages.columns]
    return pages.where(T.any_of([F.coalesce(F.contains(F.lower(c), low), F.lit(False)) for c in fields]))


SORTABLE = ("id", "url", "title", "domain", "fingerprint", "created", "updated")


def list_items(
    df: DataFrame, q=None, sort: str = "updated desc", limit: int | None = None,
    text_cols: list[str] | None = None, sortable: tuple[str, ...] = SORTABLE,
) -> DataFrame:
    """Filtered and sorted list. Only known columns can be sorted by; with a limit
    Spark keeps the top rows per task instead of sorting everything."""
    order = []
    for part in sort.split(","):
        name, _, direction = part.strip().partition(" ")
        if name not in sortable or name not in df.columns or direction.strip().lower() not in ("", "asc", "desc"):
            raise ValueError(f"cannot sort by {part.strip()!r}")
        order.append(F.col(name).desc() if direction.strip().lower() == "desc" else F.col(name).asc())
    found = search(df, q, text_cols or ["text"]) if q else df
    listed = found.orderBy(*order)
    return listed if limit is None else listed.limit(limit)


def _terms(queries: DataFrame) -> DataFrame:
    # In steps, so that Spark splits a search once.
    tokens = queries.select("query_id", F.array_remove(F.split("query", " +"), "").alias("tokens"))
    op = F.when(F.array_contains("tokens", "OR"), "OR").otherwise("AND")
    return tokens.select("query_id", "tokens", op.alias("op")).select(
        # Only the operator as written, in capitals, is no search word.
        "query_id", "op", F.array_distinct(F.transform(F.array_except("tokens", F.array("op")), F.lower)).alias("terms"))


def search_terms(queries: DataFrame) -> DataFrame:
    """query_id, op, terms (distinct, lower case) of flat AND/OR searches; those without a term are left out."""
    return _terms(queries).where("size(terms) > 0")


def search_anchors(terms: DataFrame, frequency: DataFrame) -> DataFrame:
    """Where a search looks for chunks: query_id, op, n_terms, word. An AND search has its rarest term (ties: the smallest) as
    its only anchor, and none if some term is in no chunk; an OR search has all its terms that occur.

    frequency: word, n (the chunks that hold a word).
    """
    each = terms.select("query_id", "op", F.size("terms").alias("n_terms"), F.explode("terms").alias("word")).join(frequency, "word")
    rarest = each.where("op = 'AND'").groupBy("query_id", "op", "n_terms").agg(
        F.count(F.lit(1)).alias("met"), F.min(F.struct("n", "word")).alias("rarest")).where("met = n_terms")
    return each.where("op = 'OR'").select("query_id", "op", "n_terms", "word").unionByName(
        rarest.select("query_id", "op", "n_terms", F.col("rarest.word").alias("word")))


def word_bag(text: str = "text", props: list[str] | None = None) -> Column:
    """The distinct words of a text and its key:value pairs, as searches name them."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    pairs = [F.concat(F.lit(f"{p}:"), F.lower(F.coalesce(F.col(p).cast("string"), F.lit("")))) for p in props or []]
    return F.array_distinct(F.concat(words, F.array(*pairs)) if pairs else words)


#: Pieces of searches that one pass over the chunks looks for, and terms of a piece that the pass itself tests.
PIECES, TERMS = 200_000, 4
#: Words in a smaller share of the chunks are all equally rare.
OFTEN = 0.001
#: Chunks whose words are held as bits at a time (a multiple of 64), and pieces that meet them at a time.
CHUNKS, GROUP = 8_192, 4_096


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _set_id(op: Column | str, numbers: Column | str) -> Column:
    return F.unhex(F.md5(F.concat_ws(" ", op, F.col(numbers).cast("array<string>") if isinstance(numbers, str) else numbers.cast("array<string>"))))


def search_pieces(searches: DataFrame, often: DataFrame) -> DataFrame:
    """Searches as pieces that no chunk meets two of: search, piece, anchor, size, need, avoid, more_need, more_avoid.

    An AND search is one piece, found by its rarest term (anchor), the others needed. An OR search is a piece per term:
    chunks that hold it and none of the more frequent ones. Pieces of equal terms have one name, whichever search has them.
    need and avoid hold the TERMS most selective terms, the rest is in more_*; size is how many terms a chunk needs.

    searches: search, op, numbers (of terms). often: number, n (the chunks that hold a word).
    """
    # At most so many words are in a share of OFTEN of the chunks as 1 / OFTEN chunks hold words.
    known = often.orderBy("number").toArrow()
    keys, counts = (np.append(known.column(c).to_numpy(), 0) for c in ("number", "n"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("numbers")
            numbers = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys[:-1], numbers)
            n = np.where((at < len(keys) - 1) & (keys[at] == numbers), counts[at], 0)
            order = np.lexsort((numbers, n, np.repeat(np.arange(len(sizes)), sizes)))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("search"), batch.column("op"), pa.ListArray.from_arrays(ends, pa.array(numbers[order], pa.int64()))], names=["search", "op", "terms"])

    ranked = searches.select("search", "op", "numbers").mapInArrow(rank, "search binary, op string, terms array<bigint>")
    terms, none = F.col("terms"), F.array().cast("array<bigint>")
    rest = lambda i: F.slice("terms", i + F.lit(2), F.size("terms"))
    name = lambda anchor, avoid: _set_id(F.concat(F.lit("OR "), anchor.cast("string")), F.sort_array(avoid))
    one = F.array(F.struct(F.col("search").alias("piece"), F.get("terms", F.lit(0)).alias("anchor"), rest(F.lit(0)).alias("need"), none.alias("avoid")))
    each = F.transform("terms", lambda t, i: F.struct(
        name(t, rest(i)).alias("piece"), t.alias("anchor"), none.alias("need"), F.reverse(rest(i)).alias("avoid")))
    parts = ranked.select(
        "search", F.inline(F.when(F.col("op") == "AND", one).otherwise(each)))
    first, later = lambda c: F.slice(c, 1, TERMS), lambda c: F.slice(c, F.lit(TERMS + 1), F.size(c))
    return parts.select(
        "search", "piece", "anchor", (F.size("need") + 1).alias("size"), first("need").alias("need"), first("avoid").alias("avoid"),
        later("need").alias("more_need"), later("avoid").alias("more_avoid"))


def count_pieces(bags: DataFrame, key: list[str], pieces: DataFrame) -> DataFrame:
    """The chunks that meet each piece, counted some chunks at a time: their first key, piece, n. All terms of a piece are in
    need and avoid, TERMS at most in each.

    For each term of a piece there is a bit for each chunk, so a pair of chunk and piece costs a few bits.
    """
    table = pieces.select(
        "piece", "anchor", *[F.coalesce(F.get("need", F.lit(i)), "anchor").alias(f"need{i}") for i in range(TERMS)],
        *[F.coalesce(F.get("avoid", F.lit(i)), "anchor").alias(f"avoid{i}") for i in range(TERMS)], F.size("avoid").alias("n")).orderBy("anchor").toArrow()
    names = table.column("piece").combine_chunks()
    terms = np.stack([table.column(i).to_numpy() for i in range(1, 2 + 2 * TERMS)])
    more = np.arange(TERMS)[:, None] < table.column("n").to_numpy()
    single = len(key) == 1
    schema = bags.select(*key, F.lit(b"").alias("piece"), F.lit(0).cast("long").alias("n")).schema

    def meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        # As min() has it: a null key is no first one, and nulls in a key of several columns come first.
        rows = rows.take(pc.sort_indices(rows, [(k, "ascending") for k in key], null_placement="at_end" if single else "at_start")).combine_chunks()
        bag, width = rows.column("bag").combine_chunks(), CHUNKS // 8
        numbers = bag.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(numbers, kind="stable")
        numbers, at = numbers[order], np.repeat(np.arange(len(bag)), pc.list_value_length(bag).to_numpy(zero_copy_only=False))[order]
        held = np.append(numbers, 0)[np.minimum(np.searchsorted(numbers, terms[0]), len(numbers))] == terms[0] if len(numbers) else np.zeros(len(names), bool)
        wanted = np.flatnonzero(held)
        for i in range(0, len(wanted), GROUP):
            own = wanted[i:i + GROUP]
            words, index = np.unique(terms[:, own], return_inverse=True)
            index = index.reshape(len(terms), len(own))
            low, high = np.searchsorted(numbers, words, "left"), np.searchsorted(numbers, words, "right")
            n = high - low
            of = at[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]
            cells = np.repeat(np.arange(len(words)), n) * width + (of >> 3)
            heads = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            bits = np.zeros((len(words) + 1) * width, np.uint8)
            bits[cells[heads]] = np.add.reduceat(128 >> (of & 7), heads)
            bits = bits.reshape(-1, width).view(np.uint64)  # the last row is that of no chunk
            met = bits[index[0]]
            for k in range(TERMS):
                met &= bits[index[1 + k]]
                met &= ~bits[np.where(more[k, own], index[1 + TERMS + k], len(words))]
            n = np.bitwise_count(met).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(n)
            some = met[hit].view(np.uint8)
            byte = (some != 0).argmax(axis=1)
            first = byte * 8 + 8 - np.frexp(some[np.arange(len(hit)), byte].astype(np.float32))[1]
            yield pa.RecordBatch.from_arrays([
                *(rows.column(k).combine_chunks().take(pa.array(first)) for k in key), names.take(pa.array(own[hit])), pa.array(n[hit])], names=[*key, "piece", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNKS):
                part = batch.slice(i, CHUNKS)
                if sum(b.num_rows for b in held) + part.num_rows > CHUNKS:
                    yield from meet(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from meet(pa.Table.from_batches(held))

    return bags.select(*key, "bag").mapInArrow(count, schema)


def match_saved_searches(
    chunks: DataFrame, queries: DataFrame, key: list[str], text: str = "text", props: list[str] | None = None, totals: bool = False
) -> DataFrame:
    """Which saved searches match which chunks: (key, query_id). Keys tell chunks apart. With `totals`, how many chunks a
    search matches and the first of them: (query_id, n, first), without listing the pairs; first is a struct if the key
    has several columns.

    queries: query_id, query (flat AND/OR of whole words and key:value terms).
    Equal searches are one, and searches are cut into pieces that no chunk meets two of (search_pieces), many of which
    searches share. Chunks are not shuffled: their words, as 64-bit numbers that are made sure to differ, meet PIECES
    pieces at a time, which look a chunk's other words up in the row at hand, or with `totals` are counted by bits of the chunks
    that hold each term (count_pieces). A frequent term costs nothing as long as a
    search has a rarer one. Only the few chunks that pass for a piece of more than TERMS other terms, and are not equal to
    it, are joined with its other terms. The tables between the steps are written to a work folder.
    """
    spark, home = chunks.sparkSession, work_dir(chunks.sparkSession, "saved_searches")
    # Both are read several times, and patterns cost most of the work.
    words = _kept(chunks.select(*key, word_bag(text, props).alias("words")), f"{home}/words")
    asked = _kept(_terms(queries), f"{home}/asked").where("size(terms) > 0")
    heard = words.select(F.explode("words").alias("word"), F.lit(1).alias("n")).unionByName(
        asked.select(F.explode("terms").alias("word"), F.lit(0).alias("n")))
    for seed in itertools.count():
        number = lambda w: F.xxhash64(F.lit(seed), w)  # noqa: B023, E731
        bags = words.select(*key, F.transform("words", number).alias("bag")).select(
            F.monotonically_increasing_id().alias("row"), *key, "bag", _set_id(F.lit("AND"), F.sort_array("bag")).alias("own"))
        bags = _kept(bags, f"{home}/bags{seed}")
        other = F.xxhash64(F.lit(-1 - seed), "word")
        counted = heard.select(number(F.col("word")).alias("number"), other.alias("other"), "n").groupBy("number").agg(
            F.sum("n").alias("n"), (F.min("other") != F.max("other")).alias("shared"))
        often = _kept(counted.where(F.col("shared") | (F.col("n") > bags.count() * OFTEN)), f"{home}/often{seed}")
        if often.where("shared").isEmpty():
            break
    repeated = lambda: not bags.groupBy(*key).count().where("count > 1").isEmpty()
    if again := repeated():
        bags = _kept(bags.dropDuplicates([*key, "own"]), f"{home}/once")
        again = repeated()

    sets = asked.select("query_id", "op", F.sort_array(F.transform("terms", number)).alias("numbers"))
    sets = sets.withColumn("op", F.when(F.size("numbers") == 1, "AND").otherwise(F.col("op"))).withColumn("search", _set_id("op", "numbers"))
    sets = _kept(sets, f"{home}/sets")
    parts = _kept(search_pieces(sets.select("search", "op", "numbers").dropDuplicates(["search"]), often.select("number", "n")), f"{home}/pieces")
    members = sets.select("query_id", "search").distinct()

    listed = not totals or again
    least = F.min(key[0]) if len(key) == 1 else F.min(F.struct(*key))
    found = lambda met: met.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), least.alias("first"))
    known = lambda c, i: F.array_contains("bag", F.get(c, F.lit(i)))  # null: there is no such term
    passes = reduce(lambda a, b: a & b, [
        *(F.coalesce(~known("avoid", i), F.lit(True)) for i in range(TERMS)), *(F.coalesce(known("need", i), F.lit(True)) for i in range(TERMS))])
    open_piece = (F.size("more_need") > 0) | (F.size("more_avoid") > 0)
    places = bags.select("row", *key, "bag", "own", F.explode("bag").alias("anchor"))

    def met(wanted: Column, name: str, use: Callable[[DataFrame], DataFrame], counts: bool = False) -> DataFrame:
        some = parts.where(wanted)
        blocks = -(-some.agg(F.approx_count_distinct("piece")).first()[0] // PIECES)
        for b in range(blocks):
            block = some.where(F.pmod(F.xxhash64("piece"), F.lit(blocks)) == b).select(
                "piece", "anchor", "size", "need", "avoid").dropDuplicates(["piece"])
            if counts:
                rows = count_pieces(bags, key, block).groupBy("piece").agg(F.sum("n").alias("n"), least.alias("first"))
            else:
                rows = use(places.join(F.broadcast(block), "anchor").where(passes & (F.size("bag") >= F.col("size"))))
            rows.write.parquet(f"{home}/{name}/{b}")
        schema = use(places.join(some, "anchor")).schema
        return spark.read.schema(schema).parquet(*[f"{home}/{name}/{b}" for b in range(blocks)]) if blocks else spark.createDataFrame([], schema)

    pairs = lambda rows: rows.select(*key, "piece")
    sure = met(~open_piece, "sure", pairs if listed else found, counts=not listed)
    likely = met(open_piece, "likely", lambda rows: rows.select("row", *key, "piece", (F.col("own") == F.col("piece")).alias("equal")))
    more = parts.where(open_piece).select("piece", "more_need", "more_avoid").dropDuplicates(["piece"])
    tested = likely.where("not equal").join(more, "piece").join(bags.select("row", "bag"), "row").where(
        (F.size(F.array_except("more_need", "bag")) == 0) & ~F.arrays_overlap("more_avoid", "bag"))
    rest = pairs(likely.where("equal")).unionByName(pairs(tested))

    owners = parts.select("search", "piece")
    if listed:
        hits = salted_join(sure.unionByName(rest), owners, ["piece"], "inner").drop("piece")
        hits = salted_join(hits, members, ["search"], "inner").select(*key, "query_id")
        if not again:
            return hits
        hits = hits.distinct()
        return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), least.alias("first")) if totals else hits
    by_search = salted_join(owners, sure.unionByName(found(rest)), ["piece"], "inner").groupBy("search").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"))
    return salted_join(members, by_search, ["search"], "inner").select("query_id", "n", "first")
