"""Exact n-gram Jaccard join with a token-group matrix.

A document is the set of its word shingles. Similar sets are put together in groups, and a matrix of tokens and groups
(the union of a group's tokens) tells which pairs of groups can hold a similar pair: only those are opened. In an opened
pair a set is held against the other group's token union first, and against its members only if that bound suffices.

Links serve to find connected components, so pairs whose sets are known to be connected need no comparison: each group
is first held against the hub group of its family, and the matrix search is left with pairs of different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free, memory, saved, slices, small_batches
from .components import connected
from .decontaminate import grams

#: Sets in a group, and tokens in a group (a larger set is a group by itself).
GROUP_SETS, GROUP_TOKENS = 64, 16_384
#: Members of one component in a family from which they get groups of their own.
OWN_GROUPS = 16
#: A run of so many tokens is counted at once; tokens LOCAL times or more in a run are reported as frequent, and the
#: FREQUENT most frequent ones come last in the order of tokens. Any order gives the same result; rare first is cheaper.
RUN, LOCAL, FREQUENT = 1_000_000, 8, 1 << 17
#: Words a worker remembers before it starts anew; changes no result.
REMEMBERED = 200_000
#: Bits that tell which documents a set is wanted of (4 MB at most, however many they are); changes no result.
MARKS = 1 << 25
#: Slices of the tokens, and of the groups' families, that are exchanged one after the other, so that the shuffle files (and
#: the stored groups) of one are on disk at a time.
SLICES, GROUP_SLICES = 8, 4
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_known: dict[bytes, int] = memory()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct n-word shingles; of fewer words, the whole sequence; of none, nothing.
    Words are what ASCII white space separates, after lower-casing A-Z."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(_known) > REMEMBERED:
        _known.clear()
    ids = []
    for w in words:
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    return np.unique(grams(np.array(ids, np.uint64), min(n, len(ids)))) if ids else np.empty(0, np.uint64)


def least_overlap(n, percent: int):
    """Tokens that a set of n shares at least with any set linked to it."""
    return -(-n * percent // 100)


def wanted(n, percent: int):
    """Tokens that two linked sets share at least among the first ones of each, for the smaller of them having n tokens."""
    return np.minimum(least_overlap(n, percent), 1 + n // 20)


def least_overlap_sql(n: str, percent: int) -> str:
    return f"(({n} * {percent} + 99) div 100)"


def wanted_sql(n: str, percent: int) -> Column:
    """The same as `wanted`, over a column of positive sizes."""
    return F.expr(f"least({least_overlap_sql(n, percent)}, 1 + {n} div 20)")


def first_tokens(tokens: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first tokens of a set in the common order: rare ones first, then by value."""
    n = len(tokens)
    most = n - least_overlap(n, percent) + int(wanted(np.int64(n), percent))
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        weight = np.where(frequent[at] == tokens, counts[at], 0)
        tokens = tokens[np.argsort(weight, kind="stable")]
    return tokens[:most]


def frequent_tokens(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that are frequent in some run of the input, sorted, with their counts over those runs; of bounded number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report():
            own, many = np.unique(np.concatenate(held), return_counts=True)
            keep = many >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(own[keep].view(np.int64)), pa.array(many[keep].astype(np.int64))], names=["token", "n"])

        for batch in slices(batches, text):
            for x in batch.column(text).to_pylist():
                held.append(shingles(x, n))
                size += len(held[-1])
                if size >= RUN:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    rows = (docs.select(text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow())
    tokens, counts = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def compare(left: list, right: list | None, percent: int) -> list[tuple[int, int]]:
    """Links between two groups (or inside one) of (rep, component, tokens): enough to connect what is linked."""
    members = left + (right or [])
    rows, cols = range(len(left)), range(len(left), len(members)) if right else range(len(left))
    sizes = np.array([len(m[2]) for m in members], np.int64)
    values, inverse = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True)
    owner = np.repeat(np.arange(len(members)), sizes)
    # Tokens of one set only can't be shared.
    many = np.bincount(inverse)
    keep = many[inverse] > 1
    if not keep.any():
        return []
    column = np.cumsum(many > 1) - 1
    held = np.zeros((len(members), int(column[-1]) + 1), np.float32)
    held[owner[keep], column[inverse[keep]]] = 1
    a, b = held[rows.start:rows.stop], held[cols.start:cols.stop]
    na, nb = sizes[rows.start:rows.stop], sizes[cols.start:cols.stop]
    # The bound of the matrix: what a set shares with the other group's union.
    union = (b.max(0) > 0).astype(np.float32)
    open_ = np.flatnonzero(a @ union >= -(-np.maximum(na * percent, nb.min() * percent) // 100))
    if not len(open_):
        return []
    shared = (a[open_] @ b.T).astype(np.int64)
    linked = 100 * shared >= percent * (na[open_, None] + nb[None, :] - shared)
    parent = {m[1]: m[1] for m in members}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(linked)):
        x, y = members[open_[i]], members[cols.start + j]
        p, q = root(x[1]), root(y[1])
        if p != q:
            parent[max(p, q)] = min(p, q)
            links.append((x[0], y[0]))
    return links


def opened(pairs: DataFrame, percent: int) -> DataFrame:
    """Links found in pairs of groups: columns left, right (null: inside left) of arrays of (rep, component, tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(rows):
            return rows and [(r["rep"], r["component"], np.frombuffer(r["tokens"], np.uint64)) for r in rows]

        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (group(batch.column(c)[i].as_py()) for c in ("left", "right"))
                links = compare(left, right, percent)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return pairs.select("left", "right").mapInArrow(run, "a long, b long")


def marked(texts: DataFrame, wanted: DataFrame, others: bool = False) -> DataFrame:
    """Texts without most of those whose document is not in `wanted` (rep), or the others, none of which is in it. What is
    sent are MARKS bits, so its size is bounded; where they are all set, every text remains, and no others."""
    place = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(MARKS)).alias("place"))
    bits = place.groupBy(F.expr("place div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(place % 32768)").alias("bits"))
    own = texts.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))).withColumn("bucket", F.expr("place div 32768"))
    byte = "cast(conv(hex(substring(bits, int(place % 32768 div 8) + 1, 1)), 16, 10) as bigint)"
    is_set = F.expr(f"coalesce(bit_get({byte}, int(place % 8)) = 1, false)")
    return own.join(F.broadcast(bits), "bucket", "left").where(~is_set if others else is_set).select(*texts.columns)


def whole(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows of `wanted` (rep and any further columns) with name and tokens: the whole token sets of those documents.
    Sets are made from the texts again, as these pack better than tokens do; of repeated rows a task passes on one."""
    joined = marked(texts, wanted).join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").withColumnRenamed("doc_id", "rep")
    names = ["rep", *(c for c in wanted.columns if c != "rep")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, "text"):
            kept, digests, sets = [], [], []
            for i, (rep, x) in enumerate(zip(batch.column("rep").to_pylist(), batch.column("text").to_pylist())):
                own = shingles(x, n).tobytes()
                name = hashlib.blake2b(own, digest_size=16).digest()
                if own and (rep, name) not in seen:
                    seen.add((rep, name))
                    kept.append(i)
                    digests.append(name)
                    sets.append(own)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).take(pa.array(kept, pa.int64())).columns, pa.array(digests, pa.binary()), pa.array(sets, pa.binary())],
                names=[*names, "name", "tokens"])

    fields = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in names)
    return joined.select(*names, "text").mapInArrow(run, f"{fields}, name binary, tokens binary")


def packed(texts: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """gid, parts, sets: the groups with their members' whole token sets. Groups are bounded by GROUP_SETS and GROUP_TOKENS
    (about). All three steps share one shuffle by gid."""
    rows = whole(texts, members.select("rep", "component", "gid", "parts"), n).repartition("gid").dropDuplicates(["gid", "rep", "name"])
    return rows.groupBy("gid").agg(F.max("parts").alias("parts"), F.collect_list(F.struct("rep", "component", "tokens")).alias("sets"))


def grouped(members: DataFrame, *family: str) -> DataFrame:
    """Add gid and parts: the members of a family dealt out to so many groups by hash as the bounds ask for."""
    crowd = members.groupBy(*family).agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("total"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in family]
    on = same[0] if len(same) == 1 else same[0] & same[1]
    parts = F.greatest(F.ceil(F.col("many") / GROUP_SETS), F.ceil(F.col("total") / GROUP_TOKENS))
    sub = F.pmod(F.xxhash64("rep"), parts)
    return members.alias("m").join(crowd.alias("c"), on).select(
        "m.*", parts.cast("long").alias("parts"), F.concat_ws("/", *(F.coalesce(F.col(f"m.{c}").cast("string"), F.lit("-")) for c in family), sub.cast("string")).alias("gid"))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: documents link when 100 * intersection >= percent * union.

    component_id is the smallest doc_id that links reach, the document itself included. Null texts and texts without words
    have no shingles and no links. Equal sets are one node of the search (copies are never paired), so groups of copies of
    any size cost one comparison; a doc_id in several rows is one document whose texts all count. Rows with a null id are
    linked to nothing beyond equal sets, and get the component of those, or null. An empty table gives an empty one.
    No link is lost: tokens are 64-bit hashes of shingles (equal hashes of different shingles, about one in 10^19 pairs,
    would count as shared), and every pair that could be linked is compared or already connected.
    """
    small_batches(docs.sparkSession)
    frequent, counts = frequent_tokens(docs, text, n)
    sent = docs.sparkSession.sparkContext.broadcast((frequent, counts))
    slices_of_first = [f"first_{i}" for i in range(SLICES)]

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, many = sent.value
        for batch in slices(batches, "text"):
            sizes, names, firsts = [], [], [[] for _ in range(SLICES)]
            for x in batch.column("text").to_pylist():
                own = shingles(x, n)
                sizes.append(len(own))
                names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                first = first_tokens(own, percent, often, many)
                for i in range(SLICES):
                    firsts[i].append(first[first % SLICES == i].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), *(pa.array(f, pa.list_(pa.int64())) for f in firsts)],
                names=["doc_id", "n", "name", *slices_of_first])

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = saved(texts.mapInArrow(to_sets, "doc_id long, n long, name binary, " + ", ".join(f"{c} array<long>" for c in slices_of_first)), "sets")
    names = saved(sets.where("n > 0 and doc_id is not null").groupBy("name").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n")), "names")
    # Of sets the result needs little, once the postings are made.
    narrow = saved(sets.select("doc_id", "n", "name"), "rows")
    links = similar(texts, sets, names, n, percent)
    # A document in several rows joins the nodes of its texts.
    found = connected(links)
    discard(links)
    named = names.join(found, F.col("rep") == F.col("node"), "left").select(
        "name", F.coalesce("component", "rep").alias("component"))
    rows = narrow.join(named, "name", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def similar(texts: DataFrame, sets: DataFrame, names: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between representatives that connect whatever similar sets connect: a saved table. Deletes sets, as
    what follows needs its postings only."""
    parts = []
    for i in range(SLICES):
        one = sets.groupBy("name", F.col("doc_id").alias("rep")).agg(F.any_value(f"first_{i}").alias("first")).join(names, ["name", "rep"])
        # Lead and look-up of a token share one exchange.
        same = Window.partitionBy("token")
        own = one.select(F.explode("first").alias("token"), "rep", "n").select(
            "*", F.min("rep").over(same).alias("lead"), F.max("rep").over(same).alias("other"))
        parts.append(saved(own.where("lead <> other").drop("other"), "postings"))
        free(sets.sparkSession)
    postings = reduce(DataFrame.unionByName, parts)
    discard(sets)

    # A set with a link shares so many first tokens at least with some other set; its family is the lead that most of them have.
    by_lead = postings.groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("shared"), F.min("n").alias("least"), F.max("n").alias("n"))
    active = by_lead.groupBy("rep").agg(
        F.max("n").alias("n"), F.min("least").alias("least"), F.sum("shared").alias("shared"),
        F.max(F.struct("shared", (-F.col("lead")).alias("lead"))).alias("best"))
    enough = wanted_sql(least_overlap_sql("least", percent), percent)
    active = saved(active.where(F.col("shared") >= enough).select("rep", "n", "least", (-F.col("best.lead")).alias("family")), "active")

    # First each group by itself and against the hub group of its family: pairs grow with the sets.
    members = saved(grouped(active.withColumn("component", F.col("rep")), "family"), "members")
    hub_links = []
    for i in range(GROUP_SLICES):
        of_slice = F.pmod(F.xxhash64("family"), F.lit(GROUP_SLICES)) == i
        stored = saved(packed(texts, members.where(of_slice), n), "groups")
        groups = stored.withColumn("hub", F.concat(F.substring_index("gid", "/", 1), F.lit("/0")))
        own = groups.select(F.col("sets").alias("left"), F.lit(None).cast(groups.schema["sets"].dataType).alias("right"))
        several = groups.where("parts > 1")
        hubs = several.where("gid = hub").select("hub", F.col("sets").alias("right"))
        crossed = several.where("gid <> hub").join(hubs, "hub").select(F.col("sets").alias("left"), "right")
        hub_links.append(saved(opened(own, percent).unionByName(opened(crossed, percent)), "hub_links"))
        discard(stored)
    links = reduce(DataFrame.unionByName, hub_links)

    # Then the matrix: what is not connected yet, in groups of one component where it has many members in a family.
    # The sets of a family that was one group (alone) have been compared already.
    found = connected(links)
    alone = (F.col("parts") == 1).alias("alone")
    now = members.select("rep", "n", "least", "family", alone).join(found, F.col("rep") == F.col("node"), "left")
    now = saved(now.select("rep", "n", "least", "family", "alone", F.coalesce("component", "rep").alias("component")), "now")
    discard(members, found, active)
    size = now.groupBy("family", "component").count()
    sized = now.join(size, ["family", "component"]).withColumn("own", F.when(F.col("count") >= OWN_GROUPS, F.col("component")))
    members = saved(grouped(sized, "family", "own"), "members")
    discard(now)
    about = members.groupBy("gid").agg(
        F.min("least").alias("low"), F.max("n").alias("high"), F.min("component").alias("first"), F.max("component").alias("last"),
        F.min("family").alias("family"), F.min("alone").alias("alone"))
    about = saved(about, "about")
    cells = saved(postings.select("token", "rep").join(members.select("rep", "gid"), "rep").select("token", "rep", "gid"), "cells")
    discard(*parts)
    matrix = cells.select("token", "gid").distinct().join(about, "gid")
    x, y = matrix.alias("x"), matrix.alias("y")
    differ = (F.col("x.first") != F.col("x.last")) | (F.col("y.first") != F.col("y.last")) | (F.col("x.first") != F.col("y.first"))
    differ = differ & ((F.col("x.family") != F.col("y.family")) | ~F.col("x.alone"))
    fits = (F.col("x.high") * 100 >= F.col("y.low") * percent) & (F.col("y.high") * 100 >= F.col("x.low") * percent)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") < F.col("y.gid")) & differ & fits)
    pairs = pairs.groupBy(F.col("x.gid").alias("gid"), F.col("y.gid").alias("other")).agg(
        F.collect_list("x.token").alias("tokens"), F.min(F.least("x.low", "y.low")).alias("low")).withColumn("shared", F.size("tokens"))
    pairs = saved(pairs.where(F.col("shared") >= wanted_sql("low", percent)).select("gid", "other", "tokens"), "pairs")

    # In a pair of groups only sets that share enough with the other group's union take part.
    hits = pairs.select("gid", "other", F.explode("tokens").alias("token"))
    sides = hits.select("*", F.lit(True).alias("is_left"), F.col("gid").alias("own")).unionByName(
        hits.select("*", F.lit(False).alias("is_left"), F.col("other").alias("own")))
    met = sides.join(cells.withColumnRenamed("gid", "own"), ["token", "own"]).groupBy("gid", "other", "is_left", "rep").agg(
        F.count(F.lit(1)).alias("shared"))
    chosen = met.join(members.select("rep", "least", "component"), "rep").where(F.col("shared") >= enough)
    mixed = about.where("first <> last and not alone").select("gid").join(members, "gid").select(
        "gid", F.lit(None).cast("string").alias("other"), F.lit(True).alias("is_left"), "rep", "component")
    chosen = saved(chosen.select("gid", "other", "is_left", "rep", "component").unionByName(mixed), "chosen")
    discard(cells, pairs, members, about)
    held = whole(texts, chosen.select("rep").distinct(), n)
    rows = chosen.join(held, "rep").repartition("gid", "other").dropDuplicates(["gid", "other", "is_left", "rep", "name"])
    one = F.struct("rep", "component", "tokens")
    rows = rows.groupBy("gid", "other").agg(
        F.collect_list(F.when(F.col("is_left"), one)).alias("left"), F.collect_list(F.when(~F.col("is_left"), one)).alias("right"))
    rows = rows.where("other is null or (size(left) > 0 and size(right) > 0)")
    found = saved(links.unionByName(opened(rows, percent)), "all_links")
    discard(chosen, *hub_links)
    return found
