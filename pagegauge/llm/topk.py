"""Exact top-k search by inner product with two cover trees.

Data lie in blocks, each with a cover tree: a node's points are within its radius of its centre, and its children, at a
smaller radius, are more than that apart. Queries have such a tree too. A pair of nodes is left out when the largest
inner product that their centres and radii allow is below the worst k-th score of the node's queries.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Vectors in a block of data (about), queries sent at once, centres that blocks are formed around, points in a leaf,
#: and by how much the radius shrinks from a node to its children.
BLOCK, QUERIES, CENTRES, LEAF, SHRINK = 4096, 16_384, 64, 64, 1.3
#: Components beyond this are not integers that a double holds with room for products; such vectors take no part.
LARGEST = 2.0 ** 40


class Tree:
    """Points in the order of the leaves; node i holds points start[i]:end[i] around points[centre[i]]."""

    def __init__(self, points: np.ndarray, ids: np.ndarray) -> None:
        self.start, self.end, self.centre, self.radius, self.children = [], [], [], [], []
        order: list[int] = []
        if len(points):
            self._grow(points.astype(float), np.arange(len(points)), 0, order)
        self.points, self.ids = points[order], ids[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.centre = place[self.centre] if len(order) else np.empty(0, np.int64)
        self.start, self.end, self.radius = np.array(self.start), np.array(self.end), np.array(self.radius)
        self.norm = np.sqrt((self.points[self.centre].astype(float) ** 2).sum(1)) if len(order) else np.empty(0)

    def _grow(self, points: np.ndarray, own: np.ndarray, centre: int, order: list[int]) -> int:
        node = len(self.start)
        away = np.sqrt(((points[own] - points[centre]) ** 2).sum(1))
        self.start.append(len(order))
        self.end.append(len(order) + len(own))
        self.centre.append(centre)
        self.radius.append(float(away.max()) * (1 + 1e-9))
        self.children.append([])
        if len(own) > LEAF and away.max() > 0:
            # Children: the centre itself first, then whatever point is not covered yet.
            half, left, groups, at = away.max() / SHRINK, own, [], centre
            near = away <= half
            while True:
                groups.append((at, left[near]))
                left = left[~near]
                if not len(left) or len(groups) > len(own) // 4:
                    break
                at = int(left[0])
                near = np.sqrt(((points[left] - points[at]) ** 2).sum(1)) <= half
            if not len(left):
                for at, members in groups:
                    self.children[node].append(self._grow(points, members, at, order))
                return node
            # Points that far apart from each other form no groups: they stay together as one leaf.
        order.extend(own.tolist())
        return node


def restored(state: bytes) -> Tree:
    tree = Tree.__new__(Tree)
    vars(tree).update(pickle.loads(state))
    return tree


class Best:
    """The k best (score, id) so far of each query of a tree, ties to the smaller id."""

    def __init__(self, tree: Tree, k: int) -> None:
        self.k = k
        self.score = [np.empty(0)] * len(tree.ids)
        self.id = [np.empty(0, np.int64)] * len(tree.ids)
        self.worst = np.full(len(tree.ids), -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], scores]), np.concatenate([self.id[q], ids])
        keep = np.lexsort((i, -s))[:self.k]
        self.score[q], self.id[q] = s[keep], i[keep]
        if len(keep) == self.k:
            self.worst[q] = s[keep[-1]]


def search(queries: Tree, data: Tree, best: Best) -> None:
    """Both trees at once, the most promising pair of nodes first."""
    if not len(queries.ids) or not len(data.ids):
        return
    small = max(float(np.abs(t.points).max(initial=0)) for t in (queries, data)) ** 2 * max(1, data.points.shape[1]) < 2.0 ** 53

    def bounds(q: int, nodes: list[int]) -> np.ndarray:
        n = np.array(nodes)
        centre = data.points[data.centre[n]].astype(float) @ queries.points[queries.centre[q]].astype(float)
        r, s = queries.radius[q], data.radius[n]
        reach = r * data.norm[n] + s * queries.norm[q] + r * s
        return (centre + reach) + 1e-9 * (np.abs(centre) + reach) + 1e-6

    stack = [(0, 0, float(bounds(0, [0])[0]))]
    while stack:
        q, d, bound = stack.pop()
        a, b = queries.start[q], queries.end[q]
        if bound < best.worst[a:b].min():
            continue
        if data.children[d] and (not queries.children[q] or data.radius[d] >= queries.radius[q]):
            limits = bounds(q, data.children[d])
            stack += [(q, data.children[d][i], float(limits[i])) for i in np.argsort(limits)]
        elif queries.children[q]:
            pairs = [(x, d, float(bounds(x, [d])[0])) for x in queries.children[q]]
            stack += sorted(pairs, key=lambda p: p[2])
        else:
            points, ids = data.points[data.start[d]:data.end[d]], data.ids[data.start[d]:data.end[d]]
            if small:
                scores = queries.points[a:b].astype(float) @ points.astype(float).T  # all sums are exact in a double
            else:
                scores = queries.points[a:b].astype(object) @ points.astype(object).T
            for i in range(b - a):
                row = scores[i]
                good = np.flatnonzero((row >= best.worst[a + i]) & (ids != queries.ids[a + i]))
                if len(good):
                    best.add(a + i, row[good], ids[good])


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v array<long>, floor(256 x) of every component; without vectors that are null or hold null, non-finite
    or enormous components, and without null ids. Exact copies of a row count once."""
    scaled = F.transform(F.col(embedding), lambda x: 256 * x.cast("double"))
    usable = F.col(vec_id).isNotNull() & F.forall("s", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("s")).where(usable)
            .select("vec_id", F.transform("s", lambda x: F.floor(x)).alias("v")).distinct())


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """The k best partners by inner product of every query among all vectors: query_id, rank, vec_id, score.

    vectors: vec_id long, v array<long>, without nulls (see integer_vectors). is_query: a condition over its columns. A row
    is no partner of a query with its own id. Ties go to the smaller vec_id; vectors of another length are no partners.
    Queries with fewer partners return all of them, an empty table returns nothing.

    Of equal vectors only the k + 1 smallest ids can be among a query's best, so the rest is left out first (an exact
    reduction, made before the shuffle). Blocks form around CENTRES sampled vectors, a crowded centre's vectors going to
    several blocks by hash. Queries go to the executors QUERIES at a time; a task keeps each query's best over its
    blocks, and the tasks' results meet in a ranking per query.
    """
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    rows = vectors.select("vec_id", "v").withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1).drop("n")
    rows = saved(rows, "vectors")
    centres = [r[0] for r in rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRES).collect()]

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for c in centres:
            own.setdefault(len(c), []).append(c)
        own = {n: np.array(c, float).reshape(-1, n) for n, c in own.items()}
        for batch in batches:
            near = []
            for v in batch.column("v").to_pylist():
                c = own.get(len(v))
                near.append(int(((c - np.array(v, float)) ** 2).sum(1).argmin()) if c is not None and len(v) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=["vec_id", "v", "centre"])

    near = rows.mapInArrow(home, "vec_id long, v array<long>, centre int").withColumn("dim", F.size("v"))
    crowd = near.groupBy("dim", "centre").count()
    salted = near.join(crowd, ["dim", "centre"]).withColumn(
        "part", F.expr(f"pmod(xxhash64(vec_id), cast(ceil(count / {BLOCK}) as bigint))"))

    def index(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id")
        points = np.array(block["v"].tolist(), np.int64).reshape(len(block), -1)
        return pd.DataFrame({"dim": [block["dim"].iloc[0]], "tree": [pickle.dumps(vars(Tree(points, block["vec_id"].to_numpy())))]})

    trees = saved(salted.groupBy("dim", "centre", "part").applyInPandas(index, "dim int, tree binary"), "trees")
    found = None
    # Queries come from all vectors: one left out above as one of many equal vectors is asked all the same.
    for chunk in chunks_of(vectors.where(is_query).select("vec_id", "v")):
        sent = vectors.sparkSession.sparkContext.broadcast(pickle.dumps(chunk))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {n: Tree(p, i) for n, (p, i) in pickle.loads(sent.value).items()}
            best = {n: Best(t, k) for n, t in own.items()}
            for batch in batches:
                for n, tree in zip(batch.column("dim").to_pylist(), batch.column("tree").to_pylist()):
                    if n in own:
                        search(own[n], restored(tree), best[n])
            for n, b in best.items():
                counts = [len(i) for i in b.id]
                if sum(counts):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(own[n].ids, counts), pa.int64()), pa.array(np.concatenate(b.id), pa.int64()),
                        pa.array([int(s) for row in b.score for s in row], pa.int64())], names=["query_id", "vec_id", "score"])

        part = trees.mapInArrow(task, "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def chunks_of(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries, QUERIES at a time, by length of vector."""
    def packed(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        by: dict[int, list] = {}
        for i, v in rows:
            by.setdefault(len(v), []).append((i, v))
        return {n: (np.array([v for _, v in own], np.int64).reshape(len(own), n), np.array([i for i, _ in own], np.int64)) for n, own in by.items()}

    rows: list = []
    for r in queries.toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == QUERIES:
            yield packed(rows)
            rows = []
    if rows:
        yield packed(rows)
