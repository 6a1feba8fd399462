"""Exact top-k inner products by a KD-tree per shard.

Vectors are dealt to shards by a hash of their row number, so rows that share an id spread. A task builds the tree of its shard: median splits on the widest
dimension, each node with the tight bounding box of its points. A query descends best-first by the box bound
sum(max(q * low, q * high)) and stops at the first box that can't reach its kth score. The first round searches one
shard for each query; the kth score found there travels with the query to all other shards.

A shard's points come to its task before the queries that are dealt to it; these stream over the tree one Arrow batch at
a time, so a task holds one shard and one batch of queries, however many there are. A shard's results are k rows a query
and the last step is a partial top-k aggregate.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, tidy, written

K, EVERY, SCALE = 5, 50, 256
#: Vectors of a shard and of a leaf.
SHARD_ROWS, LEAF = 16_384, 128


class Tree:
    """KD-tree over integer vectors; leaves hold points in id order. rows tell apart points that share an id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((rows, ids))
        self.ids, self.own, self.points = ids[order], rows[order], points[order]
        self.low, self.high, self.kids, self.rows = [], [], [], []
        todo = [(np.arange(len(ids)), self._node())]
        while todo:
            rows, at = todo.pop()
            own = self.points[rows]
            self.low[at], self.high[at] = own.min(0), own.max(0)
            widest = int(np.argmax(self.high[at] - self.low[at]))
            if len(rows) <= leaf or self.high[at][widest] == self.low[at][widest]:
                self.rows[at] = rows
                continue
            half = len(rows) // 2
            split = np.argpartition(own[:, widest], half)
            self.kids[at] = (self._node(), self._node())
            todo += [(np.sort(rows[split[:half]]), self.kids[at][0]), (np.sort(rows[split[half:]]), self.kids[at][1])]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _node(self) -> int:
        for x in (self.low, self.high, self.kids, self.rows):
            x.append(None)
        return len(self.kids) - 1

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The most that a point of each box can score."""
        return np.maximum(query, 0) @ self.high.T + np.minimum(query, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[float, int]]:
        """Up to k (score, id), best first and ties to smaller ids, of points other than row own that score at least floor."""
        bounds = self.bounds(query)
        best: list[tuple[float, int]] = []  # (score, -id), the worst first
        todo = [(-bounds[0], 0)]
        while todo:
            bound, at = heapq.heappop(todo)
            least = best[0][0] if len(best) == k else floor
            if -bound < least:
                break
            if self.kids[at]:
                for kid in self.kids[at]:
                    if bounds[kid] >= least:
                        heapq.heappush(todo, (-bounds[kid], kid))
                continue
            rows = self.rows[at]
            scores = self.points[rows] @ query
            on = np.flatnonzero((scores >= least) & (self.own[rows] != own))
            if len(on) > k:
                on = on[np.lexsort((self.ids[rows[on]], -scores[on]))[:k]]
            for i in on:
                item = (float(scores[i]), -int(self.ids[rows[i]]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of every component as double; vectors that are null, empty or not all finite are left out.

    Rows without an id are left out; rows that share an id stay rows of their own.
    """
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))


@tidy
def top_k(points: DataFrame, asked: Column, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each point for which `asked` holds among all others.

    points are (vec_id, v), further columns are left out. Points that share an id are told apart by a row number: each
    is a query and a candidate of its own, and only the query's own row is no candidate. Vectors of a length other than
    the query's don't meet it. Fewer than k candidates give fewer rows; no queries or no points give none. Scores are
    exact while they stay below 2^53.
    """
    points = written(points.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "topk-points")
    queries = points.filter(asked)
    shards = max(1, -(-points.count() // shard_rows))
    placed = points.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    home = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int")
    first = _searched(placed, queries.withColumn("floor", F.lit(float("-inf"))).withColumn("shard", home), k, shards)
    first = written(first, "topk-first")
    floors = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = floors.select(F.col("query").alias("row"), F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("floor"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    rest = queries.withColumn("home", home).join(floors, "row", "left").fillna(float("-inf"), ["floor"]).withColumn("shard", F.explode(others)).drop("home")
    found = first.unionByName(_searched(placed, rest, k, shards))
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("bigint").alias("score"))


def _searched(points: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """(query, query_id, vec_id, score) of each query's best k on the shard that it is dealt to."""
    left = points.select("shard", F.lit(0).alias("side"), "row", "vec_id", "v", F.lit(0.0).alias("floor"))
    both = left.unionByName(queries.select("shard", F.lit(1).alias("side"), "row", "vec_id", "v", "floor"))
    both = both.repartition(shards, "shard").sortWithinPartitions("shard", "side")

    def run(batches):
        now, held, trees = None, [], None
        for batch in batches:
            shard, side = batch.column("shard").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if shard[a] != now:
                    now, held, trees = shard[a], [], None
                if side[a] == 0:
                    held.append((part.column("vec_id").to_numpy(), part.column("row").to_numpy(), _by_length(part.column("v"))))
                    continue
                if trees is None:
                    trees, held = _trees(held), []
                yield _answers(trees, part, k)

    return both.mapInArrow(run, "query bigint, query_id bigint, vec_id bigint, score double")


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors by their length."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        out[n] = at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def _trees(held: list) -> dict[int, Tree]:
    parts: dict[int, list] = {}
    for ids, rows, vectors in held:
        for n, (at, v) in vectors.items():
            parts.setdefault(n, []).append((ids[at], rows[at], v))
    return {n: Tree(*map(np.concatenate, zip(*own))) for n, own in parts.items()}


def _answers(trees: dict[int, Tree], part: pa.RecordBatch, k: int) -> pa.RecordBatch:
    ids, rows, floors = (part.column(c).to_pylist() for c in ("vec_id", "row", "floor"))
    out = []
    for n, (at, v) in _by_length(part.column("v")).items():
        if n in trees:
            for i, query in zip(at.tolist(), v):
                out += [(rows[i], ids[i], vec, score) for score, vec in trees[n].search(query, rows[i], k, floors[i])]
    cols = list(zip(*out)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query", "query_id", "vec_id", "score"])


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)


OP4_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM p q JOIN p c ON q.n <> c.n
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
