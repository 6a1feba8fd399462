"""Vector retrieval for whole tables of queries.

Stored rows are (tbl, id, vector), queries (query_id, vector). Rows and queries with a null key, or whose vector is null,
empty or holds null or non-finite components, take no part; a zero vector scores 0 with everything; vectors of another
length than the query's don't meet it. A row that is stored twice is found once. Empty tables give empty results.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators.keyword import best
from inkwell.sources.shared import small_batches

#: Queries that go to every task at once, and the most queries and rows that one task compares in a cell.
QUERY_BLOCK, CELL_QUERIES, CELL_ROWS = 2_048, 2_048, 32_768
#: Rows and queries whose scores a task holds at once: a cell's would be several arrays of half a gigabyte.
STEP_ROWS, STEP_QUERIES = 2_048, 256
#: Lists that hold each vector, and the share of the lists, in hundredths, that a query probes.
COPIES, PROBED = 2, 40
#: Rows that centroids are fitted on, and the most bytes of them that go to every task.
SAMPLE_ROWS, CENTROID_BYTES = 50_000, 256 << 20
FOUND = "query_id bigint, tbl string, id bigint, score double"


def _sound(vector: str) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _rows(vectors: DataFrame) -> DataFrame:
    keyed = vectors.filter(F.col("tbl").isNotNull() & F.col("id").isNotNull() & _sound("vector"))
    return keyed.select("tbl", F.col("id").cast("bigint").alias("id"), X.doubles(F.col("vector")).alias("v"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.filter(F.col("query_id").isNotNull() & _sound("vector")).select(F.col("query_id").cast("bigint").alias("query_id"), X.doubles(F.col("vector")).alias("q"))


def _units(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors by length of the vectors in a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        m = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        out[n] = at, np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    return out


def blocks(rows: int, queries: int) -> list[tuple[int, int]]:
    """Places of the first row and query of each block whose scores a task holds at once."""
    return [(a, b) for a in range(0, rows, STEP_ROWS) for b in range(0, queries, STEP_QUERIES)]


class _Kept:
    """The k best rows a query and store of all blocks seen so far."""

    def __init__(self, ids: np.ndarray, units: dict, k: int):
        self.ids, self.units, self.k, self.kept = ids, units, k, {}

    def scored(self, vectors):
        """Length, place of a block's first query, places of its rows of that length, and their scores by query."""
        for n, (at, m) in _units(vectors).items():
            if n in self.units:
                for a, b in blocks(len(at), len(self.units[n][1])):
                    yield n, b, at[a : a + STEP_ROWS], self.units[n][1][b : b + STEP_QUERIES] @ m[a : a + STEP_ROWS].T

    def add(self, tbl, ids: np.ndarray, vectors) -> None:
        tbl = np.array(tbl, object)
        for n, first, at, score in self.scored(vectors):
            score = np.round(score, X.STEADY)
            for name in set(tbl[at].tolist()):
                here, key = tbl[at] == name, (name, n, first)
                s, i = score[:, here], np.broadcast_to(ids[at][here], (len(score), int(here.sum())))
                if key in self.kept:
                    s, i = (np.concatenate(x, 1) for x in zip(self.kept[key], (s, i)))
                order = np.lexsort((i, -s), axis=1)[:, : self.k]
                self.kept[key] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def table(self) -> pa.Table:
        parts = [(np.repeat(self.ids[self.units[n][0][b : b + len(s)]], s.shape[1]), [name] * s.size, i.ravel(), s.ravel()) for (name, n, b), (s, i) in self.kept.items()]
        cols = [np.concatenate([p[c] for p in parts]) if parts else [] for c in range(4)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["query_id", "tbl", "id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, tbl, id, score, rank): the k nearest rows of each store by cosine, merged to k rows a query.

    Up to QUERY_BLOCK queries go to every task, which keeps its own k best rows a query and store, so only those are
    shuffled. More queries meet the rows in cells of bounded size, each compared by one task.
    """
    return _merged(_found(_rows(vectors if where is None else vectors.filter(where)), _asked(queries), k), k)


def _found(rows: DataFrame, asked: DataFrame, k: int, make=_Kept) -> DataFrame:
    """FOUND rows that hold the k best of each query and store; make says how a task scores what is in `v`."""
    few = asked.limit(QUERY_BLOCK + 1).toArrow()
    if few.num_rows > QUERY_BLOCK:
        one = F.lit(0).alias("cell")
        return _in_cells(rows.select("*", one), asked.select("*", one), k, make)
    ids, units = few["query_id"].to_numpy(), _units(few["q"])

    def run(batches):
        kept = make(ids, units, k)
        for batch in batches:
            if batch.num_rows and len(ids):
                kept.add(batch["tbl"].to_pylist(), batch["id"].to_numpy(), batch["v"])
        yield from kept.table().to_batches()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    return best(best(found.distinct(), k, ("query_id", "tbl")).drop("rank"), k)


def _in_cells(rows: DataFrame, asked: DataFrame, k: int, make=_Kept) -> DataFrame:
    """FOUND rows: the k best of every block of rows for every block of queries of the same cell.

    A cell's rows and queries are cut into blocks by a hash; sizes are counted first, so a cell with a third of all
    rows is many blocks.
    """
    count = F.count("*").alias
    blocks = rows.groupBy("cell").agg(count("n")).join(asked.groupBy("cell").agg(count("m")), "cell")
    blocks = blocks.select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("rb"), F.ceil(F.col("m") / CELL_QUERIES).cast("int").alias("qb"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("tbl", "id"), "rb").cast("int").alias("r"), every("qb").alias("c"), "tbl", "id", "v")
    right = asked.join(blocks, "cell").select("cell", every("rb").alias("r"), F.pmod(F.xxhash64("query_id"), "qb").cast("int").alias("c"), "query_id", "q")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = make(right["query_id"].to_numpy(), _units(right["q"]), k) if right.num_rows else make(np.zeros(0, np.int64), {}, k)
        if left.num_rows and right.num_rows:
            kept.add(left["tbl"].to_pylist(), left["id"].to_numpy(), left["v"])
        return kept.table()

    return left.groupBy("cell", "r", "c").cogroup(right.groupBy("cell", "r", "c")).applyInArrow(run, FOUND)


def approximate(vectors: DataFrame, queries: DataFrame, k: int, lists: int | None = None, probes: int | None = None, seed: int = 7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """search over the lists of the nearest centroids alone.

    Centroids are fitted on about sample_rows normalised vectors, chosen by a hash of their id; every vector is then
    put on the lists of its COPIES nearest centroids, and a query probes the lists of its own nearest ones. Lists and
    queries meet in cells of bounded size. By default there is a list for 40 rows up to 100 lists, one for 1000 rows up
    to a million rows, and the square root of the rows beyond; PROBED of them are probed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows, asked = _rows(vectors), _asked(queries)
    n = rows.count()
    if n == 0:
        return search(vectors, queries, k)
    lists = lists or max(2, min(100, n // 40), min(n // 1000, isqrt(n)))
    probes = probes or -(-lists * PROBED // 100)
    share = int((1 << 20) * min(1.0, sample_rows / n))
    sample = rows.filter(F.pmod(F.xxhash64("tbl", "id"), F.lit(1 << 20)) < share).select(array_to_vector(X.l2_normalise(F.col("v"))).alias("features"))
    if min(lists, n) < 2 or not sample.take(2):
        return search(vectors, queries, k)
    centres = np.array(KMeans(k=min(lists, n), seed=seed, maxIter=10).fit(sample).clusterCenters(), float)
    if centres.nbytes > CENTROID_BYTES:
        raise ValueError("these centroids are too large for every task; ask for fewer lists")
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

    def listed(table: DataFrame, column: str, some: int) -> DataFrame:
        """table with `cell`: a row for each of the nearest lists of its vector."""
        names = [*table.columns, "cell"]

        def run(batches):
            for batch in batches:
                for size, (at, m) in _units(batch[column]).items():
                    if size != centres.shape[1]:
                        continue
                    near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :some]
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(np.repeat(at, near.shape[1]))).columns, pa.array(near.ravel().astype(np.int32))], names=names)

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
        return table.mapInArrow(run, f"{kinds}, cell int")

    return _merged(_in_cells(listed(rows, "v", COPIES), listed(asked, "q", probes), k), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): share of the exact rows that are found."""
    keys = ["query_id", "tbl", "id"]
    return exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def mean_pool(tokens: DataFrame) -> DataFrame:
    """(id, vector): mean over the token vectors whose mask is 1; zeros where there is none. tokens: (id, vector, mask)."""
    parts = tokens.select("id", "mask", F.posexplode(X.doubles(F.col("vector"))).alias("dim", "x"))
    means = parts.groupBy("id", "dim").agg((F.sum(F.col("x") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))).alias("x"))
    return means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector"))

