"""Approximate vector search on short codes (product quantisation) with exact scores of a short list.

A unit vector is cut into parts of PART components; a part is stored as the number of its nearest centre, one byte. A
task has a table of each query's products with all centres, so that the approximate score of a row is a sum of look-ups
and its vector isn't read. The best rows by that score are the short list, whose vectors alone are fetched by key and
scored in full. Rows and queries are those of `vector`, and so are nulls, odd vectors, repeated rows and empty tables.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import vector as V
from inkwell.sources.shared import small_batches

#: Components of a part, centres of a part, and rows of the short list for each row asked for.
PART, CENTRES, SHORT = 4, 256, 4
#: Lengths of vectors that get codes, the commonest of the sample; rows of other lengths are compared in full.
LENGTHS = 16
#: Turns of the fit, and rows that are compared with the centres at a time.
TURNS, BLOCK = 10, 8_192

Books = dict[int, list[np.ndarray]]


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    blocks = (points[a : a + BLOCK] for a in range(0, len(points), BLOCK))
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(b @ centres.T - half, axis=1) for b in blocks)])


def _centres(rows: np.ndarray, seed: int) -> np.ndarray:
    """Up to CENTRES means of the rows; the order of the rows makes no difference."""
    points, weight = np.unique(rows, axis=0, return_counts=True)
    out = points[np.random.default_rng(seed).choice(len(points), min(CENTRES, len(points)), replace=False)]
    for _ in range(TURNS):
        near = _nearest(points, out)
        mass = np.bincount(near, weight, len(out))[:, None]
        sums = np.stack([np.bincount(near, weight * points[:, j], len(out)) for j in range(points.shape[1])], axis=1)
        out = np.where(mass > 0, sums / np.maximum(mass, 1), out)
    return out


def books(vectors: DataFrame, part: int = PART, sample_rows: int = V.SAMPLE_ROWS, seed: int = 7) -> Books:
    """Centres of each part by length of the vectors, fitted on about sample_rows rows that are chosen by a hash of their
    key. A part is one task's group of at most the sample's parts; only centres reach the driver."""
    rows = V._rows(vectors)
    share = int((1 << 20) * min(1.0, sample_rows / max(1, rows.count())))
    sample = rows.filter(F.pmod(F.xxhash64("tbl", "id"), F.lit(1 << 20)) < share).dropDuplicates(["tbl", "id"])
    sample = sample.select(F.size("v").alias("n"), X.l2_normalise(F.col("v")).alias("v"))
    common = [r["n"] for r in sample.groupBy("n").count().orderBy(F.desc("count"), "n").limit(LENGTHS).collect()]
    places = F.sequence(F.lit(0), F.ceil(F.col("n") / part).cast("int") - 1)
    parts = sample.filter(F.col("n").isin(common)).select("n", F.posexplode(F.transform(places, lambda i: F.slice("v", i * part + 1, part))).alias("part", "x"))

    def fit(group: pa.Table) -> pa.Table:
        x = group["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        found = _centres(x, seed)
        n, place = (group[c][0].as_py() for c in ("n", "part"))
        return pa.table({"n": pa.array([n], pa.int32()), "part": pa.array([place], pa.int32()), "width": pa.array([x.shape[1]], pa.int32()), "centres": pa.array([found.ravel().tolist()], pa.list_(pa.float64()))})

    fitted = parts.groupBy("n", "part").applyInArrow(fit, "n int, part int, width int, centres array<double>")
    out: Books = {}
    for r in sorted(fitted.collect(), key=lambda r: (r["n"], r["part"])):
        out.setdefault(r["n"], []).append(np.array(r["centres"]).reshape(-1, r["width"]))
    return out


def encode(vectors: DataFrame, of: Books) -> DataFrame:
    """(tbl, id, code): the length of the vector in four bytes, then a byte for each part; rows of lengths without
    centres are left out. May be kept with the store: a row's code depends on its vector and the centres alone."""

    def run(batches):
        for batch in batches:
            codes = [None] * batch.num_rows
            for n, (at, m) in V._units(batch["v"]).items():
                if n not in of:
                    continue
                edges = np.cumsum([0, *(c.shape[1] for c in of[n])])
                own = np.stack([_nearest(m[:, a:b], c) for a, b, c in zip(edges, edges[1:], of[n])], axis=1).astype(np.uint8)
                head = int(n).to_bytes(4, "little")
                for i, code in zip(at.tolist(), own):
                    codes[i] = head + code.tobytes()
            yield pa.RecordBatch.from_arrays([batch["tbl"], batch["id"], pa.array(codes, pa.binary())], names=["tbl", "id", "code"])

    small_batches(vectors.sparkSession)
    return V._rows(vectors).mapInArrow(run, "tbl string, id bigint, code binary").filter("code IS NOT NULL")


class _KeptCodes(V._Kept):
    """The k best rows by the sums of look-ups."""

    def __init__(self, of: Books, ids: np.ndarray, units: dict, k: int):
        super().__init__(ids, units, k)
        self.of = of

    def scored(self, codes):
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        raw = codes.to_pylist()
        lengths = np.array([int.from_bytes(c[:4], "little") for c in raw])
        for n in sorted(set(lengths.tolist()) & set(self.units) & set(self.of)):
            at, q = np.flatnonzero(lengths == n), self.units[n][1]
            byte = np.frombuffer(b"".join(raw[i][4:] for i in at), np.uint8).reshape(len(at), -1)
            edges = np.cumsum([0, *(c.shape[1] for c in self.of[n])])
            for a, b in V.blocks(len(at), len(q)):
                own, near = q[b : b + V.STEP_QUERIES], byte[a : a + V.STEP_ROWS]
                score = np.zeros((len(own), len(near)))
                for j, centres in enumerate(self.of[n]):
                    score += (own[:, edges[j] : edges[j + 1]] @ centres.T)[:, near[:, j]]
                yield n, b, at[a : a + V.STEP_ROWS], score


def short_list(codes: DataFrame, queries: DataFrame, of: Books, rows: int) -> DataFrame:
    """(query_id, tbl, id, score, rank): the best rows of each query by approximate score; vectors aren't read."""
    held = codes.select("tbl", "id", F.col("code").alias("v"))
    return V._merged(V._found(held, V._asked(queries), rows, partial(_KeptCodes, of)), rows)


def search(vectors: DataFrame, queries: DataFrame, k: int, short: int | None = None, of: Books | None = None, codes: DataFrame | None = None) -> DataFrame:
    """(query_id, tbl, id, score, rank): about the k nearest rows by cosine, with exact scores.

    short rows a query (SHORT times k by default) are scored in full. of and codes may be kept from an earlier call of
    books and encode. Rows whose length has no centres are compared in full, so no length is lost.
    """
    of = books(vectors) if of is None else of
    codes = encode(vectors, of) if codes is None else codes
    rows, asked = V._rows(vectors), V._asked(queries)
    listed = short_list(codes, queries, of, short or SHORT * k).select("query_id", "tbl", "id")
    pairs = listed.join(rows, ["tbl", "id"]).join(asked, "query_id").filter(F.size("v") == F.size("q"))
    product = F.aggregate(F.zip_with(X.l2_normalise(F.col("v")), X.l2_normalise(F.col("q")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", "tbl", "id", F.round(product, X.STEADY).alias("score"))
    rest = V._found(rows.filter(~F.size("v").isin(list(of))) if of else rows, asked, k)
    return V._merged(scored.unionByName(rest), k)
