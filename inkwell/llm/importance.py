"""Resampling of documents towards a target distribution, by importance weights over hashed n-grams.

A 256-byte table lower-cases and blanks separators in UTF-8, bytes.split yields words, and zlib.crc32, whose running value
seeds the next word, extends an n-gram by a word at a time. Each task counts buckets in a Counter and gives its sums, so
at most BUCKETS rows a task are shuffled; a bucket's gain is its log ratio between the target and all documents. A second
pass sums a document's gains, adds Gumbel noise that its id fixes, and the highest scores are drawn.

The order of all scores is a range sort with offsets by partition, so no task sees all rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import PIECE_BYTES, arrow_pass, pieces, table, texts, tidy, written

#: Fixed by the mix: buckets of the hash, longest run of words, least words of a document that may be drawn, share drawn.
BUCKETS, GRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Letters and digits in lower case; any other ASCII byte is a blank, bytes of longer code points stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Places of a row in its partition, in the low bits of monotonically_increasing_id.
PLACE = (1 << 33) - 1


def words(raw: bytes) -> list[bytes]:
    return raw.translate(LOWER).split()


def features(own: list[bytes]) -> list[int]:
    """Hashes of all runs of 1 to GRAM consecutive words, joined by a blank, repeats included."""
    at = list(map(crc32, own))
    out, longer = list(at), [b" " + w for w in own]
    for n in range(1, GRAM):
        at = list(map(crc32, longer[n:], at))
        out += at
    return out


def _buckets(own: list[bytes]) -> np.ndarray:
    return np.array(features(own), np.int64) % BUCKETS


def counted(docs: DataFrame) -> dict[int, int]:
    """How many features of all texts fall in each bucket; a null text has none. At most BUCKETS numbers reach the driver."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                for raw in texts(part.column("text")):
                    counts.update(_buckets(words(raw)).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(counts.keys(), pa.int32()), "n": pa.array(counts.values(), pa.int64())})

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    return dict(map(tuple, sums.collect()))


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """The gain of each bucket in thousandths, with one more of each bucket on both sides."""
    all_corpus, all_target = sum(corpus.values()) + BUCKETS, sum(target.values()) + BUCKETS
    ratio = [(target.get(b, 0) + 1) * all_corpus / ((corpus.get(b, 0) + 1) * all_target) for b in range(BUCKETS)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(key: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, fixed by a document's id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of docs (doc_id, text), by its features' gains."""
    gain = gains(counted(docs), counted(target))

    def step(batch):
        own = [words(raw) for raw in texts(batch.column("text"))]
        hashed = [_buckets(w) for w in own]
        weight = [int(gain[h].sum()) for h in hashed]
        score = [w + noise(k) for w, k in zip(weight, batch.column("doc_id").to_pylist())]
        return {"doc_id": batch.column("doc_id"), "n_words": [len(w) for w in own], "n_features": [len(h) for h in hashed], "weight": weight, "score": score}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_pass(rows, step, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null for a row that isn't drawn.

    Of the N rows with at least least_words words, floor(percent * N / 100) are drawn: the highest scores, ties to the
    smaller doc_id, a null id last; rows alike in both are drawn in any order. Null and empty texts have no features, and
    a very long one is a step of its own. Without target texts all gains follow the corpus alone; an empty table gives an
    empty one, and columns beside doc_id and text aren't read.
    """
    rows = written(scored(docs, target).withColumn("row", F.monotonically_increasing_id()), "draw-scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    fit = rows.filter(F.col("n_words") >= least_words)
    placed = fit.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE)))
    placed = written(placed, "draw-placed")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    most = fit.count() * percent // 100
    rank = F.col("before") + F.col("place") + 1
    names = ("doc_id", "n_features", "weight", "score")
    high = placed.join(written(before, "draw-before"), "part").select(*names, F.when(rank <= most, rank).alias("rank"))
    return high.unionByName(rows.filter(F.col("n_words") < least_words).select(*names, F.lit(None).cast("bigint").alias("rank")))


@tidy
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
