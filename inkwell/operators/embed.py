"""Embedding jobs with a pluggable encoder; routing to the two stores."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources.shared import small_batches

BATCH = 32
CODE_TYPES = ("JAVA", "JAVADOC", "XML")


#: CRC-32 of each byte value, for one step at a time over arrays.
CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)
#: Letters that are hashed at a time.
PIECE = 1 << 16


def _hashes(text: str) -> np.ndarray:
    """CRC-32 of the UTF-8 of every three letters in a row, those of ASCII letters as arrays, each other one once."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.full(len(points) - 2, 0xFFFFFFFF, np.uint32)
    for k in range(3):
        out = CRC[(out ^ points[k : len(points) - 2 + k]) & 0xFF] ^ (out >> 8)
    out ^= np.uint32(0xFFFFFFFF)
    wide = points > 127
    if wide.any():
        at = np.flatnonzero(wide[:-2] | wide[1:-1] | wide[2:])
        packed = (points[at].astype(np.uint64) << 42) | (points[at + 1].astype(np.uint64) << 21) | points[at + 2]
        _, first, same = np.unique(packed, return_index=True, return_inverse=True)
        out[at] = np.array([zlib.crc32(text[i : i + 3].encode()) for i in at[first].tolist()], np.uint32)[same]
    return out


def hashed_trigrams(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Deterministic stand-in for a model: counts of hashed character trigrams."""
    whole, own = "".join(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out = np.zeros(len(texts) * dims)
    for at in range(0, len(whole) - 2, PIECE):
        row = own[at : at + PIECE + 2]
        inside = row[:-2] == row[2:]
        np.add.at(out, row[:-2][inside] * dims + _hashes(whole[at : at + PIECE + 2])[inside] % dims, 1.0)
    out = out.reshape(len(texts), dims)
    return out.tolist()


def vectors_of(texts: list[str], model: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> list[list[float]]:
    """The vector of each text; the encoder sees equal texts of the list once."""
    distinct, out = list(dict.fromkeys(texts)), []
    for at in range(0, len(distinct), batch):
        out += model(distinct[at : at + batch])
    known = dict(zip(distinct, out))
    return [known[t] for t in texts]


def embedded(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]] = lambda: hashed_trigrams, batch: int = BATCH) -> DataFrame:
    """rows with `vector` of their content. The encoder is loaded once a task and sees equal contents once in the job.

    Contents are known by 128 bits of their SHA-256; distinct ones are spread by it before the costly step, and the
    vectors come back by it, so each text is shuffled once, to as many tasks as the session shuffles to: their work follows
    the letters, not the compressed bytes. Null contents have no vector; a column `vector` is replaced.
    """
    small_batches(rows.sparkSession)

    @F.pandas_udf("array<double>")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in series:
            texts, out = s.tolist(), []
            for at in range(0, len(texts), batch):
                out += model(texts[at : at + batch])
            yield pd.Series(out)

    half = lambda k: F.conv(F.substring(F.sha2("content", 256), 1 + 16 * k, 16), 16, -10).cast("bigint")
    keyed = rows.drop("vector").withColumns({"_k1": half(0), "_k2": half(1)})
    spread = keyed.filter("content IS NOT NULL").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_k1", "_k2")
    once = spread.groupBy("_k1", "_k2").agg(F.min("content").alias("content"))
    vectors = once.select("_k1", "_k2", encode("content").alias("vector"))
    return keyed.join(vectors, ["_k1", "_k2"], "left").drop("_k1", "_k2")


def store_of(content_type: Column) -> Column:
    """code for source and configuration, doc for everything else."""
    return F.when(content_type.isin(*CODE_TYPES), "code").otherwise("doc")


def routed(rows: DataFrame) -> dict[str, DataFrame]:
    """The rows of each store."""
    placed = rows.withColumn("tbl", store_of(F.col("content_type")))
    return {name: placed.filter(F.col("tbl") == name) for name in ("doc", "code")}
