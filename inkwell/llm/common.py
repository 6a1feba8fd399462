"""Helpers that the training-data operators share: Arrow passes, and tables written and removed by scope."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkwell.sources.shared import fresh_path, remove, scope, shared_dir, small_batches, tidy, written

__all__ = ["arrow_pass", "fresh_path", "remove", "scope", "shared_dir", "table", "texts", "tidy", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text of one step of an Arrow pass; a row is never cut, so a single longer text makes a step of its own.
PIECE_BYTES = 2 << 20
#: What empties the cache that a module keeps in a Python worker from task to task, by module.
_CACHES: dict[str, Callable[[], None]] = {}


def keeps(module: str, empty: Callable[[], None]) -> None:
    """Name the cache of a module, which a pass of another module's empties, so that stages don't add up in a worker."""
    _CACHES[module] = empty


def _begin(module: str) -> None:
    for name, empty in _CACHES.items():
        if name != module:
            empty()


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: T.StructType | str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Map each Arrow batch with fn, which returns columns by name; batches hold at most piece_bytes of input."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(schema)
    small_batches(df.sparkSession)
    module = fn.__module__

    def run(batches):
        _begin(module)
        for batch in batches:
            for part in pieces(batch, piece_bytes):
                cols = fn(part)
                yield pa.RecordBatch.from_arrays([_column(cols[f.name], f.type) for f in out], schema=out)
        _release()

    return df.mapInArrow(run, schema)


def _release() -> None:
    """Give freed memory back to the system, so that a worker that other stages use again begins small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    step = max(1, int(n * most / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def _column(values, kind):
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
