"""Tables in the folder that all executors share: they cut lineage, and a lost executor costs only a reread."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Paths of the tables written inside each open scope of this thread; other threads have scopes of their own.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())

#: Rows and bytes of a batch that Spark hands to Python, where the session doesn't set them: its own 10,000 rows of texts
#: stand in the executor's native memory and in the worker as a whole.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    for key, most in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a fresh folder of this process if Spark is local too, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/inkwell-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder. It stays there until its scope removes it, or for the cluster's own cleaning."""
    path = fresh_path(df.sparkSession, name)
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the paths of the tables written inside, for `remove` once nothing reads them any more."""
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield made
    finally:
        _SCOPES.reset(token)


def tidy(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The job, whose tables are removed before it returns, but for those that the frame it returns still reads."""

    @wraps(job)
    def run(*args, **kwargs) -> DataFrame:
        with scope() as made:
            out = job(*args, **kwargs)
        if not made:
            return out
        read = out.inputFiles()
        used = [path for path in made if any(path.rsplit("/", 1)[-1] in f for f in read)]
        remove(out.sparkSession, [path for path in made if path not in used])
        if _SCOPES.get():
            _SCOPES.get()[-1].extend(used)
        return out

    return run


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
