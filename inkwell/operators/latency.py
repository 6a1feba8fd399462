"""Durations as kept sketches: a row for each day and group, merged for any period without reading the calls again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter of a quantile sketch. A quantile's rank is off by at most RANK_ERROR of the calls at 99 % confidence; up
#: to SIZE values are kept as they are, so small groups are exact.
SIZE, RANK_ERROR = 1000, 0.005


def kept(calls: DataFrame) -> DataFrame:
    """(day, name, calls, timed, total, most, sketch) of calls (at, name, duration).

    A call without a duration, or with one that isn't finite, counts in calls alone; calls without a time or a name are
    groups of their own, repeated rows count each, other columns are dropped, and an empty table gives an empty one.
    Partial sketches are merged in the shuffle, so a hot name moves one sketch a task.
    """
    value = F.col("duration").cast("double")
    value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    rows = calls.select(F.to_date("at").alias("day"), "name", value.alias("duration"))
    return rows.groupBy("day", "name").agg(
        F.count("*").alias("calls"), F.count("duration").alias("timed"), F.sum("duration").alias("total"), F.max("duration").alias("most"),
        F.kll_sketch_agg_double("duration", F.lit(SIZE)).alias("sketch"),
    )


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.sum("calls").alias("calls"), F.sum("timed").alias("timed"), F.sum("total").alias("total"), F.max("most").alias("most"),
        F.kll_merge_agg_double("sketch", F.lit(SIZE)).alias("sketch"),
    )


def added(before: DataFrame, more: DataFrame) -> DataFrame:
    """Two tables of `kept` as one: days and names that both hold are merged."""
    return _merged(before.unionByName(more), "day", "name")


def period(days: DataFrame, since: str | None = None, until: str | None = None, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(name, calls, timed, mean, most, p50, p95, p99) of the days from since to until, both included, from `kept` alone.

    Without bounds calls without a time count too; mean, most and quantiles are null where no call has a duration.
    """
    if since is not None:
        days = days.filter(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        days = days.filter(F.col("day") <= F.lit(until).cast("date"))
    rows = _merged(days, "name")
    each = [F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).alias(f"p{q * 100:g}") for q in points]
    return rows.select("name", "calls", "timed", (F.col("total") / F.col("timed")).alias("mean"), "most", *each)
