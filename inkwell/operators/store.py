"""Chunk-store maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_urls(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct discovered urls that the store lacks; only keys are joined."""
    return found.select("url").distinct().join(stored.select("url").distinct(), "url", "left_anti")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(url, status): new, updated, deleted or unchanged; texts themselves aren't joined.

    A url may have several rows: it is unchanged if both sides hold the same contents equally often, whatever the
    order. Contents are compared by their number and two sums of 128-bit hashes. A null url takes no part; a null content is one of its own.
    """
    old, new = _contents(before, "old"), _contents(after, "new")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return old.join(new, "url", "full_outer").select("url", status.alias("status"))


def _contents(rows: DataFrame, name: str) -> DataFrame:
    sha = F.coalesce(F.sha2("content", 256), F.lit("0" * 64))
    half = lambda k: F.sum(F.conv(F.substring(sha, 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)"))
    return rows.filter("url IS NOT NULL").groupBy("url").agg(F.struct(F.count("*"), half(0), half(1)).alias(name))


def apply_changes(before: DataFrame, after: DataFrame, status: DataFrame) -> DataFrame:
    """The store after deletes, and updates as delete and insert: it holds the rows of `after` for every url."""
    stays = status.filter("status = 'unchanged'").select("url")
    comes = status.filter("status IN ('new', 'updated')").select("url")
    return before.join(stays, "url", "left_semi").unionByName(after.join(comes, "url", "left_semi"))


def write_vectors(rows: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """rows with the vector of vectors where it has one for the key; of several for a key the largest is written."""
    fresh = vectors.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("vector").alias("fresh"))
    return rows.join(fresh, key, "left").withColumn("vector", F.coalesce("fresh", "vector")).drop("fresh")


def clear_vectors(rows: DataFrame, source: str) -> DataFrame:
    return rows.withColumn("vector", F.when(~F.col("source").eqNullSafe(F.lit(source)), F.col("vector")))


def backlog(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows without a vector, by id."""
    return rows.filter("vector IS NULL").orderBy("id").limit(n)


def ingest_summary(results: DataFrame) -> DataFrame:
    """(source, processed, success, errors) of rows (source, error); a null source is a source of its own."""
    return results.groupBy("source").agg(F.count("*").alias("processed"), F.count_if(F.col("error").isNull()).alias("success"), F.count("error").alias("errors"))


def ingest_errors(results: DataFrame) -> DataFrame:
    """(source, message, n): the errors behind a summary, as rows, so that no source's list is held in one place."""
    return results.filter("error IS NOT NULL").groupBy("source", F.col("error").alias("message")).agg(F.count("*").alias("n"))


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("chunks"), F.count("vector").alias("embedded"))


def equal(**wanted) -> Column:
    out = F.lit(True)
    for name, value in wanted.items():
        out &= F.col(name) == value
    return out


def with_defaults(rows: DataFrame, now: Column, version: str = "6u3", language: str = "ja") -> DataFrame:
    """Missing version, language and times filled; one `now` for the whole run."""
    have = set(rows.columns)
    value = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    return rows.withColumns({"version": value("version", F.lit(version)), "language": value("language", F.lit(language)), "created_at": value("created_at", now), "updated_at": value("updated_at", now)})


METADATA = ("source", "source_type", "language", "url", "module", "app_type", "fqcn")


def metadata_columns(rows: DataFrame, names: tuple[str, ...] = METADATA) -> DataFrame:
    """The metadata map's known keys as columns, null where it lacks one."""
    return rows.withColumns({n: F.try_element_at("metadata", F.lit(n)) for n in names}).drop("metadata")
