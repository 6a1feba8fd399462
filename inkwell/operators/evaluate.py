"""Retrieval quality over ranked rows."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.sources.shared import written


def relevant(content: Column, words: Column) -> Column:
    """Content holds any of the words, whatever the case."""
    low = F.lower(content)
    return F.coalesce(F.exists(words, lambda w: F.contains(low, F.lower(w))), F.lit(False))


def _gain(k: int, rel: Column, rank: Column) -> Column:
    return F.sum(F.when((rank <= k) & rel, F.log(F.lit(2.0)) / F.log(rank + 1.0)).otherwise(0.0))


def per_query(ranked: DataFrame, keys: tuple[str, ...] = ("query_id",), ks: tuple[int, ...] = (5, 10), digits: int | None = None) -> DataFrame:
    """Reciprocal rank, recall, relevant count and NDCG at each k in one aggregate; ranked has rank and rel.

    The ideal gain counts the relevant rows that were retrieved in the first k. Values are rounded only if digits are
    given, so that means of them are rounded once. A null rel counts as not relevant.
    """
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    rel, rank = F.col("rel"), F.col("rank")
    out = [F.coalesce(F.max(F.when(rel, 1.0 / rank)), F.lit(0.0)).alias("mrr")]
    for k in ks:
        out += [
            F.max(F.when((rank <= k) & rel, 1.0).otherwise(0.0)).alias(f"recall_{k}"),
            F.count_if((rank <= k) & rel).alias(f"relevant_{k}"),
            _gain(k, rel, rank).alias(f"dcg_{k}"),
        ]
    got = ranked.groupBy(*keys).agg(*out)
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col(f"relevant_{k}"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(F.lit(2.0)) / F.log(i + 1.0))
        got = got.withColumn(f"ndcg_{k}", cut(F.when(F.col(f"relevant_{k}") > 0, F.col(f"dcg_{k}") / ideal).otherwise(0.0))).drop(f"dcg_{k}")
    return got.withColumn("mrr", cut(F.col("mrr")))


def summary(metrics: DataFrame, category: str = "category", language: str = "language") -> DataFrame:
    """Means by category, by language and overall, from one pass of grouping sets."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("mrr", "recall_5", "recall_10", "ndcg_5")]
    level = (F.grouping(category) * 2 + F.grouping(language)).cast("int")
    return metrics.groupingSets([[category], [language], []], category, language).agg(level.alias("level"), F.count("*").alias("queries"), *means)


def graded(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg, recall, precision) with gain 2^grade - 1; gold rows of grade 2 or more are the relevant ones."""
    hits = ranked.join(gold, ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) * F.log(F.lit(2.0)) / F.log(r + 1.0)
    got = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.count_if(F.col("grade") >= 2).alias("hits"))
    ordered = gold.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("grade"), False), 1, k).alias("grades"), F.count_if(F.col("grade") >= 2).alias("golden"))
    ideal = F.aggregate(F.transform("grades", lambda g, i: gain(g, i + 1)), F.lit(0.0), lambda s, x: s + x)
    rows = ordered.join(got, "query_id", "left").withColumn("ideal", ideal)
    return rows.select(
        "query_id",
        F.round(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"),
        F.round(F.when(F.col("golden") > 0, F.coalesce("hits", F.lit(0)) / F.col("golden")).otherwise(0.0), 6).alias("recall"),
        F.round(F.coalesce("hits", F.lit(0)) / F.lit(float(k)), 6).alias("precision"),
    )


def coverage(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(queries, covered, coverage): the share of the queries (query_id) with at least one result."""
    found = ranked.select("query_id", F.lit(1).alias("hit")).distinct()
    rows = queries.select("query_id").distinct().join(found, "query_id", "left")
    return rows.agg(F.count("*").alias("queries"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.greatest(F.count("*"), F.lit(1)), 6).alias("coverage"))


def compared(metrics: DataFrame, modes: list[str], value: str = "mrr") -> DataFrame:
    """One row a query with the value of every mode beside it; modes are named, so none is looked for in the rows."""
    return metrics.groupBy("query_id").pivot("mode", modes).agg(F.round(F.first(value), 6))


def paired(compare: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_difference, t, effect): paired t statistic and Cohen's d of b - a."""
    d = F.coalesce(F.col(b), F.lit(0.0)) - F.coalesce(F.col(a), F.lit(0.0))
    stats = compare.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    sure = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd"))
    return stats.select("n", F.round("mean", 6).alias("mean_difference"), F.round(sure * F.sqrt("n"), 6).alias("t"), F.round(sure, 6).alias("effect"))


#: Stretches that a group's values are cut in by a sketch, whose quality changes their sizes alone.
STRETCHES = 100


def latency(rows: DataFrame, value: str, *by: str, exact: bool = True, points: tuple[str, ...] = ("0.5", "0.95", "0.99")) -> DataFrame:
    """p50, p95 and p99 of a value by group: the values of the rows at ranks ceil(n * point). Nulls don't count, and a group
    without values has nulls.

    A sketch cuts each group's values in STRETCHES, whose rows are counted; only the stretches that hold an asked rank are
    then counted value by value, so no group is sorted by one task. exact=False takes the sketch's own values, which are
    off by at most a ten-thousandth of the rank.
    """
    names = [f"p{int(Decimal(p) * 100)}" for p in points]
    if not exact:
        return rows.groupBy(*by).agg(*[F.round(F.percentile_approx(value, float(p), 10_000), 6).alias(n) for p, n in zip(points, names)])
    own = rows.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.col(value).alias("v"))
    edges = F.percentile_approx("v", F.array(*[F.lit(i / STRETCHES) for i in range(1, STRETCHES)]), 10_000)
    cuts = written(own.groupBy("g").agg(F.count("v").alias("n"), edges.alias("edges")), "latency-cuts")
    placed = own.filter("v IS NOT NULL").join(cuts.select(F.col("g").alias("h"), "edges"), F.col("g").eqNullSafe(F.col("h")))
    placed = placed.select("g", "v", F.size(F.filter("edges", lambda x: x < F.col("v"))).alias("stretch"))
    sizes = placed.groupBy("g", "stretch").agg(F.count("*").alias("m"))
    before = lambda per, order: F.sum("m").over(W.partitionBy(*per).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col("m")
    sizes = sizes.withColumn("before", before(["g"], "stretch")).join(cuts.select(F.col("g").alias("h"), "n"), F.col("g").eqNullSafe(F.col("h"))).drop("h")

    def rank(point: str) -> Column:
        top, under = Decimal(point).as_integer_ratio()
        return F.expr(f"(n * {top}L + {under - 1}L) div {under}L")

    holds = lambda p: (F.col("before") < rank(p)) & (rank(p) <= F.col("before") + F.col("m"))
    asked = sizes.filter(reduce(or_, map(holds, points))).select(F.col("g").alias("h"), F.col("stretch").alias("s"), "n", F.col("before").alias("first"))
    near = placed.join(asked, F.col("g").eqNullSafe(F.col("h")) & (F.col("stretch") == F.col("s")))
    values = near.groupBy("g", "stretch", "v", "n", "first").agg(F.count("*").alias("m"))
    values = values.withColumn("before", F.col("first") + before(["g", "stretch"], "v"))
    found = values.groupBy(F.col("g").alias("h")).agg(*[F.max(F.when(holds(p), F.col("v"))).alias(n) for p, n in zip(points, names)])
    out = cuts.select("g").join(found, F.col("g").eqNullSafe(F.col("h")), "left")
    return out.select(*[F.col("g")[c].alias(c) for c in by], *[F.round(n, 6).alias(n) for n in names])
