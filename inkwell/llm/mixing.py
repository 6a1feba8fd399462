"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over time u in [0, 1], linear from its opening to its closing emphasis; the
schedule's integral is the source's target. A source's documents stand in a fixed pseudo-random order, which is gone
through as often as the target asks, and a take whose words begin at share p of the source's taken words is trained at
the u where the integrated schedule reaches p. So every source lasts from 0 to 1, whether it is cut or repeated.

The clock of training is words, not u: the position of a take is the share of all sources' words that their schedules
have asked for by u. So each tenth of the positions holds a tenth of the words, and at each position a source has its
weight over the sum of all weights there. The whole mix is range-sorted by position.

Running totals inside a source come from two levels: sums by (source, hash bucket), then a window inside each bucket,
so that a source with a third of all rows is spread over many tasks; the number of buckets grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, tidy, written

#: Fixed by the mix: weights by source order, and the most that a source may be repeated.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Rows that a bucket holds on average.
BUCKET_ROWS = 10_000
#: (opening, closing) emphasis of the schedules, by source order; repeating.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
WORDS = r"[^\x20\x09-\x0D]+"


def sizes(text: Column) -> Column:
    """Words of a text, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `rank` from 0 in code-point order, null last: a range sort, then offsets by partition."""
    ordered = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = written(ordered.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "mix-sources")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    offsets = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = F.row_number().over(W.partitionBy("part").orderBy("seq")) - 1
    return placed.withColumn("within", within).join(offsets, "part").withColumn("rank", F.col("within") + F.col("offset")).drop("part", "seq", "within", "offset")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) with rank, weight and target.

    The sizes' total is shared by weight; sources above `most` times their size stop there and the excess is reshared
    by weight among the rest until none is above. Each round is one aggregate; only three numbers reach the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    base = written(ranked(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * most), "mix-ranked")
    total = base.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("most") <= level * F.col("weight")
        n, kept, free = base.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (total - kept) / free
    return base.withColumn("target", F.least("most", F.lit(float(level)) * F.col("weight"))).drop("most")


def mix(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows of docs (doc_id, text, source) with size, source_size, target, taken, position and positions; others dropped.

    taken counts words: each document is taken floor(target / source_size) times in whole, and the rest of the target
    goes to documents in the order of a hash of (doc_id, text), the last of them in part. Null texts have size 0 and
    are taken 0 times; a null source is a source of its own; repeated rows are ordered by their row number. positions are
    where the first words of each take are trained, as shares of all taken words in [0, 1), and position is the first of them; both are null for a
    document that is not taken. A very long text is a document of its size like others; an empty table gives an empty one.
    """
    return _mixed(_with_sizes(docs.select("doc_id", "text", "source")), buckets)


def _with_sizes(docs: DataFrame) -> DataFrame:
    """A written table: doc_id, source, size, a hash that fixes the order, and a row number."""
    tie = F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), sizes(F.col("text")).alias("size"), tie.alias("tie"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")


def _mixed(rows: DataFrame, buckets: int | None) -> DataFrame:
    if buckets is None:
        buckets = max(16, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod("tie", F.lit(buckets)))
    sums = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-sums")
    shares = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    opening, closing = shares.agg(*(F.coalesce(F.sum(F.round("target") * x), F.lit(0.0)) for x in emphasis(F.col("rank")))).first()
    place = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    plan = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(place), F.lit(0))).join(
        shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    plan = written(plan, "mix-plan").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target", "rank")
    own = W.partitionBy("source", "bucket").orderBy("tie", "doc_id", "row").rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    out = out.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    start = F.col("before") + F.col("inner")
    times = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    extra = F.round(F.col("target")).cast("bigint") - times * F.col("source_size")
    part = F.least("size", F.greatest(F.lit(0).cast("bigint"), extra - start))
    out = out.withColumn("start", start).withColumn("taken", (times * F.col("size") + part).cast("bigint"))
    out = out.withColumn("takes", (times + (part > 0).cast("bigint")).cast("int"))
    at = lambda k: spent(reached((k * F.col("source_size") + F.col("start")) / F.greatest(F.round("target"), F.lit(1)), F.col("rank")), opening, closing)
    out = out.withColumn("positions", F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0), F.greatest("takes", F.lit(1)) - 1), at)))
    return out.withColumn("position", F.get("positions", F.lit(0))).drop("bucket", "inner", "before", "tie", "rank", "start", "takes")


def emphasis(rank: Column, schedules=SCHEDULES) -> tuple[Column, Column]:
    """A source's opening and closing emphasis."""
    pick = (rank % len(schedules) + 1).cast("int")
    return tuple(F.element_at(F.array(*[F.lit(float(pair[i])) for pair in schedules]), pick) for i in (0, 1))


def reached(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The time at which a schedule a + (b - a) u, scaled to integrate to 1, has spent `share` of its demand."""
    a, b = emphasis(rank, schedules)
    p = share * (a + b) / 2
    return F.when(a == b, share).otherwise((F.sqrt(a * a + 2 * (b - a) * p) - a) / F.when(a != b, b - a) + F.lit(0.0))


def spent(u: Column, opening: float, closing: float) -> Column:
    """The share of all words that schedules with these sums of demand at u = 0 and u = 1 have asked for by u."""
    return u * (opening + (closing - opening) / 2 * u) / max((opening + closing) / 2, 1.0)


def ordered(mixed: DataFrame) -> DataFrame:
    """The mix in training order: a range sort by position, ties by doc_id."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id", "row")


@tidy
def resample(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each time that a document is taken, in training order.

    A document is taken round(taken / size) times; documents without words are kept once, as clean rows that cost
    nothing. Columns stay as they are.
    """
    names, spark = docs.columns, docs.sparkSession
    inner = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    inner = written(inner, "mix-docs")
    rows = inner.select(F.col("doc.doc_id").cast("bigint").alias("doc_id"), F.col("doc.source").cast("string").alias("source"), sizes(F.col("doc.text")).alias("size"), F.xxhash64("doc.doc_id", F.coalesce("doc.text", F.lit(""))).alias("tie"), "row")
    plan = _mixed(written(rows, "mix-rows"), None)
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    plan = plan.select("row", "positions", times.alias("times")).filter("times > 0")
    plan = plan.select("row", F.posexplode(F.coalesce(F.slice("positions", F.lit(1), F.col("times")), F.array(F.lit(None).cast("double")))).alias("copy", "position"))
    out = inner.join(written(plan, "mix-taken"), "row")
    return out.orderBy(F.col("position").asc_nulls_last(), "row", "copy").select(*[F.col("doc").getField(n).alias(n) for n in names])


@tidy
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "position", "positions")
