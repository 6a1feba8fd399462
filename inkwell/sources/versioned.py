"""The chunk store as versions of immutable files: append, replace, upsert and delete, each a new version at once.

A change first writes its rows to a folder of its own, in files sorted by source and url range, and last a manifest that
names the folders of the new version. Readers take the newest manifest and see that version alone; a run that fails
before its manifest changes nothing. Deleted rows are named in a table beside the data and left out when reading, until
`compact` rewrites the store. Digests of url ranges are kept with the rows, so that another table of contents is compared
range by range and only ranges that differ are read.

Rows need the columns source, url and content; an empty source is stored as a null one, and null sources and urls are
keys like others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import store
from inkwell.sources.shared import remove

#: Ranges of the hash of urls, and replaced sources up to which the manifest names them; more go to the table of gone rows.
RANGES, NAMED = 4096, 1_000
#: Order of stored rows, and what their files are packed with: texts take about two thirds of what Spark's own choice takes.
ORDER, CODEC = ("source", "range", "url"), "zstd"
#: Columns of a digest: the number of rows and four sums of 32 bits of two hashes of them.
SUMS = ("n", "a", "b", "c", "d")


def url_range(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(RANGES)).cast("int")


def digest(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """SUMS of rows (url, content) by keys; equal multisets of rows have equal sums, whatever their order."""
    one, two = F.xxhash64("url", "content"), F.xxhash64(F.lit(1), "content", "url")
    parts = [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))) if low else F.sum(F.shiftrightunsigned(h, 32)) for h in (one, two) for low in (True, False)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[p.alias(name) for p, name in zip(parts, SUMS[1:])])


class Conflict(RuntimeError):
    """Another run has published the version that this one wanted to."""


class Staged(NamedTuple):
    """What `Store.stage` wrote: its folder below the store's, the columns of the store, and the rows beside them."""

    name: str
    schema: T.StructType
    beside: DataFrame


class Store:
    """A versioned store of rows at a path that driver and executors share."""

    #: Folders of a version.
    KINDS: tuple[str, ...] = ("data", "digests", "gone")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Versions

    def _fs(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        fs, place = self._fs("_versions")
        names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "parts": {}, "gone": []}
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        fs, place = self._fs(f"_versions/{version or known[-1]:010d}.json")
        stream = fs.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> int:
        """The manifest becomes visible by a rename, which is the last step of a change."""
        fs, final = self._fs(f"_versions/{manifest['version']:010d}.json")
        _, temporary = self._fs(f"_versions/.{uuid.uuid4().hex}")
        stream = fs.create(temporary, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise Conflict(f"version {manifest['version']} is there already")
        return manifest["version"]

    def _change(self, steps: Callable[[dict, str], None]) -> int:
        manifest = self.manifest()
        manifest["version"] += 1
        steps(manifest, f"{manifest['version']:010d}-{uuid.uuid4().hex[:8]}")
        return self._publish(manifest)

    # Reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        return self._rows(self.manifest(version)).drop("commit", "range")

    def _rows(self, manifest: dict) -> DataFrame:
        """Rows with `commit`, whose names sort by age, and `range`."""
        if manifest["schema"] is None:
            raise ValueError("the store has no version yet")
        schema = T.StructType.fromJson(manifest["schema"]).add("range", T.IntegerType()).add("commit", T.StringType())
        rows = self._parts("data", manifest, schema)
        if not manifest["gone"]:
            return rows
        gone = self._gone(manifest).groupBy(F.col("source").alias("_s"), F.col("url").alias("_u")).agg(F.max("commit").alias("_c"))
        return rows.join(gone, F.col("source").eqNullSafe(F.col("_s")) & F.col("url").eqNullSafe(F.col("_u")) & (F.col("commit") < F.col("_c")), "left_anti")

    def _parts(self, kind: str, manifest: dict, schema: T.StructType) -> DataFrame:
        """Rows of the manifest's folders of a kind; sources that a later version replaced aren't read."""
        paths = [f"{self.path}/{kind}/commit={c}" for c in manifest["parts"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths)
        return rows.filter(~self._dead(manifest, F.col("commit")))

    def _dead(self, manifest: dict, commit: Column) -> Column:
        out = F.lit(False)
        for name, dead in manifest["parts"].items():
            if dead:
                some = [s for s in dead if s is not None]
                out |= (commit == name) & F.coalesce(F.col("source").isin(some), F.lit(None in dead))
        return out

    def _gone(self, manifest: dict) -> DataFrame:
        paths = [f"{self.path}/gone/commit={c}" for c in manifest["gone"]]
        schema = T.StructType.fromDDL("source string, url string, of string, range int, " + ", ".join(f"{x} bigint" for x in SUMS) + ", commit string")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/gone").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Changes

    def stage(self, rows: DataFrame) -> Staged:
        """Rows written in the store's layout as a part of no version. A change takes them in by a rename, so that wide
        rows are neither shuffled nor written again for it.

        Tasks sort the rows that they have, which should be a stretch by source and url range each. Where the boolean
        column `beside` holds, a row is none of the store's and is read from the result, with its source as in the store.
        Both kinds are taken once; `vacuum` removes what no change has taken.
        """
        placed, schema = self._placed(rows, "beside")
        name, order = f"data/staged={uuid.uuid4().hex}", ["beside", *ORDER, F.xxhash64("content")]
        placed.sortWithinPartitions(*order).write.option("compression", CODEC).partitionBy("beside", "source").parquet(f"{self.path}/{name}")
        fs, place = self._fs(f"{name}/beside=true")
        beside = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/beside=true") if fs.exists(place) else self.spark.createDataFrame([], schema)
        return Staged(name, schema, beside)

    def append(self, rows: DataFrame | Staged) -> int:
        """A version with rows added to those of the newest."""
        return self._change(lambda manifest, name: self._add(rows, manifest, name))

    def replace(self, rows: DataFrame | Staged) -> int:
        """A version in which the sources that rows hold have these rows and no others; other sources are as before."""

        def steps(manifest, name):
            old = list(manifest["parts"])
            self._add(rows, manifest, name)
            if not old or name not in manifest["parts"]:
                return
            own = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/commit={name}").select(F.col("source").cast("string").alias("source")).distinct()
            named = [r[0] for r in own.limit(NAMED + 1).collect()]
            if len(named) <= NAMED:
                for part in old:
                    manifest["parts"][part] = sorted({*manifest["parts"][part], *named}, key=lambda s: (s is None, s or ""))
            else:
                before = self._rows(manifest).filter(F.col("commit") != name)
                same = F.col("source").eqNullSafe(F.col("_s"))
                self._lose(before.join(own.select(F.col("source").alias("_s")), same, "left_semi"), manifest, name)

        return self._change(steps)

    def upsert(self, rows: DataFrame | Staged) -> int:
        """A version in which the urls that rows hold have these rows and no others, in whatever source they were."""

        def steps(manifest, name):
            before = self._rows(manifest) if manifest["schema"] else None
            self._add(rows, manifest, name)
            if before is not None:
                own = self.spark.read.schema("url string").parquet(f"{self.path}/data/commit={name}")
                self._lose(self._meeting(before, own), manifest, name)

        return self._change(steps)

    def delete(self, urls: DataFrame) -> int:
        """A version without the rows of these urls (url)."""
        return self._change(lambda manifest, name: self._lose(self._meeting(self._rows(manifest), urls), manifest, name))

    def _meeting(self, rows: DataFrame, urls: DataFrame) -> DataFrame:
        return rows.join(urls.select(F.col("url").alias("_u")).distinct(), F.col("url").eqNullSafe(F.col("_u")), "left_semi")

    def _placed(self, rows: DataFrame, *others: str) -> tuple[DataFrame, T.StructType]:
        """Rows with `range` as they are stored, and the columns of the store, which `others` aren't."""
        rows = rows.withColumn("source", F.nullif(F.col("source").cast("string"), F.lit("")))
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in sorted(rows.schema.fields, key=lambda f: f.name) if f.name not in others])
        return rows.select(*schema.names, url_range(F.col("url")).alias("range"), *others), schema

    def _take(self, staged: Staged, name: str) -> None:
        fs, made = self._fs(f"{staged.name}/beside=false")
        _, final = self._fs(f"data/commit={name}")
        if not (fs.rename(made, final) if fs.exists(made) else fs.mkdirs(final)):
            raise OSError(f"staged rows can't become {final}")

    def _add(self, rows: DataFrame | Staged, manifest: dict, name: str) -> None:
        placed, schema = (None, rows.schema) if isinstance(rows, Staged) else self._placed(rows)
        if manifest["schema"] is not None and [(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(manifest["schema"])] != [(f.name, f.dataType.simpleString()) for f in schema]:
            raise ValueError("rows have other columns than the store")
        manifest["schema"] = json.loads(schema.json())
        if placed is None:
            self._take(rows, name)
        else:
            order = [*ORDER, F.xxhash64("content")]
            # a range sort: a source with a third of all rows, and even such a url, is many files
            placed.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", CODEC).partitionBy("source").parquet(f"{self.path}/data/commit={name}")
        there = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("range", T.IntegerType())])).parquet(f"{self.path}/data/commit={name}")
        digest(there, "source", "range").write.parquet(f"{self.path}/digests/commit={name}")
        if self.spark.read.schema("n bigint").parquet(f"{self.path}/digests/commit={name}").take(1):
            manifest["parts"][name] = []

    def _lose(self, rows: DataFrame, manifest: dict, name: str) -> None:
        """The rows (with commit) are gone from this version on; what they add to digests is kept with them."""
        digest(rows, "source", "url", F.col("commit").alias("of"), "range").write.parquet(f"{self.path}/gone/commit={name}")
        if self.spark.read.schema("n bigint").parquet(f"{self.path}/gone/commit={name}").take(1):
            manifest["gone"].append(name)

    # Comparing

    def digests(self, version: int | None = None) -> DataFrame:
        """(range, n, a, b, c, d) of the rows of a version, from what is kept; no row of the store is read."""
        manifest = self.manifest(version)
        schema = T.StructType.fromDDL("source string, range int, " + ", ".join(f"{x} bigint" for x in SUMS) + ", commit string")
        parts = self._parts("digests", manifest, schema).select("range", *SUMS)
        alive = F.col("of").isin(list(manifest["parts"])) & ~self._dead(manifest, F.col("of"))
        lost = self._gone(manifest).filter(alive).select("range", *[(-F.col(x)).alias(x) for x in SUMS])
        return parts.unionByName(lost).groupBy("range").agg(*[F.sum(x).alias(x) for x in SUMS]).filter("n > 0")

    def differing(self, rows: DataFrame, version: int | None = None) -> list[int]:
        """The url ranges, of RANGES at most, in which rows (url, content) differ from a version."""
        theirs = digest(rows.select("url", "content"), url_range(F.col("url")).alias("range"))
        both = self.digests(version).alias("x").join(theirs.alias("y"), "range", "full_outer")
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in SUMS]
        return sorted(r[0] for r in both.filter(~_all(same)).select("range").collect())

    def changes(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """(url, status) of rows (url, content) against a version: what `store.changes` gives, while only url ranges that
        differ are read from the store. Null urls take no part."""
        rows = rows.select("url", "content").filter("url IS NOT NULL")
        manifest = self.manifest(version)
        ranges = self.differing(rows, manifest["version"])
        before = self._rows(manifest).filter(F.col("range").isin(ranges)).select("url", "content")
        inside = url_range(F.col("url")).isin(ranges)
        rest = rows.filter(~inside).select("url").distinct().withColumn("status", F.lit("unchanged"))
        return store.changes(before, rows.filter(inside)).unionByName(rest)

    # Upkeep

    def compact(self) -> int:
        """A version of the same rows in one folder, without rows that are gone."""

        def steps(manifest, name):
            rows = self._rows(manifest).drop("commit", "range")
            manifest["parts"], manifest["gone"] = {}, []
            self._add(rows, manifest, name)

        return self._change(steps)

    def vacuum(self, keep: int = 1) -> int:
        """Remove versions older than the newest `keep`, and folders that none of those names; gives the folders removed.

        Not to be run while a change or a reader of an older version is under way.
        """
        known = self.versions()
        held = [self.manifest(v) for v in known[-max(keep, 1) :]]
        used = {(kind, c) for m in held for kind in self.KINDS for c in m["gone" if kind == "gone" else "parts"]}
        out = []
        for kind in self.KINDS:
            fs, place = self._fs(kind)
            for f in fs.listStatus(place) if fs.exists(place) else []:
                if (kind, f.getPath().getName().removeprefix("commit=")) not in used:
                    out.append(f"{self.path}/{kind}/{f.getPath().getName()}")
        remove(self.spark, [*out, *[f"{self.path}/_versions/{v:010d}.json" for v in known[: -max(keep, 1)]]])
        return len(out)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out
