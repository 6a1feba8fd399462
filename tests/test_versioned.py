"""The versioned store: every change against a plain list of rows, and runs that fail, compete or meet awkward rows."""

import random
from collections import Counter

import pytest
from inkwell.operators import store
from inkwell.plans.views import table
from inkwell.sources import versioned
from inkwell.sources.versioned import Conflict, Store
from pyspark.sql import functions as F

KIND = "source string, url string, content string, k int"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, KIND)


def bag(df):
    return Counter((r["source"], r["url"], r["content"], r["k"]) for r in df.collect())


@pytest.fixture
def place(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


@pytest.mark.parametrize("named", [1_000, 0])
def test_any_sequence_of_changes_equals_a_plain_list(spark, place, monkeypatch, named):
    """Kept digests equal those of the rows after every change, however replaced sources are kept."""
    monkeypatch.setattr(versioned, "NAMED", named)
    rnd, plain, every = random.Random(named), [], {}
    make = lambda n: [(rnd.choice(["a", "b", "c", None]), rnd.choice([f"u{i}" for i in range(12)] + [None]), rnd.choice(["x", "y", None, ""]), rnd.randrange(3)) for _ in range(n)]
    for step in range(8):
        how = ["append", "replace", "upsert", "delete", "compact"][step % 5] if step else "append"
        new = make(rnd.randrange(1, 9))
        if how == "append":
            version, plain = place.append(rows_of(spark, new)), plain + new
        elif how == "replace":
            version, plain = place.replace(rows_of(spark, new)), [r for r in plain if r[0] not in {n[0] for n in new}] + new
        elif how == "upsert":
            version, plain = place.upsert(rows_of(spark, new)), [r for r in plain if r[1] not in {n[1] for n in new}] + new
        elif how == "delete":
            version, plain = place.delete(rows_of(spark, new).select("url")), [r for r in plain if r[1] not in {n[1] for n in new}]
        else:
            version = place.compact()
        every[version] = Counter(plain)
        assert bag(place.read()) == every[version]
        kept = {tuple(r) for r in place.digests().collect()}
        assert kept == {tuple(r) for r in versioned.digest(rows_of(spark, plain), versioned.url_range(F.col("url")).alias("range")).collect()}
    assert place.versions() == list(every) and all(bag(place.read(v)) == rows for v, rows in every.items())
    assert place.vacuum() > 0 and place.versions() == [max(every)] and bag(place.read()) == every[max(every)]


def test_incremental_rows_keep_those_stored(spark, place):
    place.append(rows_of(spark, [("x", "x/0", "a", 0), ("x", "x/1", "b", 0)]))
    place.append(rows_of(spark, [("x", "x/2", "c", 0)]))
    assert {r["url"] for r in place.read().collect()} == {"x/0", "x/1", "x/2"}


def test_a_failed_run_changes_nothing(spark, place):
    place.append(rows_of(spark, [("x", "x/0", "a", 0)]))
    broken = rows_of(spark, [("x", "x/1", "b", 0)]).withColumn("content", F.raise_error(F.lit("no")).cast("string"))
    for change in (place.append, place.replace, place.upsert):
        with pytest.raises(Exception, match="no"):
            change(broken)
    with pytest.raises(ValueError, match="other columns"):
        place.append(rows_of(spark, []).drop("k"))

    def stopped(manifest, name):
        place._add(rows_of(spark, [("x", "x/1", "b", 0)]), manifest, name)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        place._change(stopped)
    assert place.versions() == [1] and [r["url"] for r in place.read().collect()] == ["x/0"]
    assert place.vacuum() == 2 and place.read().count() == 1


def test_of_two_runs_at_once_one_publishes(spark, place):
    place.append(rows_of(spark, [("x", "x/0", "a", 0)]))

    def steps(manifest, name):
        place.append(rows_of(spark, [("x", "x/1", "b", 0)]))
        place._add(rows_of(spark, [("x", "x/2", "c", 0)]), manifest, name)

    with pytest.raises(Conflict):
        place._change(steps)
    assert {r["url"] for r in place.read().collect()} == {"x/0", "x/1"}


def test_a_reader_keeps_its_version(spark, place):
    place.append(rows_of(spark, [("x", "x/0", "a", 0)]))
    before = place.read()
    place.replace(rows_of(spark, [("x", "x/9", "z", 0)]))
    assert [r["url"] for r in before.collect()] == ["x/0"] and [r["url"] for r in place.read().collect()] == ["x/9"]


def test_empty_changes_and_an_empty_store(spark, place):
    with pytest.raises(ValueError, match="no version"):
        place.read()
    place.append(rows_of(spark, []))
    assert place.read().count() == 0 and place.digests().count() == 0
    place.replace(rows_of(spark, [("", "u", None, 1)]))
    place.delete(rows_of(spark, []).select("url"))
    assert bag(place.read()) == Counter([(None, "u", None, 1)])
    assert place.changes(rows_of(spark, [])).collect()[0].asDict() == {"url": "u", "status": "deleted"}


def test_a_hot_source_is_many_files(spark, place):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("source"), F.concat(F.lit("u"), F.col("id") % 7).alias("url"), F.col("id").cast("string").alias("content"), F.lit(1).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these files are far below the advisory size
    place.append(rows.repartition(6))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = Counter(r[0] for r in place.read().select(F.regexp_extract(F.input_file_name(), "source=([a-z]+)", 1), F.input_file_name()).distinct().collect())
    assert files["hot"] >= 3


def test_only_ranges_that_differ_are_read(spark, sf, place, capsys):
    docs = table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("url"), F.col("text").alias("content"), F.lit(1).alias("k"))
    place.append(docs)
    assert place.differing(docs) == []
    after = docs.filter("url <> '7'").withColumn("content", F.when(F.col("url") == "11", "new").otherwise(F.col("content"))).unionByName(rows_of(spark, [("q", "fresh", "f", 1)]))
    ranges = place.differing(after)
    assert len(ranges) <= 3
    want, got = store.changes(docs, after), place.changes(after)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got.explain("formatted")
    filters = [line for line in capsys.readouterr().out.split("\n") if line.startswith("PushedFilters")]
    assert any("range" in line for line in filters)


@pytest.mark.parametrize("how", ["append", "replace", "upsert"])
def test_staged_rows_are_taken_as_others(spark, tmp_path, how):
    old = [("a", "u0", "x", 0), ("a", "u1", "x", 0), ("b", "u2", "x", 0), (None, "u3", "x", 0)]
    new = [("a", "u0", "y", 1), ("", "u4", None, 1), ("c", None, "z", 1), ("c", "u2", "z", 1)]
    places = [Store(spark, f"file://{tmp_path}/{n}") for n in ("plain", "staged")]
    for rows in (old, new, []):
        own = [(r, False) for r in rows] + [(("a", "u0", f"report {i}", None), True) for i in range(2 * bool(rows))]
        made = spark.createDataFrame([(*r, b) for r, b in own], KIND + ", beside boolean").repartition(3)
        staged = places[1].stage(made)
        assert [r["content"] for r in staged.beside.orderBy("content").collect()] == [r[2] for r, b in own if b]
        assert places[1].versions() == places[0].versions()
        for place, given in zip(places, (rows_of(spark, rows), staged)):
            getattr(place, how)(given)
        assert bag(places[1].read()) == bag(places[0].read())
        assert {tuple(r) for r in places[1].digests().collect()} == {tuple(r) for r in places[0].digests().collect()}
    assert len(places[1].manifest()["parts"]) == 2 and places[1].vacuum() >= 3
    assert bag(places[1].read()) == bag(places[0].read())


def test_staged_rows_of_other_columns_change_nothing(spark, place):
    place.append(rows_of(spark, [("x", "x/0", "a", 0)]))
    with pytest.raises(ValueError, match="other columns"):
        place.append(place.stage(rows_of(spark, [("x", "x/1", "b", 0)]).drop("k").withColumn("beside", F.lit(False))))
    assert place.versions() == [1] and place.vacuum() == 1 and place.read().count() == 1
