"""Ingest against plain parsers and a plain chunker written here, over whole pages, twice, on empty and failing input."""

import pytest
from inkwell.operators import ingest
from inkwell.plans import corpus, registry
from inkwell.sources.versioned import Store
from pyspark.sql import functions as F

from .plain import chunks_of, sections_of


def made_of(pages):
    """Chunks of each (source, url) by the plain parser and chunker."""
    out = {}
    for source, url, body in pages:
        if body and body.strip():
            n = sum(len(chunks_of(content, 512, 128)) for content in sections_of(body))
            if n:
                out[source, url] = n
    return out


def stored(spark, path):
    return {(r["source"], r["url"]): r["n"] for r in Store(spark, path).read().groupBy("source", "url").agg(F.count("*").alias("n")).collect()}


def pages_of(spark, sf):
    return [tuple(r) for r in corpus._pages(spark, sf).select("source", "url", "body").collect()]


def test_two_incremental_runs_keep_what_is_stored(spark, sf):
    got = {(r["source"], r["url"]): r["chunks"] for r in registry.QUERIES["ingest_pages"](spark, sf).collect()}
    assert got == made_of(pages_of(spark, sf)) and len(got) > 30


def test_a_refresh_replaces_one_source(spark, sf):
    plain = made_of(pages_of(spark, sf))
    even = {r["url"] for r in corpus._pages(spark, sf).filter("page_id % 2 = 0").collect()}
    want = {}
    for (source, url), n in plain.items():
        if source != "host3" or url in even:
            urls, chunks = want.get(source, (0, 0))
            want[source] = (urls + 1, chunks + n)
    assert {r["source"]: (r["urls"], r["chunks"]) for r in registry.QUERIES["ingest_refresh"](spark, sf).collect()} == want


PAGE = "<html><body><h2>{0}</h2><p>" + "word " * 30 + "</p></body></html>"
KIND = "source string, url string, body string"


def run(spark, path, rows, mode="append", **more):
    return {r["source"]: tuple(r)[1:] for r in ingest.ingest(spark.createDataFrame(rows, KIND), path, corpus.now(), mode, **more).collect()}


def test_modes_on_awkward_pages(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    first = [("x", "x/0", PAGE.format(0)), ("x", "x/1", PAGE.format(1)), ("y", "y/0", PAGE.format(2)), (None, "n/0", PAGE.format(3))]
    assert run(spark, path, first) == {"x": (2, 2, 0, 2), "y": (1, 1, 0, 1), None: (1, 1, 0, 1)}
    more = [("x", "x/0", "changed"), ("x", "x/2", PAGE.format(4)), ("x", "x/3", " \n"), ("y", None, PAGE.format(5)), ("z", "z/0", "<html></html>")]
    assert run(spark, path, more) == {"x": (2, 1, 1, 1), "y": (1, 0, 1, 0), "z": (1, 0, 1, 0)}
    assert set(stored(spark, path)) == {("x", "x/0"), ("x", "x/1"), ("x", "x/2"), ("y", "y/0"), (None, "n/0")}
    run(spark, path, [("x", "x/1", PAGE.format(6) + "<h2>more</h2><p>" + "text " * 30), ("x", "x/2", None)], "upsert")
    assert stored(spark, path)["x", "x/1"] == 2 and stored(spark, path)["x", "x/2"] == 1
    run(spark, path, [("y", "y/9", PAGE.format(7)), (None, "n/9", PAGE.format(8)), ("x", "x/9", "")], "replace")
    assert set(stored(spark, path)) == {("x", "x/0"), ("x", "x/1"), ("x", "x/2"), ("y", "y/9"), (None, "n/9")}
    with pytest.raises(ValueError):
        run(spark, path, first, "other")


@pytest.mark.parametrize("rows", [[], [("x", "x/0", None), ("x", "x/1", "  ")]])
def test_no_pages_and_blank_pages(spark, tmp_path, rows):
    path = f"file://{tmp_path}/store"
    for mode in ingest.MODES:
        assert run(spark, path, rows, mode) == ({"x": (2, 0, 2, 0)} if rows else {})
    assert Store(spark, path).read().count() == 0


def test_a_failing_encoder_leaves_the_store_alone(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    run(spark, path, [("x", "x/0", PAGE.format(0))])

    def broken():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        run(spark, path, [("x", "x/1", PAGE.format(1))], load=broken)
    assert set(stored(spark, path)) == {("x", "x/0")} and Store(spark, path).versions() == [1]


def test_kinds_are_sniffed_or_told_by_name(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    java = "package a;\n/** Doc. */\npublic class C {\n    public int f(int first, int second) {\n        return first + second;\n    }\n}\n"
    files = [("A.java", java), ("b.XML", "<list><c name='n' class='a.B' other='" + "x" * 40 + "'/></list>"), ("c.md", "# T\n## S\n" + "text " * 20), ("d", "<component><p/></component>" * 3), ("e.txt", "plain " * 20), ("f", "<html><h2>x</h2><p>" + "html " * 20)]
    rows = spark.createDataFrame([("s", n, b) for n, b in files], KIND).withColumn("kind", ingest.file_kind(F.col("url"), F.col("body")))
    ingest.ingest(rows, path, corpus.now(), load_code=lambda: lambda texts: [[9.0]] * len(texts)).collect()
    got = {(r["url"], r["content_type"], r["tbl"], r["vector"] == [9.0]) for r in Store(spark, path).read().collect()}
    assert got == {("A.java", "JAVA", "code", True), ("b.XML", "XML", "code", True), ("c.md", "MARKDOWN", "doc", False), ("d", "XML", "code", True), ("e.txt", "TEXT", "doc", False), ("f", "HTML", "doc", False)}
