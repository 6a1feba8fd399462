"""Core operators on nulls, repeats, empty tables, ties and odd rows, and plans that must hold at any size."""

import pytest
from inkwell.operators import catalog, chunk, embed, evaluate, fuse, keyword, scan, store, vector
from inkwell.operators import words as V
from inkwell.plans import registry
from inkwell.plans.views import chunk_vectors, chunks, keyword_queries, vector_queries
from pyspark.sql import functions as F

CHUNKS = "id bigint, tbl string, content string"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_keyword_search_on_awkward_rows(spark):
    got = spark.createDataFrame([(1, "doc", "Foo-Bar baz ß"), (1, "doc", "Foo-Bar baz ß"), (2, "code", "FOO\tbar"), (3, None, "foo"), (None, "doc", "foo"), (4, "doc", None), (5, "doc", " "), (6, "doc", "x" * 5000 + "foo")], CHUNKS)
    asked = spark.createDataFrame([(1, "foo"), (2, "o-b az"), (3, None), (4, "<b> !"), (5, "zz foo"), (1, "zzz"), (None, "foo"), (6, "ß")], "query_id int, query string")
    assert rows(keyword.matches(got, asked), "query_id", "tbl", "id") == [(1, "code", 2), (1, "doc", 1), (1, "doc", 1), (1, "doc", 6), (2, "doc", 1), (2, "doc", 1), (6, "doc", 1), (6, "doc", 1)]
    assert keyword.search(got.limit(0), asked, 5).count() == keyword.search(got, asked.limit(0), 5).count() == 0
    assert keyword.bm25(got, asked, 5, every_term=False).filter("query_id = 1").count() >= 2 and keyword.bm25(got.limit(0), asked, 5).count() == 0
    with pytest.raises(ValueError):
        keyword.search(got, asked, 0)


def test_results_are_not_cut_at_fifty(spark):
    many = spark.range(80).select("id", F.lit("doc").alias("tbl"), F.concat(F.lit("token x"), "id").alias("content"))
    asked = spark.createDataFrame([(1, "token")], "query_id int, query string")
    assert keyword.bm25(many, asked, 70).count() == keyword.search(many, asked, 70).count() == 70


def test_no_nested_loop_with_many_queries(spark, sf, capsys):
    for name in ("k4_keyword_top_k", "g1_catalog_search", "g7_error_matches"):
        registry.QUERIES[name](spark, sf).explain("formatted")
        plan = capsys.readouterr().out
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_words_with_blanks_and_short_words(spark):
    texts = spark.createDataFrame([(1, "all Rights  reserved"), (2, "all rights reserved"), (3, "b"), (4, None)], "id int, t string")
    asked = spark.createDataFrame([("rights reserved",), ("b",), ("ed",), (" ",), (None,)], "word string")
    want = [(1, "ed"), (2, "ed"), (2, "rights reserved"), (3, "b")]
    assert rows(V.holding(texts, ["id"], F.col("t"), asked), "id", "word") == rows(V.held(texts, ["id"], F.col("t"), asked), "id", "word") == want


VECTORS = "tbl string, id bigint, vector array<double>"


def test_vector_search_on_awkward_rows(spark, monkeypatch):
    data = [("doc", 1, [1.0, 0.0]), ("doc", 1, [1.0, 0.0]), (None, 2, [1.0, 0.0]), ("doc", None, [1.0, 0.0]), ("code", 3, [0.0, 0.0]), ("doc", 4, [1.0, 0.0, 0.0]), ("doc", 5, None), ("doc", 6, []), ("doc", 7, [float("nan"), 1.0]), ("code", 8, [1.0, 1.0])]
    stored = spark.createDataFrame(data, VECTORS)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0, 3.0]), (3, None), (None, [1.0, 0.0])], "query_id bigint, vector array<double>")
    want = [(1, "code", 3, 0.0), (1, "code", 8, 0.707107), (1, "doc", 1, 1.0), (2, "doc", 4, 0.0)]
    assert rows(vector.search(stored, asked, 5).withColumn("score", F.round("score", 6)), "query_id", "tbl", "id", "score") == want
    assert vector.approximate(stored.limit(0), asked, 3).count() == vector.search(stored, asked.limit(0), 3).count() == 0
    monkeypatch.setattr(vector, "QUERY_BLOCK", 1)
    monkeypatch.setattr(vector, "CELL_ROWS", 2)
    monkeypatch.setattr(vector, "CELL_QUERIES", 1)
    assert rows(vector.search(stored, asked, 5).withColumn("score", F.round("score", 6)), "query_id", "tbl", "id", "score") == want


def test_recall_of_the_registered_list_search(spark):
    sf = "/root/testdata/sf0.1"
    exact = vector.search(chunk_vectors(spark, sf), vector_queries(spark, sf), 10)
    assert vector.recall(registry.QUERIES["v4_probed_lists"](spark, sf), exact).first()[0] >= 0.9


def test_chunks_keep_ids_and_take_unknown_types(spark):
    big = 9007199254740993
    docs = spark.createDataFrame([(big, "a" * 60, None), (None, "b" * 60, "ODD"), (3, None, "TEXT"), (4, "", "XML")], "id bigint, content string, content_type string")
    assert rows(chunk.chunked(docs), "id", "content_type", "chunk_index") == sorted([(big, None, 0), (None, "ODD", 0)], key=repr)
    assert chunk.chunked(docs.limit(0)).count() == 0


def test_changes_of_urls_with_several_rows(spark):
    before = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", None), (None, "q"), ("e", "1"), ("e", "1")], "url string, content string")
    after = spark.createDataFrame([("a", "z"), ("b", "x"), ("c", None), ("d", "n"), ("e", "1")], "url string, content string")
    status = store.changes(before, after)
    assert rows(status, "url", "status") == [("a", "updated"), ("b", "unchanged"), ("c", "unchanged"), ("d", "new"), ("e", "updated")]
    assert rows(store.apply_changes(before, after, status), "url", "content") == rows(after, "url", "content")
    assert store.changes(before.limit(0), after.limit(0)).count() == 0


def test_bad_catalogues_are_rows_with_an_error(spark):
    docs = spark.createDataFrame([("a", "{bad"), ("b", None), ("c", "[1]"), ("d", '{"s": {"description": "x", "l": [{"name": "n", "example": "e"}, 3]}, "t": 4}')], "catalog string, body string")
    got = catalog.flattened(docs).collect()
    assert sorted(r["catalog"] for r in got if r["error"]) == ["a", "c"]
    assert [(r["name"], r["usage"]) for r in got if r["catalog"] == "d"] == [("s", None), ("n", "e")]


def test_orders_are_numbered_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(catalog, "STRETCH", 3)
    data = [("k", f"n{i:02}", i + (i > 7)) for i in range(1, 15)] + [("j", "a", None), ("j", "b", 2)]
    got = catalog.numbered(spark.createDataFrame(data, "kind string, name string, ord int"))
    assert rows(got.filter("kind = 'k'"), "name", "place") == [(f"n{i:02}", i) for i in range(1, 15)]
    assert rows(got.filter("kind = 'j'"), "name", "place") == [("a", 1), ("b", 2)]


def test_repair_inserts_what_is_wanted(spark):
    queues = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("q", 2, None), ("r", 0, "x")], "queue string, pos int, name string")
    got = scan.repair(queues, {"b": ["a"]}, {}, [("n", "a"), ("x", None)])
    assert rows(got, "queue", "pos", "name") == [("q", 0, "b"), ("q", 1, "a"), ("q", 2, "n"), ("q", 3, "x"), ("r", 0, "x"), ("r", 1, "n")]


def test_empty_tables_of_rules_and_metrics(spark):
    queues = spark.createDataFrame([], "queue string, pos int, name string")
    rules = spark.createDataFrame([("a", ["b"], [])], "name string, must_before array<string>, must_after array<string>")
    assert scan.order_violations(queues, rules).count() == scan.repair(queues, {}, {}).count() == 0
    ranked = spark.createDataFrame([], "query_id int, rank int, rel boolean")
    assert evaluate.per_query(ranked).count() == 0
    assert evaluate.coverage(ranked.select("query_id"), ranked).first()["coverage"] == 0.0
    assert embed.embedded(spark.createDataFrame([], "id int, content string")).count() == 0
    assert fuse.facets(spark.createDataFrame([], "source string, source_type string, app_type string, module string, language string")).count() == 0
    assert chunks(spark, "/root/testdata/sf0.001").limit(0).count() == keyword_queries(spark, "/root/testdata/sf0.001").limit(0).count() == 0
