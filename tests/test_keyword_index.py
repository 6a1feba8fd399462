"""The kept keyword index against searches without one, and how much of the postings a pruned search joins."""

from collections import Counter

import pytest
from inkwell.operators import keyword
from inkwell.operators.index import KeywordIndex
from inkwell.plans.views import chunks, keyword_queries
from pyspark.sql import functions as F

CHUNKS = "id bigint, tbl string, content string"


def bag(df):
    return Counter((r["query_id"], r["tbl"], r["id"], round(r["score"], 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("every", [True, False])
def test_pruned_search_finds_what_the_plain_one_finds(spark, sf, monkeypatch, every):
    rows, asked = chunks(spark, sf), keyword_queries(spark, sf)
    want = bag(keyword.bm25(rows, asked, 10, every_term=every))
    monkeypatch.setattr(keyword, "PLAIN", -1)
    monkeypatch.setattr(keyword, "BLOCK", 4)
    monkeypatch.setattr(keyword, "SHARD", 50)
    assert bag(keyword.bm25(rows, asked, 10, every_term=every)) == want and len(want) > 2


def test_most_postings_are_not_joined(spark):
    """Queries of a rare word and many common ones: texts with the rare word fill the list, so common words aren't joined."""
    rows = spark.range(6_000).select("id", F.lit("doc").alias("tbl"), F.concat(F.lit("alpha beta delta gamma epsilon zeta "), F.when(F.col("id") % 100 == 0, F.concat(F.lit("rare"), (F.col("id") % 3).cast("string"))).otherwise("")).alias("content"))
    asked = spark.createDataFrame([(i, f"alpha beta delta gamma epsilon zeta rare{i % 3}") for i in range(30)], "query_id int, query string")
    needs = asked.select("query_id", F.explode(keyword.terms(F.col("query"))).alias("term")).distinct()
    index = keyword.posted(rows, needs)
    _, joined, found = keyword.survivors(index, needs, 10, False)
    full = needs.join(index.rows, "term").count()
    assert joined.count() * 20 < full and found.count() * 20 < full


def test_updates_equal_an_index_made_at_once(spark, tmp_path):
    one = [(i, "doc", f"alpha w{i % 5} beta{'x' * (i % 3)}") for i in range(40)] + [(1, "code", "alpha Beta"), (None, "doc", "alpha"), (7, None, "alpha"), (50, "doc", None), (51, "doc", "")]
    two = [(i, "doc", f"gamma w{i % 4} alpha") for i in range(30, 60)] + [(1, "code", "only gamma")]
    asked = spark.createDataFrame([(1, "alpha w1"), (2, "gamma"), (3, "beta zz"), (4, None), (5, "w2 w3 alpha gamma")], "query_id int, query string")
    frame = lambda rows: spark.createDataFrame(rows, CHUNKS).repartition(3)
    kept = KeywordIndex(spark, f"file://{tmp_path}/index")
    kept.add(frame(one))
    first = bag(keyword.bm25(frame(one), asked, 5, every_term=False))
    assert bag(kept.bm25(frame(one), asked, 5, every_term=False)) == first
    kept.add(frame(two))
    gone = {(r[1], r[0]) for r in two}
    now = [r for r in one if (r[1], r[0]) not in gone] + two
    for every in (True, False):
        assert bag(kept.bm25(frame(now), asked, 5, every_term=every)) == bag(keyword.bm25(frame(now), asked, 5, every_term=every))
    assert bag(kept.search(frame(now), asked, 5)) == bag(keyword.search(frame(now), asked, 5))
    kept.remove(spark.createDataFrame([("doc", i) for i in range(45)], "tbl string, id bigint"))
    left = [r for r in now if not (r[1] == "doc" and r[0] is not None and r[0] < 45)]
    assert bag(kept.bm25(frame(left), asked, 5, every_term=False)) == bag(keyword.bm25(frame(left), asked, 5, every_term=False))
    assert bag(kept.bm25(frame(one), asked, 5, every_term=False, version=1)) == first
    assert kept.vacuum() > 0 and bag(kept.search(frame(left), asked, 5)) == bag(keyword.search(frame(left), asked, 5))


def test_a_search_reads_no_text_but_that_of_candidates(spark, tmp_path, monkeypatch):
    """Texts that aren't candidates would fail if they were looked into."""
    rows = spark.createDataFrame([(1, "doc", "alpha beta"), (2, "doc", "gamma"), (3, "doc", "delta")], CHUNKS)
    kept = KeywordIndex(spark, f"file://{tmp_path}/index")
    kept.add(rows)
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    monkeypatch.setattr(keyword, "tokens", None)
    monkeypatch.setattr(keyword, "posted", None)
    assert [r["id"] for r in kept.search(rows, asked, 5).collect()] == [1]
    assert [r["id"] for r in kept.bm25(rows.limit(0), asked, 5).collect()] == [1]
