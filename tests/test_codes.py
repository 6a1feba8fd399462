"""Search on codes against the exact search."""

import random

from inkwell.operators import codes, vector
from inkwell.plans import registry
from inkwell.plans.views import chunk_vectors, vector_queries

ROW, ASKED = "tbl string, id bigint, vector array<double>", "query_id bigint, vector array<double>"


def found(df):
    return sorted((r["query_id"], r["tbl"], r["id"], round(r["score"], 6), r["rank"]) for r in df.collect())


def test_recall_with_few_vectors_read(spark):
    """At least nine in ten of the exact rows, and under a tenth of the pairs scored in full."""
    sf = "/root/testdata/sf0.1"
    rows, asked = chunk_vectors(spark, sf), vector_queries(spark, sf)
    assert vector.recall(registry.QUERIES["v4_codes"](spark, sf), vector.search(rows, asked, 10)).first()[0] >= 0.9
    of = codes.books(rows)
    kept = codes.encode(rows, of).persist()
    n = kept.count()
    read = codes.short_list(kept, asked, of, codes.SHORT * 10).count()
    assert 0 < read < 0.1 * n * asked.count()
    exact = {(r["query_id"], r["tbl"], r["id"]): round(r["score"], 6) for r in vector.search(rows, asked, n).collect()}
    again = found(codes.search(rows, asked, 10, of=of, codes=kept))
    assert again == found(codes.search(rows, asked, 10)) and all(exact[r[:3]] == r[3] for r in again)
    kept.unpersist()


def test_short_list_of_all_rows_is_exact(spark):
    """Odd vectors, several lengths, ties, repeated rows, and more queries than go to every task."""
    rnd = random.Random(3)
    draw = lambda n: [rnd.gauss(0, 1) for _ in range(n)]
    rows = [(rnd.choice(["doc", "code"]), i, draw(rnd.choice([5, 8, 9]))) for i in range(150)]
    rows += [("doc", 900, [0.0] * 8), ("doc", 901, None), ("doc", 902, []), ("doc", 903, [None] * 8), ("doc", 904, [float("nan")] * 8), (None, 1, draw(8)), ("doc", None, draw(8)), rows[0], ("code", 905, rows[0][2])]
    asked = [(i, draw(rnd.choice([5, 8, 9, 4]))) for i in range(30)] + [(None, draw(8)), (77, None), (78, [0.0] * 8)]
    stored, queries = spark.createDataFrame(rows, ROW), spark.createDataFrame(asked, ASKED)
    want = found(vector.search(stored, queries, 6))
    assert found(codes.search(stored, queries, 6, short=400)) == want
    some = {n: c for n, c in codes.books(stored).items() if n != 8}
    assert set(some) == {5, 9} and found(codes.search(stored, queries, 6, short=400, of=some)) == want


def test_blocks_of_queries(spark, monkeypatch):
    rnd = random.Random(4)
    rows = spark.createDataFrame([("doc", i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(120)], ROW)
    asked = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(25)], ASKED)
    want = found(codes.search(rows, asked, 5))
    for name, n in (("QUERY_BLOCK", 4), ("CELL_QUERIES", 7), ("CELL_ROWS", 30)):
        monkeypatch.setattr(vector, name, n)
    assert found(codes.search(rows, asked, 5)) == want


def test_empty_tables(spark):
    rows, asked = spark.createDataFrame([("doc", 1, [1.0, 2.0])], ROW), spark.createDataFrame([(1, [1.0, 2.0])], ASKED)
    assert codes.search(rows.limit(0), asked, 3).count() == codes.search(rows, asked.limit(0), 3).count() == 0
    assert found(codes.search(rows, asked, 3)) == [(1, "doc", 1, 1.0, 1)]
