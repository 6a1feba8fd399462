"""Query expansion as an option of ranked search."""

from inkwell.operators import keyword, query

CHUNKS = [("doc", 1, "the dog sleeps"), ("doc", 2, "un chien dort"), ("code", 3, "hound and horn"), ("doc", 4, "nothing here"), ("doc", 5, None)]
SYNONYMS = [("dog", ["chien", "hound"]), ("big house", ["mansion"]), ("gap", None)]


def frames(spark, queries, synonyms=SYNONYMS):
    made = spark.createDataFrame(CHUNKS, "tbl string, id bigint, content string")
    return made, spark.createDataFrame(queries, "query_id bigint, query string, note string"), spark.createDataFrame(synonyms, "key string, synonyms array<string>")


def test_widened(spark):
    asked = [(1, "Dog food", "x"), (2, "chien", "x"), (3, " big house ", "x"), (4, "gap", "x"), (5, None, "x"), (6, "", "x"), (None, "dog", "x"), (7, "b dog", "x"), (7, "a", "x")]
    _, queries, synonyms = frames(spark, asked)
    got = {r.query_id: r.query for r in query.widened(queries, synonyms).collect()}
    assert got == {1: "Dog food chien hound", 2: "chien dog hound", 3: " big house  mansion", 4: "gap", 5: None, 6: "", 7: "a"}


def test_ranked_search_with_and_without(spark):
    chunks, queries, synonyms = frames(spark, [(1, "dog", "x"), (2, "horn", "x"), (3, None, "x")])
    found = lambda **options: sorted((r.query_id, r.id) for r in keyword.bm25(chunks, queries, 5, every_term=False, **options).collect())
    assert found() == [(1, 1), (2, 3)]
    assert found(synonyms=synonyms) == [(1, 1), (1, 2), (1, 3), (2, 3)]
    assert found(synonyms=synonyms.limit(0)) == found()
    assert found(synonyms=synonyms, index=keyword.posted(chunks)) == [(1, 1), (1, 2), (1, 3), (2, 3)]
    assert keyword.bm25(chunks, queries.limit(0), 5, synonyms=synonyms).count() == 0
