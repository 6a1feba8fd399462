import random

import pytest

LONG = "wörd " * 30_000


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, shared passages."""
    rnd = random.Random(3)
    words = "alpha beta gamma delta token ünder the of and to in is for 12 345 x".split()
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = [
        (0, "", "en", "a"), (1, None, "en", "a"), (2, LONG, "de", "b"), (2, LONG, "de", "b"), (None, "lost id " + passage, None, None),
        (3, "one", None, "b"), (4, " \t\n ", "en", None), (5, "la " * 80, "fr", "c"), (6, "mail x.y@host.example.com or 10.0.0.255 call +1 (555) 010-9999 card 4111 1111 1111 1111", "en", "a"),
        (7, "Released under the MIT License. All rights reserved. CC BY 4.0", "en", "a"), (8, "a\u0000b c d 'tis don't \U0001F600", "en", "b"),
    ]
    for i in range(9, 60):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120)))
        if i % 3 == 0:
            text = f"{text} {passage} {text[:rnd.randrange(40)]}"
        rows.append((i, text, "en", rnd.choice("abcde")))
    return rows + [(70, rows[20][1], "en", "e"), (71, rows[20][1], "en", "e"), rows[20]]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """A folder of tables whose documents hold edge_rows and columns with clashing names."""
    path = tmp_path_factory.mktemp("edge")
    docs = spark.createDataFrame(edge_rows(), "doc_id bigint, text string, lang string, source string")
    extra = "*, cast(length(text) AS bigint) n_chars, 'f' fp, 1 size, 2 row, 3 taken, 'x' toxic, cast(null AS string) shard, 7 spans, 1.5 position, 5 key"
    docs.selectExpr(*extra.split(", ")).repartition(3).write.parquet(f"{path}/documents.parquet")
    toxic = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60)] + [(None, 1, 1), (5, None, None), (9, 1, 0)]
    spark.createDataFrame(toxic, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [float((i * k) % 7 - 3) / 4 for k in range(1, 9)], i) for i in range(120)] + [(200, None, 1), (201, [1.0, None] * 4, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] * 8, 1), (50, [0.5] * 8, 1), (None, [1.0] * 8, 1), (300, [], 1)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="session")
def bare(spark, tmp_path_factory):
    """A folder of empty tables."""
    path = tmp_path_factory.mktemp("bare")
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)
