"""Steps whose memory, time or exactness once gave way on larger tables."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from inkwell.operators import catalog, embed, fuse, ingest, keyword, vector, words
from inkwell.plans import corpus, registry, retrieval
from inkwell.sources import pages, shared
from inkwell.sources.versioned import Store


def test_files_are_few_folders_and_come_back(spark, tmp_path):
    """A folder for each file once made writing and listing take far longer than the texts."""
    texts = ["a\nb\r\n", "", "über\u0001", "x" * 9_000_000, "same", "same"]
    rows = [(f"d{i % 2_500}", texts[i] if i < len(texts) else f"text {i}") for i in range(5_000)]
    path = f"file://{tmp_path}/files"
    assert pages.write_files(spark.createDataFrame(rows, "name string, content string").repartition(2), path) == len(rows)
    assert len(list((tmp_path / "files").iterdir())) <= 2 + len(rows) // pages.FOLDER_FILES
    (tmp_path / "files" / "_hidden").write_text("no")
    got = sorted((r.path.rsplit("/", 1)[1].split(".")[0], r.content) for r in pages.read_files(spark, path).collect())
    assert got == sorted(rows)


def test_no_files(spark, tmp_path):
    path = f"file://{tmp_path}/files"
    assert pages.write_files(spark.createDataFrame([], "name string, content string"), path) == 0
    assert pages.read_files(spark, path).count() == 0


def test_small_negative_components_keep_their_sign(spark, tmp_path):
    """Larger tables hold components that round to zero from below; as text -0.0 isn't 0.0."""
    rows = [(1, [-1e-7, 1.0, 1e-7]), (2, [-0.5, 0.0, -2e-9]), (3, [3.0, -4.0, 0.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    signed = lambda rows: sorted((i, [(x, math.copysign(1, x)) for x in v]) for i, v in rows)
    got = registry.QUERIES["e3_l2_normalise"](spark, str(tmp_path)).select("vec_id", "vector").collect()
    assert signed(got) == signed(con.sql(registry.SQL["e3_l2_normalise"]).fetchall())


def test_trigram_counts_are_those_of_single_hashes(monkeypatch):
    def plain(texts, dims):
        out = [[0.0] * dims for _ in texts]
        for row, text in zip(out, texts):
            for i in range(len(text) - 2):
                row[zlib.crc32(text[i : i + 3].encode()) % dims] += 1
        return out

    rng = random.Random(1)
    texts = ["", "a", "ab", "abc", "日本語テキスト"] + ["".join(rng.choice("ab é日\U0001f600\n\0") for _ in range(rng.randrange(200))) for _ in range(60)]
    for piece in (7, embed.PIECE):
        monkeypatch.setattr(embed, "PIECE", piece)
        assert embed.hashed_trigrams(texts, 7) == plain(texts, 7) and embed.hashed_trigrams(texts) == plain(texts, 64)
    assert embed.hashed_trigrams([]) == []


def test_texts_are_encoded_by_many_tasks(spark):
    """Few compressed bytes once made one encoding task, however long the texts were."""
    rows = spark.createDataFrame([(i, f"class Part{i}") for i in range(2_000)], "id int, content string").coalesce(1)
    where = lambda: lambda texts: [[float(TaskContext.get().partitionId())] for _ in texts]
    assert embed.embedded(rows, where).select("vector").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_scores_of_a_cell_are_held_in_blocks(monkeypatch):
    """A cell's scores at once once took several arrays of its rows by its queries."""
    rng = np.random.default_rng(2)
    rows, asked = rng.normal(size=(300, 5)).round(1), rng.normal(size=(70, 5)).round(1)
    lists, ids = pa.array(rows.tolist(), pa.list_(pa.float64())), rng.permutation(300)
    units = vector._units(pa.array(asked.tolist(), pa.list_(pa.float64())))

    def found():
        kept, most = vector._Kept(np.arange(70) + 1_000, units, 4), 0
        for part in (slice(0, 200), slice(200, 300)):
            kept.add(["doc", "code"] * (len(rows[part]) // 2), ids[part], lists[part])
            most = max([most, *(score.size for *_, score in kept.scored(lists[part]))])
        return sorted(map(tuple, kept.table().to_pandas().values.tolist())), most

    whole, _ = found()
    monkeypatch.setattr(vector, "STEP_ROWS", 16)
    monkeypatch.setattr(vector, "STEP_QUERIES", 9)
    cut, most = found()
    assert cut == whole and len(cut) == 70 * 2 * 4 and most == 16 * 9


def test_a_common_name_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(catalog, "NAME_ROWS", 10)
    rows = spark.createDataFrame([(i, "Bolt" if i % 3 else "Nut") for i in range(600)] + [(601, None)], "key int, name string").coalesce(1)
    asked = spark.createDataFrame([(1, "BOLT"), (2, "bolt"), (3, "x"), (4, None)], "query int, wanted string")
    out = catalog.by_name(rows, asked).withColumn("task", F.spark_partition_id())
    assert sorted((r.query, r.key) for r in out.collect()) == sorted((q, i) for q in (1, 2) for i in range(600) if i % 3)
    assert out.select("task").distinct().count() > 1


def test_tokens_of_texts_are_not_shuffled(spark):
    """A table of all tokens of a task's texts once took its memory, and its shuffle the time of an index."""
    chunks = spark.createDataFrame([("doc", 1, "Ab ab  c"), ("doc", 1, "c"), ("code", 2, None), (None, 3, "x"), ("doc", 4, " ")], "tbl string, id int, content string")
    out = keyword.tokens(chunks)
    assert sorted(map(tuple, out.collect())) == [("ab", "doc", 1), ("c", "doc", 1), ("c", "doc", 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


#: A query of each step that searches share: two lists (h5, h6 too), narrowed, reranked (h9 too), modes (r9_paired_test too), swept.
STEPS = ["h4_reciprocal_rank_fusion", "h3_search_facets", "h8_rerank", "r8_mode_comparison", "r9_parameter_sweep"]


@pytest.fixture
def exchanged(spark, sf, tmp_path, monkeypatch):
    """The columns of each shuffle in a query's plans, by name, where only tables of a few kilobytes count as small."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("benchmark", "embeddings"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    table.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string"))).write.parquet(f"{tmp_path}/documents.parquet")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(100_000))

    def of(frame):
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = frame._jdf.queryExecution().explainString(mode)
        inputs = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", plan, re.M)
        return [{c.split("#")[0] for c in columns.split(", ")} for columns in inputs]

    def run(name):
        found, put = [], shared.written

        def noted(df, label):
            found.extend(of(df))
            return put(df, label)

        for module in (keyword, fuse, words, retrieval):
            if hasattr(module, "written"):
                monkeypatch.setattr(module, "written", noted)
        last = of(registry.QUERIES[name](spark, str(tmp_path)))
        return found + last

    yield run
    spark.conf.set(limit, before)


@pytest.mark.parametrize("name", STEPS)
def test_texts_and_their_tokens_are_not_shuffled(exchanged, name):
    """Every text was once joined with its vector before its words were cut, and again for each list of a few rows; all
    tokens were shuffled to meet the few that are looked for. A task's share of that grew with the tables."""
    shuffles = exchanged(name)
    assert shuffles and not [s for s in shuffles if s & {"content", "text", "low", "a"} or {"token", "tbl"} <= s]


def test_an_ingest_shuffles_texts_once_and_writes_them_once(spark, sf, tmp_path, monkeypatch):
    """Pages, sections, chunks and vectors were once written each, and texts shuffled three times or more, so that an ingest took
    13 times its input of disk."""
    texts, shuffled, kept = {"body", "content", "section_title"}, [], []
    put = DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = self._df._jdf.queryExecution().explainString(mode)
        inputs = [{c.split("#")[0] for c in x.split(", ")} for x in re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", plan, re.M)]
        shuffled.extend(x for x in inputs if x & texts)
        kept.extend([self._df.columns] if texts & set(self._df.columns) else [])
        return put(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    monkeypatch.setattr(ingest, "TASK_BYTES", 64 << 10, raising=False)
    path = f"file://{tmp_path}/store"
    summary = ingest.ingest(corpus._pages(spark, sf), path, corpus.now()).collect()
    assert len(shuffled) == 1 and len(kept) == 1
    rows = Store(spark, path)._rows(Store(spark, path).manifest())
    files = rows.groupBy("source", F.input_file_name().alias("file")).agg(F.min("range").alias("low"), F.max("range").alias("high")).orderBy("source", "low", "high").collect()
    assert len(files) > 5 and all(a["source"] != b["source"] or a["high"] <= b["low"] for a, b in zip(files, files[1:]))
    assert sum(r["chunks"] for r in summary) == rows.count()
    assert [f.name for f in (tmp_path / "store" / "data").iterdir() if f.name.startswith("staged")] == []


def test_long_pages_are_dealt_by_their_bytes(spark, monkeypatch):
    """Tasks have stretches of sources, and sources pages of other lengths."""
    monkeypatch.setattr(ingest, "TASK_BYTES", 50_000)
    monkeypatch.setattr(ingest, "UNIT", 100)
    rows = [("long", f"u{i}", "MARKDOWN", "x" * 10_000) for i in range(40)] + [("short", f"v{i}", "MARKDOWN", "x" * 10) for i in range(2_000)] + [("short", "same", "HTML", None)] * 300
    dealt = ingest._dealt(spark.createDataFrame(rows, "source string, url string, kind string, body string")).withColumn("task", F.spark_partition_id())
    own = dealt.filter("part = 0").select("source", "url", "kind", "body", "task").collect()
    assert sorted(tuple(r)[:4] for r in own if r["body"]) == sorted(r for r in rows if r[3]) and len(own) == len(rows)
    loads = {}
    for r in own:
        loads[r["task"]] = loads.get(r["task"], 0) + len(r["body"] or "")
    assert max(loads.values()) < 150_000


def test_equal_contents_of_a_piece_are_encoded_once():
    seen = []

    def model(texts):
        seen.extend(texts)
        return [[float(len(t))] for t in texts]

    assert embed.vectors_of(["a", "bb", "a", "", "bb"], model, 2) == [[1.0], [2.0], [1.0], [0.0], [2.0]] and seen == ["a", "bb", ""]
    assert embed.vectors_of([], model) == []
