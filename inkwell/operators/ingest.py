"""Pages, articles and source files to a searchable store: the steps of an ingest as one job."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import chunk, embed, parse, store
from inkwell.sources.shared import remove, small_batches, tidy, written
from inkwell.sources.versioned import Store, url_range

#: Columns of the store; tbl is the store that a chunk is routed to, doc or code.
STORED = ("tbl", "source", "url", "section", "chunk_index", "total_chunks", "content", "content_type", "title", "section_title", "fqcn", "version", "language", "created_at", "updated_at", "vector")
MODES = ("append", "replace", "upsert")
#: Parser of each kind of body; a text of another kind is one section.
PARSERS = {"HTML": parse.html_sections, "MARKDOWN": parse.markdown_sections, "JAVA": parse.java_sections, "XML": parse.xml_sections}
#: Kinds by the ending of a file's name; others are sniffed.
ENDINGS = {".java": "JAVA", ".xml": "XML", ".xhtml": "HTML", ".html": "HTML", ".htm": "HTML", ".md": "MARKDOWN", ".properties": "TEXT", ".txt": "TEXT"}

#: Pages and bytes of bodies that a task is meant for, bytes that are worth a task of their own, bytes that weigh as much as
#: a page when they are dealt, and chunks that a task encodes and hands on at once.
TASK_PAGES, TASK_BYTES, LEAST_BYTES, UNIT, PIECE_CHUNKS = 2_000, 8 << 20, 1 << 20, 4096, 2048
#: What a task makes of its pages: chunks, and beside them a report of each page in `content`.
MADE = "beside boolean, tbl string, source string, url string, section int, chunk_index int, total_chunks int, content string, content_type string, title string, section_title string, fqcn string, vector array<double>"
REPORT = "source string, url string, kind string, error string, seen boolean, chunks bigint"


def page_kind(body: Column) -> Column:
    """HTML or MARKDOWN, as an article is sniffed."""
    return F.when(X.looks_like_html(body), "HTML").otherwise("MARKDOWN")


def file_kind(path: Column, body: Column) -> Column:
    """The kind of a file by its name's ending, else of code by its text."""
    out = F.when(X.looks_like_html(body), "HTML").otherwise(F.when(X.code_type(body).isin("POM", "XML"), "XML").when(X.code_type(body) == "PROPERTIES", "TEXT").otherwise("JAVA"))
    for ending, kind in ENDINGS.items():
        out = F.when(F.lower(path).endswith(ending), kind).otherwise(out)
    return out


def _dealt(pages: DataFrame) -> DataFrame:
    """Pages in the store's order, dealt to tasks by number and bytes, with `part`: a long page is followed by empty rows
    of parts above 0, which are no pages but make it weigh its bytes where the order is cut."""
    n, total = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    weight = F.floor(F.coalesce(F.octet_length("body"), F.lit(0)) / UNIT)
    rows = pages.withColumn("n", F.monotonically_increasing_id()).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), weight)))
    order = [F.nullif(F.col("source"), F.lit("")), url_range(F.col("url")), "url", "n"]
    few = min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LEAST_BYTES)
    tasks = max(1, few, -(-n // TASK_PAGES), -(-total // TASK_BYTES))
    return rows.withColumn("body", F.when(F.col("part") == 0, F.col("body"))).repartitionByRange(tasks, *order)


def _made(pages: DataFrame, load: Callable, load_code: Callable | None) -> DataFrame:
    """MADE of pages (source, url, kind, body, part): parsed, cut and encoded in one step, as the rows stand. An encoder is
    loaded once a task and sees equal contents once among PIECE_CHUNKS."""
    fields = [f.split() for f in MADE.split(", ")]
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    loads = {"doc": load, "code": load_code or load}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, Callable] = {}

        def batch(rows: list[dict]) -> pa.RecordBatch:
            for tbl in loads:
                own = [r for r in rows if r.get("tbl") == tbl]
                if own:
                    name = tbl if load_code is not None else "doc"
                    if name not in models:
                        models[name] = loads[name]()
                    for r, vector in zip(own, embed.vectors_of([r["content"] for r in own], models[name])):
                        r["vector"] = vector
            return pa.RecordBatch.from_pylist(rows, schema)

        rows: list[dict] = []
        for pages in batches:
            for page in zip(*(pages.column(name).to_pylist() for name in ("source", "url", "kind", "body", "part"))):
                if page[-1] == 0:
                    for row in _rows(*page[:-1]):
                        rows.append(row)
                        if len(rows) == PIECE_CHUNKS:
                            yield batch(rows)
                            rows = []
        yield batch(rows)

    small_batches(pages.sparkSession)
    return pages.select("source", "url", "kind", "body", "part").mapInArrow(run, MADE)


def _rows(source: str | None, url: str | None, kind: str, body: str | None) -> Iterator[dict]:
    """The chunks of a page, and its report."""
    parser = PARSERS.get(kind, lambda text, url: [(text, {"source_url": url})])
    sections, chunks = parse.parsed(url or "", body, parser), 0
    page = {"source": source, "url": url}
    for _, section, content, meta, error in sections:
        parts = chunk.chunk_text(content, kind if kind in chunk.BUDGETS else "TEXT") if error is None else []
        chunks += len(parts)
        for i, part in enumerate(parts):
            named = {name: meta.get(name) for name in ("title", "section_title", "fqcn")}
            own = {"beside": False, "tbl": "code" if kind in embed.CODE_TYPES else "doc", "section": section, "chunk_index": i, "total_chunks": len(parts), "content": part, "content_type": kind}
            yield page | own | named
    report = page | {"kind": kind, "error": max((s[-1] for s in sections if s[-1]), default=None), "seen": bool(sections), "chunks": chunks}
    yield {"beside": True, "content": json.dumps(report)}


@tidy
def ingest(pages: DataFrame, path: str, now: Column, mode: str = "append", load: Callable = lambda: embed.hashed_trigrams, load_code: Callable | None = None) -> DataFrame:
    """Ingest pages (source, url, body, and perhaps kind) into the versioned store at path, as one new version; gives
    (source, processed, success, errors, chunks) of this run.

    Mode "append" leaves out urls that the store has and adds the rest, "replace" gives each source that made chunks
    these and no others, "upsert" each url that did. kind is HTML, MARKDOWN, JAVA, XML or TEXT; without it, or where it is
    null, a page is sniffed as HTML or Markdown. Every page is parsed, chunked by its kind, embedded (code by load_code,
    by default load) and routed to doc or code.

    A page that is blank or can't be parsed counts as an error of its source and leaves the others alone, and what was
    stored for it stays. Pages with a null url are errors; pages that share source and url are all ingested and count as
    one. No pages, or only blank ones, give a version without new rows; a run that fails leaves the store as it was.
    pages are read three times, to count, to cut the order and to make chunks; what is dear to make is to be written first.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = pages.sparkSession
    kept = Store(spark, path)
    kind = F.coalesce("kind", page_kind(F.col("body"))) if "kind" in pages.columns else page_kind(F.col("body"))
    new = pages.select(F.col("source").cast("string").alias("source"), F.col("url").cast("string").alias("url"), kind.alias("kind"), F.col("body").cast("string").alias("body"))
    if mode == "append" and kept.versions():
        new = new.join(kept.read().select("url").filter("url IS NOT NULL").distinct(), "url", "left_anti")
    new = new.withColumn("body", F.when(F.col("url").isNotNull(), F.col("body")))
    # texts are shuffled once, as pages, and written once, in the store's own layout
    made = store.with_defaults(_made(_dealt(new), load, load_code), now)
    staged = kept.stage(made.select(*STORED, "beside"))
    getattr(kept, mode)(staged)
    summary = written(_summary(staged.beside), "ingest-summary")
    remove(spark, [f"{kept.path}/{staged.name}"])
    return summary


def _summary(reports: DataFrame) -> DataFrame:
    pages = reports.select(F.from_json("content", REPORT).alias("r")).select("r.*")
    # pages that share source, url and kind count as one
    pages = pages.groupBy("source", "url", "kind").agg(F.max("error").alias("error"), F.max("seen").alias("seen"), F.sum("chunks").alias("chunks"))
    error = F.when(~F.col("seen"), F.concat(F.lit("["), F.coalesce("url", F.lit("")), F.lit("] no section"))).otherwise(F.col("error"))
    chunks = pages.groupBy(F.col("source").alias("_s")).agg(F.sum("chunks").alias("chunks"))
    out = store.ingest_summary(pages.select("source", error.alias("error"))).join(chunks, F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select("source", "processed", "success", "errors", F.coalesce("chunks", F.lit(0)).alias("chunks"))
