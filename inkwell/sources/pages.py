"""Pages, files and their links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.sources.shared import written

#: Files of a folder, folders that a task lists, files and bytes that a task reads, and bytes of contents handed on at once.
FOLDER_FILES, LIST_FOLDERS, READ_FILES, READ_BYTES, PIECE_BYTES = 1_000, 32, 10_000, 32 << 20, 4 << 20
LISTED = "path string, folder boolean, bytes bigint"


def write_files(rows: DataFrame, path: str) -> int:
    """Each row (name, content) as a file of its own below path, named name.<task>.<number>; gives the number of files.

    Tasks write the files where they are read, in folders of FOLDER_FILES, so no file passes the driver. A task that
    runs again on the same rows writes the same names. Rows that share a name are files of their own, a null content is
    an empty file, and no rows give an empty folder.
    """
    fs.FileSystem.from_uri(path)[0].create_dir(fs.FileSystem.from_uri(path)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{root}/{task:06d}-{n // FOLDER_FILES:06d}"
                if n % FOLDER_FILES == 0:
                    system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{name}.{task}.{n}", buffer_size=0) as out:
                    out.write((content or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.select(F.col("name").cast("string"), F.col("content").cast("string")).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of every file below path but those whose name, or a folder's, begins with a dot or an underscore.
    Folders are listed in tasks, a level of them at a time."""
    _, root = fs.FileSystem.from_uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [f for f in system.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith((".", "_"))]
                cols = [f.path for f in found], [f.type == fs.FileType.Directory for f in found], [f.size or 0 for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.bool_(), pa.int64()))], names=["path", "folder", "bytes"])

    todo, files = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = written(todo.mapInArrow(run, LISTED), "files-listed")
        part, folders = level.filter("NOT folder").select("path", "bytes"), level.filter("folder").select("path")
        files = part if files is None else files.unionByName(part)
        n = folders.count()
        if n == 0:
            return files
        todo = folders.repartition(-(-n // LIST_FOLDERS))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below path, as `listed`; an empty file has an empty content, and bytes that aren't
    UTF-8 are replaced. A task reads READ_FILES files or READ_BYTES bytes, about."""
    files = listed(spark, path)
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    prefix = path[: len(path) - len(fs.FileSystem.from_uri(path)[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(path)
        made = lambda names, texts: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])
        for batch in batches:
            names, texts, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(name, buffer_size=0) as file:
                    raw = file.read()
                names.append(prefix + name)
                texts.append(raw.decode(errors="replace"))
                held += len(raw)
                if held >= PIECE_BYTES:
                    yield made(names, texts)
                    names, texts, held = [], [], 0
            yield made(names, texts)

    return files.select("path").repartition(max(1, -(-n // READ_FILES), -(-total // READ_BYTES)), "path").mapInArrow(run, "path string, content string")


def checked(rows: DataFrame, body: str, key: str) -> DataFrame:
    """rows with error "[key] blank content" where the body is blank, null elsewhere."""
    blank = F.col(body).isNull() | (F.trim(F.regexp_replace(F.col(body), r"\s+", " ")) == "")
    return rows.withColumn("error", F.when(blank, F.concat(F.lit("["), F.col(key).cast("string"), F.lit("] blank content"))))


def resolved(base: Column, link: Column) -> Column:
    """link as an absolute url: itself if it is one, else after base up to its last slash, a leading ./ dropped."""
    root = F.when(base.endswith("/"), base).otherwise(F.regexp_extract(base, r"^(.*/)", 1))
    return F.when(link.rlike("^https?://"), link).otherwise(F.concat(root, F.regexp_replace(link, r"^\./", "")))


def links(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, url, pos): the pattern's first group in every page, resolved; the first occurrence of each url."""
    each = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("pos", "link"))
    return each.groupBy("page_id", resolved(F.col("base"), F.col("link")).alias("url")).agg(F.min("pos").alias("pos"))


def crawl_order(urls: DataFrame, priority: list[str]) -> DataFrame:
    """urls (page_id, url, pos) with `priority` and `place`, the place from 0 in which a page's links are crawled: those
    with a priority word first, each class in its given order (pos, url). Words count whatever their case."""
    low = F.lower("url")
    first = F.exists(F.array(*[F.lit(p.lower()) for p in priority]), lambda p: F.contains(low, p))
    marked = urls.withColumn("priority", first if priority else F.lit(False))
    order = W.partitionBy("page_id").orderBy(F.desc("priority"), "pos", "url")
    return marked.withColumn("place", F.row_number().over(order) - 1)
