"""A kept index of chunks for keyword search: tokens and postings that new chunks are merged into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import keyword
from inkwell.sources.shared import tidy
from inkwell.sources.versioned import Store

TOKENS = "token string, tbl string, id bigint"


class KeywordIndex(Store):
    """Versions of an index at a path. Each `add` is a folder of its own and reads only the new chunks' texts; chunks that
    are there already, known by (tbl, id), are taken out first, for which postings are rewritten but no text is read.

    Tokens are sorted by token and blocks by term, so that a search for few words reads few row groups. Chunks without a
    tbl or an id take no part, a null content is a text without words, and an empty index finds nothing.
    """

    KINDS = ("tokens", "blocks", "texts")

    def _folder(self, kind: str, name: str) -> str:
        return f"{self.path}/{kind}/commit={name}"

    def _kept(self, kind: str, schema: str, manifest: dict) -> DataFrame:
        paths = [self._folder(kind, c) for c in manifest["parts"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], T.StructType.fromDDL(schema))

    def tokens(self, version: int | None = None) -> DataFrame:
        return self._kept("tokens", TOKENS, self.manifest(version))

    def postings(self, version: int | None = None) -> keyword.Postings:
        manifest = self.manifest(version)
        texts, filled, terms = manifest.get("counts", (0, 0, 0))
        return keyword.Postings(None, self._kept("blocks", keyword.BLOCKS, manifest), texts, filled, terms)

    def add(self, chunks: DataFrame) -> int:
        """A version with chunks (tbl, id, content) in it."""

        def steps(manifest, name):
            keys = chunks.filter("tbl IS NOT NULL AND id IS NOT NULL").select("tbl", F.col("id").cast("bigint").alias("id")).distinct()
            if manifest["parts"] and self._texts(manifest).join(keys, ["tbl", "id"], "left_semi").take(1):
                self._without(keys, manifest, f"{name}-kept")
            self._put(chunks, manifest, name)

        return self._change(steps)

    def remove(self, keys: DataFrame) -> int:
        """A version without the chunks of these keys (tbl, id)."""
        own = keys.select("tbl", F.col("id").cast("bigint").alias("id")).distinct()
        return self._change(lambda manifest, name: self._without(own, manifest, name))

    def _texts(self, manifest: dict) -> DataFrame:
        return self._kept("texts", "tbl string, id bigint, length int", manifest)

    @tidy
    def _put(self, chunks: DataFrame, manifest: dict, name: str) -> DataFrame:
        made = keyword.posted(chunks)
        self._write(keyword.tokens(chunks), made.rows, made.lengths, made.mean, name)
        return self._counted(manifest, [*manifest["parts"], name])

    @tidy
    def _without(self, keys: DataFrame, manifest: dict, name: str) -> DataFrame:
        stays = lambda df: df.join(keys, ["tbl", "id"], "left_anti")
        rows = self._kept("blocks", keyword.BLOCKS, manifest).select("term", F.explode("held").alias("h")).select("term", "h.*")
        texts = stays(self._texts(manifest))
        self._write(stays(self._kept("tokens", TOKENS, manifest)), stays(rows), texts, self.postings(manifest["version"] - 1).mean, name)
        return self._counted(manifest, [name])

    def _write(self, tokens: DataFrame, rows: DataFrame, texts: DataFrame, mean: float, name: str) -> None:
        sort = lambda df, *by: df.repartitionByRange(*by).sortWithinPartitions(*by)
        sort(tokens.select("token", "tbl", "id"), "token", "tbl", "id").write.parquet(self._folder("tokens", name))
        sort(keyword.blocked(rows, mean).select(*T.StructType.fromDDL(keyword.BLOCKS).names), "term", "shard", "nth").write.parquet(self._folder("blocks", name))
        texts.select("tbl", "id", "length").write.parquet(self._folder("texts", name))

    def _counted(self, manifest: dict, parts: list[str]) -> DataFrame:
        manifest["parts"] = {p: [] for p in parts}
        texts = self._texts(manifest)
        length = F.col("length").cast("bigint")
        manifest["counts"] = [x or 0 for x in texts.agg(F.count("*"), F.count_if(length > 0), F.sum(length)).first()]
        return texts

    @tidy
    def bm25(self, chunks: DataFrame, queries: DataFrame, k: int, every_term: bool = True, version: int | None = None, synonyms: DataFrame | None = None) -> DataFrame:
        """keyword.bm25 of a version; no text is read."""
        return keyword.bm25(chunks, queries, k, every_term, index=self.postings(version), synonyms=synonyms)

    @tidy
    def search(self, chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None, version: int | None = None) -> DataFrame:
        """keyword.search of chunks, those indexed; only texts of candidates are looked into."""
        return keyword.search(chunks, queries, k, where, self.tokens(version))
