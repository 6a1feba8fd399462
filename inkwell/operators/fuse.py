"""Filters, fusion, reranking and facets over ranked lists (query_id, tbl, id, score, rank).

Scores stay as they are computed until a caller rounds them to show; rows of lists with a null key or rank take no part
beyond what a join drops, an absent list is an empty one, and empty lists give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import keyword, vector
from inkwell.operators import words as V
from inkwell.operators.keyword import best
from inkwell.sources.shared import written

RRF_K, CANDIDATES, ALPHA = 60, 50, 0.7
FACETS = ("source", "source_type", "app_type", "module", "language")
MODES = ("KEYWORD", "VECTOR", "HYBRID")


def pre_filter(module=None, app_type=None, source=None, source_type=None, language=None) -> Column:
    """Null-tolerant on module and app_type, equal on the rest; rows of the code store see module and language alone."""
    out = F.lit(True)
    code = F.col("tbl") == "code"
    if module is not None:
        out &= (F.col("module") == module) | F.col("module").isNull()
    if language is not None:
        out &= F.col("language") == language
    if app_type is not None:
        out &= code | (F.col("app_type") == app_type) | F.col("app_type").isNull()
    for name, value in (("source", source), ("source_type", source_type)):
        if value is not None:
            out &= code | (F.col(name) == value)
    return F.coalesce(out, F.lit(False))


def post_filter(version=None, fqcn=None, since=None, until=None, updated="updated_at", **equal) -> Column:
    """Strict: equal values, prefixes of version and fqcn, an inclusive range of times; null or unreadable fails."""
    out = F.lit(True)
    for name, value in equal.items():
        out &= F.col(name) == value
    for name, prefix in (("version", version), ("fqcn", fqcn)):
        if prefix is not None:
            out &= F.col(name).startswith(prefix)
    when = F.try_to_timestamp(F.col(updated).cast("string"))
    if since is not None:
        out &= when >= F.lit(since).cast("timestamp")
    if until is not None:
        out &= when <= F.lit(until).cast("timestamp")
    return F.coalesce(out, F.lit(False))


def facets(rows: DataFrame, columns: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, count): one unpivot and one aggregate; nulls and empty values don't count."""
    long = rows.select(*columns).unpivot([], list(columns), "facet", "value")
    return long.filter("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count("*").alias("count"))


def fetched(found: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Rows of found with these columns of their chunk, by key. The ranked rows are written first: a table that is known to
    be small goes to the chunks, whose texts else would be shuffled and sorted for a few of them."""
    return written(found, "fuse-found").join(chunks.select("tbl", "id", *columns), ["tbl", "id"])


def narrowed(found: DataFrame, chunks: DataFrame, where: Column, k: int | None = None) -> DataFrame:
    """Rows of found whose chunk passes a post-filter, with their metadata FACETS and a new rank, the first k of each query.

    Metadata is fetched by key; a chunk that is stored twice is there twice, one that is gone isn't. `facets` of the
    result counts what is left, over all queries or, with `facets_by_query`, for each.
    """
    wide = fetched(found.drop("rank"), chunks, *[c for c in chunks.columns if c not in ("tbl", "id")]).filter(where).select(*[c for c in found.columns if c != "rank"], *FACETS)
    ranked = wide.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "tbl", "id")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def facets_by_query(rows: DataFrame, columns: tuple[str, ...] = FACETS) -> DataFrame:
    """(query_id, facet, value, count) of narrowed rows; nulls and empty values don't count."""
    long = rows.select("query_id", *columns).unpivot(["query_id"], list(columns), "facet", "value")
    return long.filter("value IS NOT NULL AND value <> ''").groupBy("query_id", "facet", "value").agg(F.count("*").alias("count"))


def reciprocal(*lists: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """Sum of 1 / (constant + rank) over the lists, k rows a query."""
    rows = lists[0].select("query_id", "tbl", "id", "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select("query_id", "tbl", "id", "rank"))
    fused = rows.groupBy("query_id", "tbl", "id").agg(X.steady(F.sum(1.0 / (constant + F.col("rank")))).alias("score"))
    return best(fused, k)


def hybrid(text: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """reciprocal fusion, or the one list with its own scores for queries where the other is empty."""
    tagged = text.withColumn("side", F.lit(0)).unionByName(vectors.withColumn("side", F.lit(1)))
    both = F.size(F.collect_set("side").over(W.partitionBy("query_id"))) == 2
    tagged = tagged.withColumn("value", F.when(both, 1.0 / (RRF_K + F.col("rank"))).otherwise(F.col("score")))
    return best(tagged.groupBy("query_id", "tbl", "id").agg(X.steady(F.sum("value")).alias("score")), k)


def weighted(text: DataFrame, vectors: DataFrame, k: int, alpha: float = ALPHA) -> DataFrame:
    """alpha * vector score + (1 - alpha) * text score, a missing side counting 0."""
    keys = ["query_id", "tbl", "id"]
    rows = vectors.select(*keys, F.col("score").alias("v")).join(text.select(*keys, F.col("score").alias("t")), keys, "full_outer")
    return best(rows.select(*keys, X.steady(alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("t", F.lit(0.0))).alias("score")), k)


def swept(text: DataFrame, vectors: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """Fused lists for every row of a grid (method, rrf_k, alpha, candidates), from one reading of the two lists.

    Method "rrf" is reciprocal with its rrf_k, "weighted" is weighted with its alpha; each uses the first `candidates`
    rows of both lists. Gives the grid's columns with (query_id, tbl, id, score, rank).
    """
    keys, own = ["method", "rrf_k", "alpha", "candidates"], ["query_id", "tbl", "id"]
    rows = text.select(*own, "rank", "score", F.lit(0).alias("side")).unionByName(vectors.select(*own, "rank", "score", F.lit(1).alias("side")))
    rows = V.with_each(rows, grid.select(*keys)).filter(F.col("rank") <= F.col("candidates"))
    share = F.when(F.col("side") == 1, F.col("alpha")).otherwise(1 - F.col("alpha"))
    value = F.when(F.col("method") == "rrf", 1.0 / (F.col("rrf_k") + F.col("rank"))).otherwise(share * F.col("score"))
    fused = rows.groupBy(*keys, *own).agg(X.steady(F.sum(value)).alias("score"))
    return best(fused, k, (*keys, "query_id"))


def search(chunks: DataFrame, queries: DataFrame, k: int, mode: str = "HYBRID", where: Column | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Keyword, vector or hybrid search of chunks (with vector) for queries (query_id, query, vector).

    Where the vectors are a table of their own, `vectors` is the chunks with theirs and only vector search reads it: keyword
    search then goes over the stored texts, instead of joining each with a vector first.
    """
    vectors = chunks if vectors is None else vectors
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "KEYWORD":
        return keyword.search(chunks, queries, k, where)
    if mode == "VECTOR":
        return vector.search(vectors, queries, k, where)
    return hybrid(keyword.search(chunks, queries, CANDIDATES, where), vector.search(vectors, queries, CANDIDATES, where), k)


def rerank(rows: DataFrame, k: int, scorer: Callable[[list[str], list[str]], list[float]] | None = None, least: float | None = None, beta: float = 1.0) -> DataFrame:
    """Rescore (query, content) of candidate rows and keep k a query.

    The default scorer is trigram similarity, a Column; another gets batches of queries and contents, and a batch that
    it fails on or answers with too few scores keeps its old scores. Rows below `least` go; beta blends new and old.
    """
    if scorer is None:
        new = rows.withColumn("new", X.jaccard(X.trigrams(F.col("content")), X.trigrams(F.col("query"))))
    else:

        @F.pandas_udf("double")
        def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, c in batches:
                try:
                    got = list(scorer(q.tolist(), c.tolist()))
                except Exception:
                    got = []
                yield pd.Series(got if len(got) == len(q) else [None] * len(q), dtype=float)

        new = rows.withColumn("new", scores("query", "content"))
    new = new.withColumn("new", F.coalesce("new", "score"))
    new = new.filter(F.col("new") >= least) if least is not None else new
    blended = beta * F.col("new") + (1 - beta) * F.col("score")
    return best(new.withColumn("score", X.steady(blended)).drop("new", "rank"), k)


def semantic_search(chunks: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Hybrid candidates, then content fetched by key, rerank and metadata; k outside 1 to 50 counts as 5."""
    k = k if 1 <= k <= 50 else 5
    found = search(chunks, queries, CANDIDATES, "HYBRID", where, vectors)
    wide = fetched(found.join(queries.select("query_id", "query"), "query_id"), chunks, "content", "source", "module", "language")
    return rerank(wide, k).select("query_id", "rank", "tbl", "id", "score", "source", "module", "language", "content")

