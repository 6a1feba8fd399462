"""Tables that the registered queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the shape of the two chunk stores."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.alias("id"), F.col("text").alias("content"), "source", F.col("lang").alias("language"),
        F.when(n % 4 == 3, "code").otherwise("doc").alias("tbl"),
        F.when(n % 5 == 0, None).otherwise(F.concat(F.lit("m"), (n % 7).cast("string"))).alias("module"),
        F.when(n % 6 == 0, None).when(n % 2 == 0, "web").otherwise("batch").alias("app_type"),
        F.when(n % 4 == 3, "code").otherwise("documentation").alias("source_type"),
    )


CHUNKS = """chunks AS (
  SELECT doc_id AS id, text AS content, source, lang AS language,
    CASE WHEN doc_id % 4 = 3 THEN 'code' ELSE 'doc' END AS tbl,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'm' || CAST(doc_id % 7 AS VARCHAR) END AS module,
    CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'web' ELSE 'batch' END AS app_type,
    CASE WHEN doc_id % 4 = 3 THEN 'code' ELSE 'documentation' END AS source_type
  FROM documents)"""


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the whole text of each benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).filter("trim(query) <> ''")


KEYWORD_QUERIES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE trim(text) <> '')"


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, vector): the embeddings whose id a hundred divides, as in any search over these tables."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks with their vector, null where none is stored yet."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return chunks(spark, sf_dir).join(vectors, "id", "left")
