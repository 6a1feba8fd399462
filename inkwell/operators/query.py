"""Query analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.operators import words as V


def entities(text: Column, patterns: list[str]) -> Column:
    """Distinct matches, in pattern order and then text order."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))


def expanded(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """queries with `expansions`: synonyms of each token and of the whole query, distinct, in token order.

    A term that is a key brings its synonyms; else the smallest key that lists it, and that key's other synonyms.
    synonyms is (key, synonyms); terms are compared in lower case.
    """
    keyed = synonyms.select(F.lower("key").alias("term"), F.lit(0).alias("how"), F.col("key"), F.col("synonyms").alias("terms"))
    each = synonyms.select("key", "synonyms", F.explode("synonyms").alias("s"))
    others = F.concat(F.array("key"), F.filter("synonyms", lambda x: F.lower(x) != F.lower(F.col("s"))))
    listed = each.select(F.lower("s").alias("term"), F.lit(1).alias("how"), "key", others.alias("terms"))
    one = F.row_number().over(W.partitionBy("term").orderBy("how", "key"))
    lookup = keyed.unionByName(listed).withColumn("n", one).filter("n = 1").select("term", "terms")
    tokens = F.concat(F.split(F.trim("query"), r"\s+"), F.array(F.trim("query")))
    asked = queries.select("query_id", F.posexplode(tokens).alias("pos", "token")).withColumn("term", F.lower("token"))
    hits = asked.join(lookup, "term").select("query_id", "pos", F.posexplode("terms").alias("sub", "word"))
    first = hits.groupBy("query_id", "word").agg(F.min(F.struct("pos", "sub")).alias("at"))
    lists = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("expansions"))
    return queries.join(lists, "query_id", "left").withColumn("expansions", F.coalesce("expansions", F.expr("cast(array() AS array<string>)")))


def widened(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, query): each query followed by its expansions, as a search takes it; one without any stays as it is.

    Of rows that share an id the smallest query counts, rows without an id go, and a null query stays null.
    """
    one = queries.filter("query_id IS NOT NULL").groupBy("query_id").agg(F.min("query").alias("query"))
    text = F.when(F.size("expansions") > 0, F.concat_ws(" ", "query", F.array_join("expansions", " "))).otherwise(F.col("query"))
    return expanded(one, synonyms).select("query_id", text.alias("query"))


def suggested(queries: DataFrame, module_pattern: str, app_words: DataFrame) -> DataFrame:
    """queries with module (first match of the pattern) and app_type: of the keywords in the query, the longest, then by name."""
    module = F.nullif(F.regexp_extract("query", module_pattern, 0), F.lit(""))
    found = V.held(queries.filter("query_id IS NOT NULL"), ["query_id"], F.col("query"), app_words.select(F.col("keyword").alias("word")))
    hits = found.join(app_words.withColumn("word", F.lower("keyword")), "word")
    best = hits.groupBy("query_id").agg(F.min(F.struct((-F.length("keyword")).alias("n"), "keyword", "app_type")).alias("b")).select("query_id", F.col("b.app_type").alias("app_type"))
    return queries.withColumn("module", module).join(best, "query_id", "left")
