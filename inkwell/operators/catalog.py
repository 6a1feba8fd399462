"""Catalogue search, recommendation and triage."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.operators import words as V


#: Order of kinds in a search result; others follow by name.
KINDS = ("api", "module", "handler")


def any_token(catalog: DataFrame, queries: DataFrame, fields: list[str], name: str = "name", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(query_id, kind, name, place): catalogue rows that hold any lower-case token of a query in any listed field.

    Fields may be arrays of strings, such as key classes. Queries may have a category, which restricts the rows of kind
    "api" alone. Rows of a kind count once by name; place is their order from 1, by kind and then name. Null fields and
    null or blank queries hold nothing; rows without a kind or name take no part.
    """
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda t: t != ""))
    asked = queries.select("query_id", "category", F.explode(tokens).alias("word"))
    rows = catalog.select("kind", F.col(name).alias("name"), F.col("category").alias("own"), F.concat_ws("\n", *[F.col(f) for f in fields]).alias("body"))
    rows = rows.filter("kind IS NOT NULL AND name IS NOT NULL").withColumn("own", F.coalesce(F.lower("own"), F.lit("")))
    hits = V.held(rows, ["kind", "name", "own"], F.col("body"), asked.select("word")).join(asked, "word")
    right = (F.col("kind") != "api") | F.col("category").isNull() | (F.col("own") == F.lower("category"))
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    by = W.partitionBy("query_id").orderBy(F.when(order > 0, order).otherwise(len(kinds) + 1), "kind", "name")
    return hits.filter(right).select("query_id", "kind", "name").distinct().withColumn("place", F.row_number().over(by))


#: Rows of a name that meet its queries in one block.
NAME_ROWS = 1_000


def _named(catalog: DataFrame, queries: DataFrame, name: str) -> DataFrame:
    """queries with the rows of catalog whose name is the wanted one. Rows of a common name are dealt to blocks, which
    its queries meet one by one, and blocks to as many tasks as the session shuffles to: pairs are far more bytes than
    what is joined, so a plan by bytes would give them to one task."""
    rows, asked = catalog.withColumn("_name", F.lower(name)).filter("_name IS NOT NULL"), queries.withColumn("_name", F.lower("wanted"))
    blocks = rows.groupBy("_name").agg(F.ceil(F.count("*") / NAME_ROWS).cast("int").alias("_blocks"))
    tasks, by = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")), ("_name", "_block")
    left = asked.join(blocks, "_name").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    right = rows.join(blocks, "_name").withColumn("_block", F.pmod(F.xxhash64(*catalog.columns), "_blocks").cast("int")).drop("_blocks")
    return left.repartition(tasks, *by).join(right.repartition(tasks, *by), list(by)).drop(*by)


def by_name(catalog: DataFrame, queries: DataFrame, *names: str) -> DataFrame:
    """Rows of which one of the columns, as a module's name or its artifact, is the asked one, whatever the case; a row
    that two columns match is there once."""
    columns, out = names or ("name",), None
    for i, name in enumerate(columns):
        earlier = [F.lower(F.col(n)).eqNullSafe(F.lower("wanted")) for n in columns[:i]]
        part = _named(catalog, queries, name)
        for hit in earlier:
            part = part.filter(~hit)
        out = part if out is None else out.unionByName(part)
    return out


def by_suffix(catalog: DataFrame, queries: DataFrame, name: str = "fqcn") -> DataFrame:
    """Rows whose class is the asked one, or ends with it after a dot; an equality on the last part serves the join."""
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    exact = (F.col(name) == F.col("wanted")) | F.col(name).endswith(F.concat(F.lit("."), F.col("wanted")))
    return queries.join(catalog, (last(F.col(name)) == last(F.col("wanted"))) & exact)


def grouped(catalog: DataFrame, name: str = "name") -> DataFrame:
    """(category, name): the distinct names of each lower-case category, as rows, so that no category is held in one."""
    return catalog.select(F.lower("category").alias("category"), F.col(name).alias("name")).distinct()


def class_index(modules: DataFrame) -> DataFrame:
    """(class_name, module) of every listed key class."""
    return modules.select(F.explode("key_classes").alias("class_name"), F.col("name").alias("module")).distinct()


# Weights of keyword, category, application type and constraints, the least score, and neutral scores.
WEIGHTS, LEAST = (0.40, 0.25, 0.20, 0.15), 0.20
DEFAULT_RESULTS, MOST_RESULTS = 3, 11


def _share(words: Column, body: Column, none: float) -> Column:
    held = F.size(F.filter(words, lambda w: F.contains(body, F.lower(w))))
    return F.when(F.size(words) > 0, held / F.size(words)).otherwise(F.lit(none))


def categories(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, category, hits, share): hits of each category's keywords in the query, where there are any."""
    sizes = words.groupBy("category").agg(F.count("*").alias("size"))
    found = V.held(texts.filter("query_id IS NOT NULL"), ["query_id"], F.col("query"), words.select(F.col("keyword").alias("word")))
    found = found.join(words.select(F.lower("keyword").alias("word"), "keyword", "category"), "word")
    hits = found.groupBy("query_id", "category").agg(F.count("*").alias("hits"), F.sort_array(F.collect_set("keyword")).alias("keywords"))
    return hits.join(sizes, "category").withColumn("share", F.col("hits") / F.col("size"))


def recommended(queries: DataFrame, patterns: DataFrame, words: DataFrame, n: int = DEFAULT_RESULTS) -> DataFrame:
    """(query_id, rank, name, score): patterns scored by keywords, category, application type and constraints.

    queries: query_id, query, app_type (or null), constraints (array). The category is that with the largest share of
    its keywords in the query, ties by name. Every pattern is scored for every query, in blocks if there are many.
    """
    n = n if 1 <= n <= MOST_RESULTS else DEFAULT_RESULTS
    held = categories(queries, words)
    top = held.groupBy("query_id").agg(F.min(F.struct((-F.col("share")).alias("s"), "category")).alias("b"), F.array_distinct(F.flatten(F.collect_list("keywords"))).alias("keywords"))
    asked = queries.join(top.select("query_id", F.col("b.category").alias("asked"), "keywords"), "query_id", "left")
    rows = V.with_each(asked, patterns)
    body = F.lower(F.concat_ws(" ", "name", "description", "problem", "solution", "category"))
    keyword = _share(F.coalesce("keywords", F.expr("cast(array() AS array<string>)")), body, 0.5)
    category = F.when(F.col("asked").isNull() | F.col("category").isNull(), 0.5).when(F.lower("category") == F.lower("asked"), 1.0).otherwise(0.3)
    free = F.col("app_types").isNull() | (F.size("app_types") == 0)
    fits = F.exists("app_types", lambda t: F.lower(t) == F.lower(F.col("app_type")))
    app = F.when(F.col("app_type").isNull(), 0.8).when(free, 0.5).when(fits, 1.0).otherwise(0.1)
    parts = (keyword, category, app, _share(F.col("constraints"), body, 0.7))
    score = sum(w * p for w, p in zip(WEIGHTS, parts))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "name")
    scored = rows.select("query_id", "name", F.round(score, 6).alias("score")).filter(F.col("score") >= LEAST)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def error_category(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, category): the category with the most keyword hits, ties by name; `general` without any."""
    best = categories(texts, words).groupBy("query_id").agg(F.min(F.struct((-F.col("hits")).alias("h"), "category")).alias("b"))
    return texts.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("b.category", F.lit("general")).alias("category"))


CODE, COMPONENT, HANDLER, FAILURE = r"ERR-\d{3}", r"[a-z]+(?:\.[A-Za-z][A-Za-z0-9]*)+", r"[A-Z][a-zA-Z]+Handler", r"\b\w+(?:Exception|Error)\b"
MOST_TERMS = 5


def error_features(errors: DataFrame, root: str = "") -> DataFrame:
    """errors (query_id, query, code, category) with code, components, handlers and search terms.

    A well-formed given code wins over the first in the text. Components are dotted names below root of more than 8
    characters. Terms: code, failure names, handlers, the category unless general; distinct, the first five.
    """
    given = F.when(F.col("code").rlike(f"^{CODE}$"), F.col("code"))
    code = F.coalesce(given, F.nullif(F.regexp_extract("query", CODE, 0), F.lit("")))
    components = F.filter(F.array_distinct(F.regexp_extract_all("query", F.lit(COMPONENT), F.lit(0))), lambda c: (F.length(c) > 8) & c.startswith(root))
    handlers = F.array_distinct(F.regexp_extract_all("query", F.lit(HANDLER), F.lit(0)))
    failures = F.regexp_extract_all("query", F.lit(FAILURE), F.lit(0))
    terms = F.concat(F.array("code"), failures, "handlers", F.array(F.when(F.col("category") != "general", F.col("category"))))
    out = errors.withColumn("code", code).withColumns({"components": components, "handlers": handlers})
    return out.withColumn("terms", F.slice(F.array_distinct(F.filter(terms, lambda t: t.isNotNull())), 1, MOST_TERMS))


def error_matches(features: DataFrame, catalog: DataFrame, fields: list[str], n: int = 5) -> DataFrame:
    """(query_id, rank, name): catalogue rows that hold a term, then a handler, then the category; the first n."""
    sides = [("terms", 0), ("handlers", 1)]
    asked = [features.select("query_id", F.explode(c).alias("token"), F.lit(p).alias("step")) for c, p in sides]
    asked.append(features.filter("category <> 'general'").select("query_id", F.col("category").alias("token"), F.lit(2).alias("step")))
    every = asked[0].unionByName(asked[1]).unionByName(asked[2]).withColumn("word", F.lower("token"))
    rows = catalog.filter("name IS NOT NULL").select("name", F.concat_ws("\n", *[F.col(f) for f in fields]).alias("body"))
    hits = V.held(rows, ["name"], F.col("body"), every.select("word")).join(every, "word")
    first = hits.groupBy("query_id", "name").agg(F.min("step").alias("step"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("step", "name"))).filter(F.col("rank") <= n).select("query_id", "rank", "name")


CLASS_NAME = r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9_]*)*\.[A-Z][A-Za-z0-9_$]*$"


def violations(entries: DataFrame, prefix: str = "") -> DataFrame:
    """(kind, name, problem) of entries (kind, name, fqcn, ord): bad class names, repeated names, gaps in the order."""
    bad = entries.filter(F.col("fqcn").isNotNull() & (~F.col("fqcn").rlike(CLASS_NAME) | ~F.col("fqcn").startswith(prefix))).select("kind", "name", F.lit("class name").alias("problem"))
    twice = entries.groupBy("kind", "name").agg(F.count("*").alias("n")).filter("n > 1").select("kind", "name", F.lit("repeated name").alias("problem"))
    gap = numbered(entries).filter("place <> ord").select("kind", "name", F.lit("order").alias("problem"))
    return bad.unionByName(twice).unionByName(gap)


#: Numbers of the order that one task ranks.
STRETCH = 10_000


def numbered(entries: DataFrame) -> DataFrame:
    """entries with `place`, their row number by (ord, name) in their kind: counts of stretches of the order first, then
    a rank inside each stretch, so that a large kind is many tasks."""
    rows = entries.withColumn("_s", F.coalesce(F.floor(F.col("ord") / STRETCH), F.lit(-(1 << 62))))
    sizes = rows.groupBy("kind", "_s").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("kind").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("kind").alias("_k"), F.col("_s").alias("_t"), before.alias("_before"))
    own = F.row_number().over(W.partitionBy("kind", "_s").orderBy("ord", "name"))
    placed = rows.withColumn("_own", own).join(sizes, F.col("kind").eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_t")))
    return placed.withColumn("place", F.col("_own") + F.col("_before")).drop("_s", "_own", "_k", "_t", "_before")


FLAT = "catalog string, section string, name string, fqcn string, description string, usage string, source_url string, error string"


def _items(node) -> Iterator[dict]:
    """Named objects in lists and in nested objects, in reading order; lists are not entered further."""
    for value in node.values():
        if isinstance(value, list):
            yield from (v for v in value if isinstance(v, dict) and isinstance(v.get("name"), str))
        elif isinstance(value, dict):
            if isinstance(value.get("name"), str):
                yield value
            yield from _items(value)


def _flat(catalog: str | None, body: str | None) -> list[tuple]:
    text = lambda v: v if isinstance(v, str) else None
    rows = []
    for key, section in (json.loads(body) if body else {}).items():
        if not isinstance(section, dict):
            continue
        if text(section.get("description")):
            rows.append((catalog, key, key, None, section["description"], None, text(section.get("source_url")), None))
        rows += [
            (catalog, key, x["name"], text(x.get("fqcn")), text(x.get("description")), text(x.get("usage")) or text(x.get("example")), text(x.get("source_url")), None)
            for x in _items(section)
        ]
    return rows


def flattened(catalogs: DataFrame) -> DataFrame:
    """FLAT rows of catalogs (catalog, body): described sections, then every named item; usage falls back to example.

    A null or empty body has no rows; one that isn't a JSON object gives one row with an error and nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for catalog, body in zip(batch["catalog"], batch["body"]):
                try:
                    rows += _flat(catalog, body)
                except (ValueError, AttributeError, RecursionError) as error:
                    rows.append((catalog, *[None] * 6, f"[{catalog}] {error}"))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in FLAT.split(", ")])

    return catalogs.select(F.col("catalog").cast("string").alias("catalog"), "body").mapInPandas(run, FLAT)
