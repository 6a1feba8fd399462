"""Keyword retrieval for whole tables of queries.

Chunks are (tbl, id, content, ...); rows without a tbl or an id take no part, a null content holds nothing, and a chunk
that is stored twice is found twice. Queries are (query_id, query); of rows that share an id the smallest query counts,
and a null or blank query finds nothing. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import query as analysis
from inkwell.operators import words as V
from inkwell.sources.shared import written


#: Longest words of a query among which the rarest is looked for.
LONGEST = 3


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, query, words): the distinct lower-case keywords of each query that has any."""
    low = F.array_distinct(F.transform(X.keywords(F.col("query")), lambda w: F.lower(w)))
    rows = queries.filter("query_id IS NOT NULL").groupBy("query_id").agg(F.min("query").alias("query"))
    return rows.withColumn("words", low).filter(F.size("words") > 0)


def tokens(chunks: DataFrame) -> DataFrame:
    """(token, tbl, id): the distinct white-space tokens of each chunk in lower case; a chunk that is stored twice may have
    them twice. Texts are gone through by themselves: nothing is shuffled, and no task holds a table of its texts' tokens."""
    own = F.array_distinct(V.tokens(F.col("content")))
    return chunks.filter("tbl IS NOT NULL AND id IS NOT NULL").select(F.explode(own).alias("token"), "tbl", F.col("id").cast("bigint").alias("id")).filter("token <> ''")


def candidates(placed: DataFrame, queries: DataFrame) -> DataFrame:
    """A written table (query_id, tbl, id): chunks that hold the rarest of a query's longest words, if these occur at all.

    placed is what `tokens` gives, queries what `asked` gives. The rarest word is known from the vocabulary, before any chunk is looked at; every
    match holds it, so none is lost. The few tokens that are looked for are written first: a table that is known to be small
    goes to the tokens of the texts, which are far more than the texts and else would be shuffled.
    """
    long = F.slice(F.sort_array(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), False), 1, LONGEST)
    each = queries.select("query_id", F.size(long).alias("needed"), F.explode(long).alias("s")).select("query_id", "needed", F.col("s.w").alias("word"))
    found = written(V.holders(placed.groupBy("token").agg(F.count("*").alias("n")), each.select("word").distinct()), "keyword-found")
    weight = found.groupBy("word").agg(F.sum("n").alias("n"))
    rarest = each.join(weight, "word").groupBy("query_id", "needed").agg(F.count("*").alias("held"), F.min_by("word", F.struct("n", "word")).alias("word"))
    keys = written(rarest.filter("held = needed").join(found, "word").select("query_id", "token"), "keyword-keys")
    return written(placed.join(keys, "token").select("query_id", "tbl", "id").distinct(), "keyword-near")


def _verified(chunks: DataFrame, queries: DataFrame, *made: Column, placed: DataFrame | None = None) -> DataFrame:
    """candidates that hold all words of their query, with the columns made of content, once a chunk, and of the query."""
    every = asked(queries)
    near = candidates(placed if placed is not None else written(tokens(chunks), "keyword-tokens"), every)
    body = chunks.join(near.select("tbl", "id").distinct(), ["tbl", "id"], "left_semi").select("tbl", "id", F.lower("content").alias("low"), *made)
    pairs = near.join(body, ["tbl", "id"]).join(every, "query_id")
    return pairs.filter(F.forall("words", lambda w: F.contains("low", w)))


def matches(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, tbl, id) of every query and chunk that holds all words of the query, whatever the case."""
    return _verified(chunks, queries).select("query_id", "tbl", "id")


def scored(chunks: DataFrame, queries: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """matches with score, the trigram similarity of content and query; trigrams are cut once a chunk and once a query."""
    grams = asked(queries).select("query_id", X.trigrams(F.col("query")).alias("b"))
    found = _verified(chunks, queries, X.trigrams(F.col("content")).alias("a"), placed=placed).select("query_id", "tbl", "id", "a")
    return found.join(grams, "query_id").select("query_id", "tbl", "id", X.jaccard(F.col("a"), F.col("b")).alias("score"))


def best(rows: DataFrame, k: int, per: tuple[str, ...] = ("query_id",), score: str = "score") -> DataFrame:
    """The k rows of each group with the highest score, ties by (tbl, id), with their rank from 1."""
    order = W.partitionBy(*per).orderBy(F.desc(score), "tbl", "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None, placed: DataFrame | None = None) -> DataFrame:
    """(query_id, tbl, id, score, rank): k rows of each store, merged to k rows a query. placed, the tokens of a kept index
    of the chunks, spares cutting their texts: then only texts of candidates are looked into."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = scored(chunks if where is None else chunks.filter(where), queries, placed)
    return best(best(rows, k, ("query_id", "tbl")).drop("rank"), k)


STOP = ("the", "of", "and", "to", "a", "in", "is", "for")


def terms(content: Column) -> Column:
    """Parts between non-letters and camel-case edges, lower-cased, without stop words."""
    parts = F.split(F.regexp_replace(content, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"[^\p{L}\p{N}]+")
    return F.filter(F.transform(parts, lambda t: F.lower(t)), lambda t: (t != "") & ~t.isin(*STOP))


#: Postings of a block, postings of a shard of a term, rarest terms of a query that are probed for its kth score, and the
#: texts scored for it, as a multiple of k.
BLOCK, SHARD, PROBED, LIKELY = 128, 100_000, 8, 10
#: Share of the floor that the terms which aren't joined may reach together: less joins more postings and leaves fewer texts.
JOINED = 0.65
#: Slack of comparisons with a bound, far above the noise of sums and far below any difference of scores.
SLACK = 1e-9
K1, B = 1.2, 0.75
BLOCKS = "term string, shard int, nth int, most int, least int, held array<struct<tbl:string,id:bigint,tf:int,length:int>>"


def _share(tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    """BM25 part of a posting without its term's idf: it grows with tf and falls with length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean)))


#: Pairs of query term and posting up to which all are joined, rather than bounds worked out first.
PLAIN = 50_000_000


@dataclass
class Postings:
    """An inverted index: postings (term, tbl, id, tf, length), or BLOCKS of them ordered by impact, with the greatest tf and
    least length of each, which bound its scores whatever the corpus grows to; and the numbers of texts, of texts with a
    term, and of terms."""

    rows: DataFrame | None
    blocks: DataFrame | None
    texts: int
    filled: int
    terms: int
    lengths: DataFrame | None = None

    @property
    def mean(self) -> float:
        return self.terms / self.filled if self.filled else 1.0


def posted(chunks: DataFrame, only: DataFrame | None = None) -> Postings:
    """The postings of chunks, of all terms or of those in `only` (term). Texts are cut once; a term with many postings
    is cut in shards by its texts, so that none is ordered by one task."""
    cut = chunks.filter("tbl IS NOT NULL AND id IS NOT NULL").select("tbl", F.col("id").cast("bigint").alias("id"), F.coalesce(terms(F.col("content")), F.array()).alias("t"))
    # the empty term stands for the text itself and carries its length
    each = cut.select("tbl", "id", F.size("t").alias("length"), F.explode(F.concat("t", F.array(F.lit("")))).alias("term"))
    if only is not None:
        each = each.join(only.select("term").unionByName(only.sparkSession.createDataFrame([("",)], "term string")).distinct(), "term", "left_semi")
    rows = written(each.groupBy("term", "tbl", "id").agg(F.count("*").cast("int").alias("tf"), F.max("length").alias("length")), "keyword-postings")
    whole = rows.filter("term = ''")
    texts, filled, total = whole.agg(F.count("*"), F.count_if(F.col("length") > 0), F.sum(F.col("length").cast("bigint"))).first()
    return Postings(rows.filter("term <> ''"), None, texts, filled, total or 0, whole.select("tbl", "id", "length"))


def blocked(rows: DataFrame, mean: float) -> DataFrame:
    """BLOCKS of postings (term, tbl, id, tf, length)."""
    shards = rows.groupBy("term").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    placed = rows.join(shards, "term").withColumn("shard", F.pmod(F.xxhash64("tbl", "id"), F.col("shards")).cast("int"))
    order = W.partitionBy("term", "shard").orderBy(F.desc(_share(F.col("tf"), F.col("length"), mean, K1, B)), "tbl", "id")
    placed = placed.withColumn("nth", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
    made = placed.groupBy("term", "shard", "nth").agg(F.max("tf").alias("most"), F.min("length").alias("least"), F.collect_list(F.struct("tbl", "id", "tf", "length")).alias("held"))
    return written(made, "keyword-blocks")


def kth(rows: DataFrame, k: int, score: str) -> DataFrame:
    """(query_id, floor): the kth highest score of each query that has as many rows."""
    order = W.partitionBy("query_id").orderBy(F.desc(score))
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).groupBy("query_id").agg(F.max("_n").alias("n"), F.min(score).alias("floor")).filter(F.col("n") == k).select("query_id", "floor")


def survivors(index: Postings, needs: DataFrame, k: int, every_term: bool, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(asked, joined, found): the terms with their idf, the postings (query_id, tbl, id, part) that were joined, and the (query_id, tbl, id) that may be
    among the best k of a query, of needs (query_id, term), distinct.

    The best blocks of a query's rarest terms give LIKELY times k texts, whose kth best score is a floor. Terms whose greatest parts together stay below it can't bring a text in alone and aren't joined; of the others, a
    block is skipped if its bound and the greatest parts of all other terms stay below. The floor then rises to the kth
    best sum over what was joined, and a text stays only if its sum and the greatest parts of the other terms reach it.
    With every_term, the texts of a query's rarest term are what it can find.
    """
    share = lambda tf, length: _share(tf, length, index.mean, k1, b)
    index.blocks = index.blocks if index.blocks is not None else blocked(index.rows, index.mean)
    heads = index.blocks.groupBy("term").agg(F.sum(F.size("held")).alias("df"), F.max(share(F.col("most"), F.col("least"))).alias("bound"))
    idf = F.log(1 + (F.lit(index.texts) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = written(needs.join(heads, "term", "left").withColumn("idf", idf).withColumn("top", F.coalesce(F.col("idf") * F.col("bound"), F.lit(0.0))), "keyword-asked")
    part = (F.col("idf") * share(F.col("h.tf"), F.col("h.length"))).alias("part")
    if every_term:
        rarest = asked.groupBy("query_id").agg(F.min(F.struct("df", "term", "idf")).alias("r"), F.count_if(F.col("df").isNull()).alias("unknown")).filter("unknown = 0")
        joined = rarest.select("query_id", "r.term", "r.idf").join(index.blocks, "term").select("query_id", "idf", F.explode("held").alias("h"))
        joined = joined.select("query_id", "h.tbl", "h.id", part)
        return asked, joined, written(joined.select("query_id", "tbl", "id").distinct(), "keyword-survivors")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("idf"), "term"))
    few = asked.filter("df IS NOT NULL").withColumn("n", rank).filter(F.col("n") <= PROBED)
    probed = few.join(index.blocks.filter("shard = 0 AND nth = 0"), "term").select("query_id", "idf", F.explode("held").alias("h")).select("query_id", "h.tbl", "h.id", part)
    likely = best(probed.groupBy("query_id", "tbl", "id").agg(F.sum("part").alias("part")), LIKELY * k, score="part")
    floors = kth(completed(index, written(likely.select("query_id", "tbl", "id"), "keyword-likely"), asked.select("query_id", "term", "idf"), k1, b), k, "s")
    own = W.partitionBy("query_id")
    below = F.sum("top").over(own.orderBy("top", "term").rowsBetween(W.unboundedPreceding, 0))
    planned = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    planned = planned.withColumn("all", F.sum("top").over(own)).withColumn("joined", (below >= JOINED * F.col("floor")) & F.col("df").isNotNull())
    planned = written(planned, "keyword-planned")
    bound = F.col("idf") * share(F.col("most"), F.col("least"))
    reach = bound + F.col("all") - F.col("top") >= F.col("floor")
    joined = planned.filter("joined").join(index.blocks, "term").filter(reach).select("query_id", "idf", F.explode("held").alias("h")).select("query_id", "h.tbl", "h.id", part)
    sums = written(joined.groupBy("query_id", "tbl", "id").agg(F.sum("part").alias("part")), "keyword-sums")
    rest = planned.groupBy("query_id").agg(F.sum(F.when(~F.col("joined"), F.col("top")).otherwise(0.0)).alias("rest"), F.max("floor").alias("low"))
    near = sums.join(rest, "query_id").join(kth(sums, k, "part"), "query_id", "left")
    found = near.filter(F.col("part") + F.col("rest") >= F.greatest("low", F.col("floor") - SLACK)).select("query_id", "tbl", "id")
    return asked.select("query_id", "term", "idf"), joined, written(found, "keyword-survivors")


def completed(index: Postings, found: DataFrame, asked: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, tbl, id, s, held): the score of each text of found (query_id, tbl, id) for its query's terms, asked
    (query_id, term, idf), and how many of them it holds; one without any has no row."""
    near = written(found.select("tbl", "id").distinct(), "keyword-texts")
    heads = index.blocks.join(asked.select("term").distinct(), "term", "left_semi")
    held = heads.select("term", F.explode("held").alias("h")).select("term", "h.*").join(near, ["tbl", "id"], "left_semi")
    parts = found.join(held, ["tbl", "id"]).join(asked, ["query_id", "term"])
    value = F.col("idf") * _share(F.col("tf"), F.col("length"), index.mean, k1, b)
    return parts.groupBy("query_id", "tbl", "id").agg(F.sum(value).alias("s"), F.count("*").alias("held"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int, every_term: bool = True, k1: float = K1, b: float = B, index: Postings | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """BM25, normalised to s / (s + 1): the best k chunks of each query; with every_term a chunk must hold all its terms.

    Up to PLAIN pairs, which are counted, all postings of asked terms are joined; beyond, and with a kept index, only
    `survivors` are scored, from the index, so texts are read once when it is made. index is a kept index of the
    chunks; without one, an index of the asked terms is made. A chunk that is stored twice is one text of all its terms,
    as long as either copy. synonyms (key, synonyms) widens the queries first; with every_term these must be held too.
    """
    queries = queries if synonyms is None else analysis.widened(queries, synonyms)
    needs = written(queries.filter("query_id IS NOT NULL").select("query_id", F.explode(terms(F.col("query"))).alias("term")).distinct(), "keyword-needs")
    index = index or posted(chunks, needs)
    plain = 0
    if index.rows is not None:
        df = index.rows.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.lit(index.texts) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = written(needs.join(df, "term").withColumn("idf", idf), "keyword-asked")
        plain = asked.agg(F.sum("df")).first()[0] or 0
    if index.rows is not None and plain <= PLAIN:
        value = F.col("idf") * _share(F.col("tf"), F.col("length"), index.mean, k1, b)
        sums = index.rows.join(asked, "term").groupBy("query_id", "tbl", "id").agg(F.sum(value).alias("s"), F.count("*").alias("held"))
    else:
        asked, _, found = survivors(index, needs, k, every_term, k1, b)
        sums = completed(index, found, asked, k1, b)
    if every_term:
        sums = sums.join(needs.groupBy("query_id").agg(F.count("*").alias("needed")), "query_id").filter("held = needed")
    return best(sums.select("query_id", "tbl", "id", X.steady(F.col("s") / (F.col("s") + 1)).alias("score")), k)
