"""Registered queries of keyword, vector and fused retrieval and of its evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import codes, embed, evaluate, fuse, keyword, vector
from inkwell.operators.index import KeywordIndex
from inkwell.plans.corpus import SYNONYMS
from inkwell.plans.views import CHUNKS, KEYWORD_QUERIES, chunk_vectors, chunks, keyword_queries, table, vector_queries
from inkwell.sources.shared import fresh_path, written

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


WORDS = r"""list_filter(list_transform(regexp_split_to_array(trim(query), '\s+'),
    lambda t: trim(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '[&|!():''"\\]', '', 'g'))), lambda t: t <> '')"""
TRIGRAMS = r"""list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""
SIMILARITY = "CASE WHEN len(list_concat(a, b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END"
DISTANCE = "round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])), 12)"

MATCHED = f"""WITH {CHUNKS}, {KEYWORD_QUERIES}, words AS (SELECT query_id, query, list_distinct(list_transform({WORDS}, lambda w: lower(w))) AS words FROM queries),
low AS (SELECT *, lower(content) AS lc FROM chunks),
found AS (
  SELECT q.query_id, q.query, c.* FROM low c JOIN words q
  ON len(q.words) > 0 AND len(list_filter(q.words, lambda w: NOT contains(c.lc, w))) = 0)"""
KEYWORD = f"""{MATCHED}, sims AS (
  SELECT query_id, tbl, id, {TRIGRAMS.format('content')} AS a, {TRIGRAMS.format('query')} AS b FROM found),
scored AS (SELECT query_id, tbl, id, {SIMILARITY} AS score FROM sims),
kper AS (SELECT *, row_number() OVER (PARTITION BY query_id, tbl ORDER BY score DESC, id) AS n FROM scored),
ktext AS (SELECT query_id, tbl, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tbl, id) AS rank FROM kper WHERE n <= 50)"""
VECTORS = f"""vqueries AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0),
cvectors AS (SELECT c.*, e.embedding AS vector FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.id),
vscored AS (SELECT q.query_id, c.tbl, c.id, {DISTANCE} AS score FROM vqueries q JOIN cvectors c ON c.vector IS NOT NULL),
vper AS (SELECT *, row_number() OVER (PARTITION BY query_id, tbl ORDER BY score DESC, id) AS n FROM vscored),
vtext AS (SELECT query_id, tbl, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tbl, id) AS rank FROM vper WHERE n <= 50)"""


def shown(rows):
    """rows with their score as it is shown."""
    return rows.withColumn("score", F.round("score", 6))


def top(source, k, extra=""):
    return f"SELECT query_id, tbl, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM {source} WHERE rank <= {k} {extra}"


@query("k1_keywords", f"WITH q AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user') SELECT conv_id, turn, {WORDS} AS words FROM q")
def k1(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", X.keywords(F.col("text")).alias("words"))


@query("k2_all_keywords", f"{MATCHED} SELECT query_id, tbl, id FROM found")
def k2(spark, d):
    return keyword.matches(chunks(spark, d), keyword_queries(spark, d))


@query("k3_trigram_similarity", f"{KEYWORD} SELECT query_id, tbl, id, round(score, 6) AS score FROM scored")
def k3(spark, d):
    return shown(keyword.scored(chunks(spark, d), keyword_queries(spark, d)))


@query("k4_keyword_top_k", f"{KEYWORD} {top('ktext', 10)}")
def k4(spark, d):
    return shown(keyword.search(chunks(spark, d), keyword_queries(spark, d), 50).filter("rank <= 10"))


TOKENS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda t: lower(t)), lambda t: t <> '' AND t NOT IN ('the','of','and','to','a','in','is','for'))"
BM25 = f"""WITH {CHUNKS}, {KEYWORD_QUERIES},
toks AS (SELECT id, tbl, {TOKENS.format('content')} AS t FROM chunks),
lens AS (SELECT id, tbl, len(t) AS length FROM toks WHERE len(t) > 0),
stats AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT avg(length) FROM lens) AS mean),
tf AS (SELECT id, tbl, term, count(*) AS tf FROM (SELECT id, tbl, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS term FROM queries)),
needed AS (SELECT query_id, count(*) AS needed FROM asked GROUP BY query_id),
part AS (SELECT a.query_id, tf.tbl, tf.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS p
  FROM asked a JOIN tf USING (term) JOIN df USING (term) JOIN lens ON lens.id = tf.id AND lens.tbl = tf.tbl, stats),
sums AS (SELECT query_id, tbl, id, sum(p) AS s, count(*) AS held FROM part GROUP BY ALL)"""


@query("k5_full_text", f"{BM25}, r AS (SELECT s.query_id, tbl, id, round(s / (s + 1), 12) AS score FROM sums s JOIN needed n ON s.query_id = n.query_id AND held = needed), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tbl, id) AS rank FROM r) {top('b', 50)}")
def k5(spark, d):
    return shown(keyword.bm25(chunks(spark, d), keyword_queries(spark, d), 50))


@query("k6_bm25", f"{BM25}, r AS (SELECT query_id, tbl, id, round(s / (s + 1), 12) AS score FROM sums), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tbl, id) AS rank FROM r) {top('b', 10)}")
def k6(spark, d):
    return shown(keyword.bm25(chunks(spark, d), keyword_queries(spark, d), 10, every_term=False))


PAIRS = ", ".join(f"('{key}', {terms})" for key, terms in SYNONYMS)
WIDENED = rf"""syn AS (SELECT * FROM (VALUES {PAIRS}) t(key, synonyms)),
lookup AS (SELECT key AS term, synonyms AS terms FROM syn
  UNION ALL SELECT s, list_concat([key], list_filter(synonyms, lambda x: x <> s)) FROM (SELECT key, synonyms, unnest(synonyms) AS s FROM syn)),
given AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE trim(text) <> ''),
parts AS (SELECT query_id, lower(unnest(regexp_split_to_array(trim(query), '\s+'))) AS term FROM given),
more AS (SELECT query_id, string_agg(word, ' ') AS words FROM (SELECT query_id, unnest(terms) AS word FROM parts JOIN lookup USING (term)) GROUP BY query_id),
queries AS (SELECT query_id, concat_ws(' ', query, words) AS query FROM given LEFT JOIN more USING (query_id))"""


@query("k6_expanded", f"""{BM25.replace(KEYWORD_QUERIES, WIDENED)}, r AS (SELECT query_id, tbl, id, round(s / (s + 1), 12) AS score FROM sums),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tbl, id) AS rank FROM r) {top('b', 10)}""")
def k6_expanded(spark, d):
    synonyms = spark.createDataFrame(SYNONYMS, "key string, synonyms array<string>")
    return shown(keyword.bm25(chunks(spark, d), keyword_queries(spark, d), 10, every_term=False, synonyms=synonyms))


def _index(spark, d):
    """A kept index of chunks, whose third part was added in a second version."""
    kept, rows = KeywordIndex(spark, fresh_path(spark, "index")), chunks(spark, d)
    kept.add(rows.filter("id % 3 <> 0"))
    kept.add(rows.filter("id % 3 = 0"))
    return kept, rows


@query("k4_kept_index", f"{KEYWORD} {top('ktext', 10)}")
def k4_kept(spark, d):
    kept, rows = _index(spark, d)
    return shown(kept.search(rows, keyword_queries(spark, d), 50).filter("rank <= 10"))


@query("k6_kept_index", f"{BM25}, r AS (SELECT query_id, tbl, id, round(s / (s + 1), 12) AS score FROM sums), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tbl, id) AS rank FROM r) {top('b', 10)}")
def k6_kept(spark, d):
    kept, rows = _index(spark, d)
    return shown(kept.bm25(rows, keyword_queries(spark, d), 10, every_term=False))


@query("v1_cosine_top_k", f"WITH {CHUNKS}, {VECTORS} {top('vtext', 10)}")
def v1(spark, d):
    return shown(vector.search(chunk_vectors(spark, d), vector_queries(spark, d), 50).filter("rank <= 10"))


@query("v2_filtered_cosine", f"WITH {CHUNKS}, {VECTORS.replace('c.vector IS NOT NULL', 'c.vector IS NOT NULL AND c.app_type = ' + chr(39) + 'web' + chr(39))} {top('vtext', 10)}")
def v2(spark, d):
    return shown(vector.search(chunk_vectors(spark, d), vector_queries(spark, d), 50, F.col("app_type") == "web").filter("rank <= 10"))


@query("v3_two_stores", f"""WITH {CHUNKS}, {VECTORS.replace("q JOIN cvectors c ON", "q JOIN cvectors c ON ((c.tbl = 'doc') = (q.query_id % 200 = 0)) AND")} {top('vtext', 10)}""")
def v3(spark, d):
    rows, asked = chunk_vectors(spark, d), vector_queries(spark, d)
    doc = vector.search(rows.filter("tbl = 'doc'"), asked.filter("query_id % 200 = 0"), 10)
    return shown(doc.unionByName(vector.search(rows.filter("tbl = 'code'"), asked.filter("query_id % 200 <> 0"), 10)))


@query("v4_probed_lists")
def v4(spark, d):
    return shown(vector.approximate(chunk_vectors(spark, d), vector_queries(spark, d), 10))


@query("v4_codes")
def v4_codes(spark, d):
    return shown(codes.search(chunk_vectors(spark, d), vector_queries(spark, d), 10))


@query("e2_mean_pool", """WITH t AS (SELECT label, unnest(range(1, 65)) AS dim, embedding, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS mask FROM embeddings),
m AS (SELECT label, dim, round(sum(CAST(embedding[dim] AS DOUBLE) * mask) / greatest(sum(mask), 1), 6) AS x FROM t GROUP BY ALL) SELECT CAST(label AS BIGINT) AS id, list(x ORDER BY dim) AS vector FROM m GROUP BY label""")
def e2(spark, d):
    tokens = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("mask"))
    return vector.mean_pool(tokens).withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


@query("e3_l2_normalise", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) AS vector FROM v")
def e3(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(X.l2_normalise(F.col("embedding")), lambda x: X.rounded(x, 6)).alias("vector"))


@query("e1_embed")
def e1(spark, d):
    return embed.embedded(chunks(spark, d).select("id", "content"))


KIND = "CASE id % 6 WHEN 0 THEN 'HTML' WHEN 1 THEN 'MARKDOWN' WHEN 2 THEN 'TEXT' WHEN 3 THEN 'JAVA' WHEN 4 THEN 'JAVADOC' ELSE 'XML' END"


@query("e4_route", f"WITH {CHUNKS}, k AS (SELECT {KIND} AS content_type FROM chunks) SELECT content_type, CASE WHEN content_type IN ('JAVA', 'JAVADOC', 'XML') THEN 'code' ELSE 'doc' END AS tbl, count(*) AS n FROM k GROUP BY ALL")
def e4(spark, d):
    rows = chunks(spark, d).select(F.expr(KIND).alias("content_type"))
    return embed.routed(rows)["doc"].unionByName(embed.routed(rows)["code"]).groupBy("content_type", "tbl").agg(F.count("*").alias("n"))


@query("h1_pre_filter", f"WITH {CHUNKS} SELECT tbl, id FROM chunks WHERE (module = 'm3' OR module IS NULL) AND language = 'en' AND (tbl = 'code' OR ((app_type = 'web' OR app_type IS NULL) AND source_type = 'documentation'))")
def h1(spark, d):
    return chunks(spark, d).filter(fuse.pre_filter(module="m3", app_type="web", source_type="documentation", language="en")).select("tbl", "id")


@query("h2_post_filter", "SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND starts_with(CAST(user_id AS VARCHAR), '4')")
def h2(spark, d):
    rows = table(spark, d, "events").withColumn("version", F.col("user_id").cast("string"))
    return rows.filter(fuse.post_filter(event_type="click", version="4", since="2024-01-02 00:00:00", until="2024-01-20 12:00:00", updated="ts")).select("event_id")


@query("h3_facets", f"WITH {CHUNKS}, u AS (SELECT unnest(['source','source_type','app_type','module','language']) AS facet, unnest([source, source_type, app_type, module, language]) AS value FROM chunks) SELECT facet, value, count(*) AS count FROM u WHERE value IS NOT NULL AND value <> '' GROUP BY ALL")
def h3(spark, d):
    return fuse.facets(chunks(spark, d))


def _both(spark, d):
    """chunks, the same with their vectors, and the queries with theirs."""
    asked = keyword_queries(spark, d).join(vector_queries(spark, d).withColumn("query_id", F.col("query_id") / 100), "query_id", "left").withColumn("query_id", F.col("query_id").cast("bigint"))
    return chunks(spark, d), chunk_vectors(spark, d), asked


def _lists(spark, d):
    rows, near, asked = _both(spark, d)
    return keyword.search(rows, asked, 50), vector.search(near, asked, 50)


LISTS = f"{KEYWORD}, {VECTORS.replace('vec_id AS query_id', 'CAST(vec_id / 100 AS BIGINT) AS query_id')}, vlist AS (SELECT * FROM vtext WHERE query_id IN (SELECT query_id FROM queries)), tlist AS (SELECT * FROM ktext WHERE rank <= 50), wlist AS (SELECT * FROM vlist WHERE rank <= 50)"
RRF = f"{LISTS}, u AS (SELECT query_id, tbl, id, rank, score, 0 AS side FROM tlist UNION ALL SELECT query_id, tbl, id, rank, score, 1 FROM wlist)"
RANKED = "b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tbl, id) AS rank FROM f)"


@query("h4_reciprocal_rank_fusion", f"{RRF}, f AS (SELECT query_id, tbl, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM u GROUP BY ALL), {RANKED} {top('b', 10)}")
def h4(spark, d):
    return shown(fuse.reciprocal(*_lists(spark, d), k=10))


HYBRID = f"""{RRF}, two AS (SELECT query_id, count(DISTINCT side) = 2 AS two FROM u GROUP BY query_id),
f AS (SELECT query_id, tbl, id, round(sum(CASE WHEN two THEN 1.0::DOUBLE / (60 + rank) ELSE score END), 12) AS score FROM u JOIN two USING (query_id) GROUP BY ALL), {RANKED}"""


@query("h5_hybrid_fallback", f"{HYBRID} {top('b', 10)}")
def h5(spark, d):
    return shown(fuse.hybrid(*_lists(spark, d), 10))


@query("h6_weighted_fusion", f"{LISTS}, f AS (SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.tbl, v.tbl) AS tbl, coalesce(t.id, v.id) AS id, round(0.7 * coalesce(v.score, 0) + (1 - 0.7::DOUBLE) * coalesce(t.score, 0), 12) AS score FROM tlist t FULL JOIN wlist v ON t.query_id = v.query_id AND t.tbl = v.tbl AND t.id = v.id), {RANKED} {top('b', 10)}")
def h6(spark, d):
    return shown(fuse.weighted(*_lists(spark, d), 10))


@query("h7_search_modes", f"{HYBRID}, m AS (SELECT 'KEYWORD' AS mode, query_id, tbl, id, score, rank FROM tlist UNION ALL SELECT 'VECTOR', query_id, tbl, id, score, rank FROM wlist UNION ALL SELECT 'HYBRID', query_id, tbl, id, score, rank FROM b) SELECT mode, query_id, tbl, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM m WHERE rank <= 5")
def h7(spark, d):
    rows, near, asked = _both(spark, d)
    out = None
    for mode in fuse.MODES:
        part = fuse.search(rows, asked, 50, mode, vectors=near).filter("rank <= 5").withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return shown(out)


NARROWED = f"""{HYBRID}, n AS (SELECT b.query_id, b.tbl, b.id, b.score, c.source, c.source_type, c.app_type, c.module, c.language, row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.tbl, b.id) AS rank
  FROM b JOIN chunks c ON c.tbl = b.tbl AND c.id = b.id WHERE b.rank <= 50 AND c.language = 'en' AND c.app_type = 'web')"""


def _narrowed(spark, d):
    rows, near, asked = _both(spark, d)
    return fuse.narrowed(fuse.search(rows, asked, 50, vectors=near), rows, fuse.post_filter(language="en", app_type="web"))


@query("h2_narrowed_search", f"{NARROWED} {top('n', 10)}")
def h2_narrowed(spark, d):
    return shown(_narrowed(spark, d).filter("rank <= 10").select("query_id", "tbl", "id", "score", "rank"))


@query("h3_search_facets", f"{NARROWED}, fc AS (SELECT query_id, unnest(['source', 'source_type', 'app_type', 'module', 'language']) AS facet, unnest([source, source_type, app_type, module, language]) AS value FROM n) SELECT query_id, facet, value, count(*) AS count FROM fc WHERE value IS NOT NULL AND value <> '' GROUP BY ALL")
def h3_search(spark, d):
    return fuse.facets_by_query(_narrowed(spark, d))


RERANK = f"""{HYBRID}, cand AS (SELECT b.query_id, b.tbl, b.id, b.score AS old, c.content, q.query FROM b JOIN chunks c ON c.tbl = b.tbl AND c.id = b.id JOIN queries q ON q.query_id = b.query_id WHERE rank <= 50),
rs AS (SELECT query_id, tbl, id, old, {TRIGRAMS.format('content')} AS a, {TRIGRAMS.format('query')} AS b FROM cand)"""


def _candidates(spark, d):
    rows, near, asked = _both(spark, d)
    found = fuse.search(rows, asked, 50, vectors=near)
    return fuse.fetched(found.join(asked.select("query_id", "query"), "query_id"), rows, "content")


@query("h8_rerank", f"{RERANK}, r AS (SELECT query_id, tbl, id, {SIMILARITY} AS score FROM rs), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tbl, id) AS rank FROM r) {top('rr', 5)}")
def h8(spark, d):
    return shown(fuse.rerank(_candidates(spark, d), 5).select("query_id", "tbl", "id", "score", "rank"))


@query("h9_rerank_blend", f"{RERANK}, n AS (SELECT query_id, tbl, id, old, {SIMILARITY} AS new FROM rs), r AS (SELECT query_id, tbl, id, round(0.6 * new + (1 - 0.6::DOUBLE) * old, 12) AS score FROM n WHERE new >= 0.005), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tbl, id) AS rank FROM r) {top('rr', 5)}")
def h9(spark, d):
    return shown(fuse.rerank(_candidates(spark, d), 5, least=0.005, beta=0.6).select("query_id", "tbl", "id", "score", "rank"))


@query("h10_semantic_search", f"{RERANK}, r AS (SELECT query_id, tbl, id, {SIMILARITY} AS score FROM rs), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tbl, id) AS rank FROM r) SELECT rr.query_id, CAST(rank AS INTEGER) AS rank, rr.tbl, rr.id, round(rr.score, 6) AS score, source, module, language, content FROM rr JOIN chunks c ON c.tbl = rr.tbl AND c.id = rr.id WHERE rank <= 5")
def h10(spark, d):
    rows, near, asked = _both(spark, d)
    return shown(fuse.semantic_search(rows, asked, 5, vectors=near))


RELEVANT = """rk AS (SELECT r.*, s.language, CASE WHEN r.query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, contains(lower(s.content), 'token') OR contains(lower(s.content), 'license') AS rel FROM {0} r JOIN chunks s ON s.tbl = r.tbl AND s.id = r.id WHERE r.rank <= 10)"""
MRR = "coalesce(max(CASE WHEN rel THEN 1.0::DOUBLE / rank END), 0)"


def ndcg(k):
    return f"""CASE WHEN count(*) FILTER (rank <= {k} AND rel) = 0 THEN 0 ELSE sum(CASE WHEN rank <= {k} AND rel THEN 1 / log2(rank + 1) ELSE 0 END)
    / list_sum(list_transform(range(1, CAST(count(*) FILTER (rank <= {k} AND rel) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END"""


def metrics(cut="{0}"):
    return f"""{cut.format(MRR)} AS mrr, max(CASE WHEN rank <= 5 AND rel THEN 1.0::DOUBLE ELSE 0 END) AS recall_5, count(*) FILTER (rank <= 5 AND rel) AS relevant_5,
  max(CASE WHEN rank <= 10 AND rel THEN 1.0::DOUBLE ELSE 0 END) AS recall_10, count(*) FILTER (rank <= 10 AND rel) AS relevant_10, {cut.format(ndcg(5))} AS ndcg_5, {cut.format(ndcg(10))} AS ndcg_10"""


def _judged(spark, d):
    ranked = keyword.search(chunks(spark, d), keyword_queries(spark, d), 50).filter("rank <= 10")
    return _labelled(ranked, chunks(spark, d))


def _labelled(ranked, rows):
    words = F.array(F.lit("token"), F.lit("LICENSE"))
    named = fuse.fetched(ranked, rows, "content", "language")
    return named.withColumn("rel", evaluate.relevant(F.col("content"), words)).withColumn("category", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))


@query("r1_relevance", f"{KEYWORD}, {RELEVANT.format('ktext')} SELECT query_id, tbl, id, CAST(rank AS INTEGER) AS rank, rel FROM rk")
def r1(spark, d):
    return _judged(spark, d).select("query_id", "tbl", "id", "rank", "rel")


@query("r2_to_r5_metrics", f"{KEYWORD}, {RELEVANT.format('ktext')} SELECT query_id, {metrics("round({0}, 6)")} FROM rk GROUP BY query_id")
def r2(spark, d):
    return evaluate.per_query(_judged(spark, d), digits=6)


@query("r7_summary", f"""{KEYWORD}, {RELEVANT.format('ktext')}, m AS (SELECT query_id, category, language, {metrics()} FROM rk GROUP BY query_id, category, language)
SELECT category, language, CAST(grouping(category) * 2 + grouping(language) AS INTEGER) AS level, count(*) AS queries, round(avg(mrr), 6) AS mrr, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_5), 6) AS ndcg_5
FROM m GROUP BY GROUPING SETS ((category), (language), ())""")
def r7(spark, d):
    return evaluate.summary(evaluate.per_query(_judged(spark, d), ("query_id", "category", "language")))


NAMES = ("KEYWORD", "VECTOR", "HYBRID", "RERANKED")
MODES = f"""{RERANK}, rrs AS (SELECT query_id, tbl, id, {SIMILARITY} AS score FROM rs), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tbl, id) AS rank FROM rrs),
modes AS (SELECT 'KEYWORD' AS mode, query_id, tbl, id, rank FROM tlist UNION ALL SELECT 'VECTOR', query_id, tbl, id, rank FROM wlist UNION ALL SELECT 'HYBRID', query_id, tbl, id, rank FROM b UNION ALL SELECT 'RERANKED', query_id, tbl, id, rank FROM rr),
{RELEVANT.format('modes')}, mm AS (SELECT mode, query_id, {MRR} AS mrr FROM rk GROUP BY ALL),
piv AS (SELECT query_id, {', '.join(f"max(mrr) FILTER (mode = '{m}') AS {m}" for m in NAMES)} FROM mm GROUP BY query_id)"""


def _modes(spark, d):
    """Metrics of keyword, vector and hybrid search, and of hybrid search after reranking."""
    rows, _, asked = _both(spark, d)
    text, near = (written(part, "modes-list") for part in _lists(spark, d))
    both = written(fuse.hybrid(text, near, 50), "modes-list")
    wide = fuse.fetched(both.join(asked.select("query_id", "query"), "query_id"), rows, "content")
    ranked = None
    for mode, part in zip(NAMES, (text, near, both, fuse.rerank(wide, 10))):
        part = part.filter("rank <= 10").select("query_id", "tbl", "id", "rank", F.lit(mode).alias("mode"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return evaluate.per_query(_labelled(ranked, rows), ("mode", "query_id"))


@query("r8_mode_comparison", f"{MODES} SELECT query_id, {', '.join(f'round({m}, 6) AS {m}' for m in NAMES)} FROM piv")
def r8(spark, d):
    return evaluate.compared(_modes(spark, d), list(NAMES))


@query("r9_paired_test", f"{MODES}, df AS (SELECT coalesce(round(HYBRID, 6), 0) - coalesce(round(KEYWORD, 6), 0) AS d FROM piv), st AS (SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM df) SELECT n, round(mean, 6) AS mean_difference, round(CASE WHEN sd > 0 THEN mean / sd * sqrt(n) END, 6) AS t, round(CASE WHEN sd > 0 THEN mean / sd END, 6) AS effect FROM st")
def r9(spark, d):
    return evaluate.paired(evaluate.compared(_modes(spark, d), list(NAMES)), "KEYWORD", "HYBRID")


#: Settings of the sweep: reciprocal fusion by constant, weighted fusion by share of the vector side, each by candidates.
GRID = [("rrf", k, None, c) for k in (10, 60, 100) for c in (10, 50)] + [("weighted", None, a, c) for a in (0.3, 0.5, 0.7) for c in (10, 50)]
GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {k or 'NULL'}, {a or 'NULL'}::DOUBLE, {c})" for m, k, a, c in GRID) + ") t(method, rrf_k, alpha, candidates))"


@query("r9_parameter_sweep", f"""{RRF}, {GRID_SQL}, sc AS (SELECT method, rrf_k, alpha, candidates, query_id, tbl, id, round(sum(CASE WHEN method = 'rrf' THEN 1.0::DOUBLE / (rrf_k + rank) ELSE CASE side WHEN 1 THEN alpha ELSE 1 - alpha END * score END), 12) AS score FROM u JOIN grid ON rank <= candidates GROUP BY ALL),
sw AS (SELECT *, row_number() OVER (PARTITION BY method, rrf_k, alpha, candidates, query_id ORDER BY score DESC, tbl, id) AS rank FROM sc), {RELEVANT.format('sw')},
q AS (SELECT method, rrf_k, alpha, candidates, query_id, {MRR} AS mrr FROM rk GROUP BY ALL) SELECT method, CAST(rrf_k AS INTEGER) AS rrf_k, alpha, candidates, round(avg(mrr), 6) AS mrr, count(*) AS queries FROM q GROUP BY ALL""")
def r9_sweep(spark, d):
    grid = spark.createDataFrame(GRID, "method string, rrf_k int, alpha double, candidates int")
    ranked = _labelled(fuse.swept(*_lists(spark, d), grid, 10), chunks(spark, d))
    metrics = evaluate.per_query(ranked, ("method", "rrf_k", "alpha", "candidates", "query_id"))
    return metrics.groupBy("method", "rrf_k", "alpha", "candidates").agg(F.round(F.avg("mrr"), 6).alias("mrr"), F.count("*").alias("queries"))


@query("r6_coverage", f"{MATCHED} SELECT count(*) AS queries, count(f.query_id) AS covered, round(count(f.query_id) / count(*), 6) AS coverage FROM queries q LEFT JOIN (SELECT DISTINCT query_id FROM found) f ON f.query_id = q.query_id")
def r6_coverage(spark, d):
    asked = keyword_queries(spark, d)
    return evaluate.coverage(asked, keyword.search(chunks(spark, d), asked, 10))


@query("r6_graded", f"""{KEYWORD}, gold AS (SELECT query_id, id, (id % 4) AS grade FROM ktext WHERE id % 3 <> 0 AND rank <= 50),
h AS (SELECT k.query_id, rank, coalesce(grade, 0) AS grade FROM ktext k LEFT JOIN gold g ON g.query_id = k.query_id AND g.id = k.id WHERE rank <= 10),
got AS (SELECT query_id, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (grade >= 2) AS hits FROM h GROUP BY query_id),
o AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS n FROM gold),
i AS (SELECT query_id, sum(CASE WHEN n <= 10 THEN (2 ** grade - 1) / log2(n + 1) ELSE 0 END) AS ideal, count(*) FILTER (grade >= 2) AS golden FROM o GROUP BY query_id)
SELECT i.query_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg, round(CASE WHEN golden > 0 THEN coalesce(hits, 0) / golden ELSE 0 END, 6) AS recall, round(coalesce(hits, 0) / 10.0::DOUBLE, 6) AS precision
FROM i LEFT JOIN got ON got.query_id = i.query_id""")
def r6(spark, d):
    ranked = keyword.search(chunks(spark, d), keyword_queries(spark, d), 50)
    gold = ranked.filter("id % 3 <> 0").select("query_id", "id", (F.col("id") % 4).alias("grade"))
    return evaluate.graded(ranked, gold, 10)


@query("r10_latency", "SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def r10(spark, d):
    return evaluate.latency(table(spark, d, "events"), "value", "event_type")


@query("q1_query_language", r"""WITH t AS (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS a, length(regexp_replace(text, '[\s\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{FF65}-\x{FF9F}]', '', 'g')) AS b FROM documents), r AS (SELECT doc_id, CASE WHEN a > 0 THEN (a - b) / a ELSE 0 END AS ratio FROM t)
SELECT doc_id, CASE WHEN ratio >= 0.7 THEN 'JAPANESE' WHEN ratio < 0.1 THEN 'ENGLISH' ELSE 'MIXED' END AS language FROM r""")
def q1(spark, d):
    return table(spark, d, "documents").select("doc_id", X.query_language(F.col("text")).alias("language"))
