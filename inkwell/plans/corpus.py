"""Registered queries of sources, parsing, chunking, store upkeep and query analysis, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import chunk, ingest, parse, store
from inkwell.operators import query as analysis
from inkwell.plans.views import CHUNKS, chunk_vectors, chunks, table
from inkwell.sources import pages as source
from inkwell.sources.shared import fresh_path
from inkwell.sources.versioned import Store

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


LINK = 'href="([^"]+)"'
RESOLVED = r"CASE WHEN regexp_matches(link, '^https?://') THEN link ELSE (CASE WHEN ends_with(base, '/') THEN base ELSE regexp_extract(base, '^(.*/)', 1) END) || regexp_replace(link, '^\./', '') END"
LINKS = f"""links AS (SELECT page_id, {RESOLVED} AS url, CAST(min(pos) AS INTEGER) AS pos FROM (
  SELECT page_id, url AS base, unnest(regexp_extract_all(html, '{LINK}', 1)) AS link, unnest(range(0, len(regexp_extract_all(html, '{LINK}', 1)))) AS pos FROM pages) GROUP BY ALL)"""


@query("s1_read_pages", r"SELECT page_id, CASE WHEN html IS NULL OR trim(regexp_replace(html, '\s+', ' ', 'g')) = '' THEN '[' || CAST(page_id AS VARCHAR) || '] blank content' END AS error, length(html) AS n FROM pages")
def s1(spark, d):
    return source.checked(table(spark, d, "pages"), "html", "page_id").select("page_id", "error", F.length("html").cast("bigint").alias("n"))


@query("s2_links", f"WITH {LINKS} SELECT page_id, url, pos FROM links")
def s2(spark, d):
    return source.links(table(spark, d, "pages"), LINK)


@query("s3_resolve", f"WITH b AS (SELECT page_id, url AS base, CASE page_id % 3 WHEN 0 THEN './a/b.html' WHEN 1 THEN url ELSE 'c.html' END AS link FROM pages) SELECT page_id, {RESOLVED} AS url FROM b")
def s3(spark, d):
    link = F.when(F.col("page_id") % 3 == 0, "./a/b.html").when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("c.html")
    return table(spark, d, "pages").select("page_id", source.resolved(F.col("url"), link).alias("url"))


ARTICLE = 'href="(/(?:page/[0-9]+/?|th[^"]+))"'


@query("s4_article_links", f"SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{ARTICLE}', 1)) AS link FROM pages")
def s4(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(ARTICLE), F.lit(1))).alias("link")).distinct()


@query("s1_read_files", "SELECT doc_id, text AS content FROM documents WHERE text IS NOT NULL AND text <> ''")
def s1_files(spark, d):
    """Texts written as files, one each, and read back; a file's name holds its id."""
    path = fresh_path(spark, "files")
    source.write_files(table(spark, d, "documents").filter("text IS NOT NULL AND text <> ''").select(F.concat(F.lit("d"), "doc_id").alias("name"), F.col("text").alias("content")), path)
    return source.read_files(spark, path).select(F.regexp_extract("path", r"/d(-?[0-9]+)[.][0-9]+[.][0-9]+$", 1).cast("bigint").alias("doc_id"), "content")


@query("s5_crawl_order", f"WITH {LINKS}, p AS (SELECT *, contains(lower(url), 'th') OR contains(lower(url), 'ing') AS priority FROM links) SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, pos, url) - 1 AS INTEGER) AS place FROM p")
def s5(spark, d):
    return source.crawl_order(source.links(table(spark, d, "pages"), LINK), ["TH", "ing"])


@query("s6_refresh_source", "SELECT source, count(*) AS n, CAST(sum(CASE WHEN source = 'src3' THEN 1 ELSE 0 END) AS BIGINT) AS refreshed FROM documents WHERE source <> 'src3' OR doc_id % 3 = 0 GROUP BY source")
def s6(spark, d):
    """A source's rows replaced in a versioned store, whose other sources stay."""
    kept = Store(spark, fresh_path(spark, "store"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("url"), F.col("text").alias("content"), F.lit(0).alias("refreshed"))
    kept.append(docs)
    kept.replace(docs.filter("source = 'src3' AND doc_id % 3 = 0").withColumn("refreshed", F.lit(1)))
    return kept.read().groupBy("source").agg(F.count("*").alias("n"), F.sum("refreshed").alias("refreshed"))


EDITED = """WITH v AS (SELECT doc_id, source, text, 1 AS version FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source, text, 2 FROM documents WHERE doc_id % 2 = 1),
w AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE version END AS version FROM v WHERE doc_id % 11 <> 0)
SELECT version, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM w GROUP BY version, source"""


@query("s6_versions", EDITED)
def s6_versions(spark, d):
    """Rows of documents appended in two versions, a fifth of them changed, an eleventh deleted, then rewritten in one folder."""
    kept = Store(spark, fresh_path(spark, "store"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("url"), F.col("text").alias("content"))
    kept.append(docs.filter("doc_id % 2 = 0").withColumn("version", F.lit(1)))
    kept.append(docs.filter("doc_id % 2 = 1").withColumn("version", F.lit(2)))
    kept.upsert(docs.filter("doc_id % 5 = 0").withColumn("content", F.concat("content", F.lit("!"))).withColumn("version", F.lit(3)))
    kept.delete(docs.filter("doc_id % 11 = 0"))
    kept.compact()
    return kept.read().groupBy("version", "source").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def _html(spark, d):
    return table(spark, d, "pages").select(F.col("url").alias("key"), F.col("html").alias("body"))


@query("p1_html_sections")
def p1(spark, d):
    return parse.sections(_html(spark, d), parse.html_sections)


@query("p2_html_text")
def p2(spark, d):
    return parse.plain(_html(spark, d))


SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
MARKDOWN = rf"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS key, string_split('# ' || replace(replace(replace(text, chr(10), chr(10) || '## '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT key, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM t),
f AS (SELECT *, starts_with(line, '```') AS fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS seen FROM l),
h AS (SELECT *, NOT fence AND seen % 2 = 0 AND regexp_matches(rtrim(line, {SPACE}), '^#{{2,3}}\s+.+$') AS head FROM f),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS sec FROM h),
g AS (SELECT key, sec, trim(string_agg(line, chr(10) ORDER BY i), {SPACE}) AS content, nullif(regexp_extract(rtrim(first(line ORDER BY i), {SPACE}), '^(#{{2,3}})\s+.+$', 1), '') AS hashes, trim(regexp_extract(rtrim(first(line ORDER BY i), {SPACE}), '^#{{2,3}}\s+(.+)$', 1), {SPACE}) AS name FROM s GROUP BY key, sec),
ti AS (SELECT key, first(trim(regexp_extract(line, '^#\s+(.+)$', 1), {SPACE}) ORDER BY i) AS title FROM l WHERE regexp_matches(line, '^#\s+.+$') GROUP BY key),
heads AS (SELECT key, max(sec) AS heads FROM g GROUP BY key)
SELECT g.key, CAST(row_number() OVER (PARTITION BY g.key ORDER BY sec) - 1 AS INTEGER) AS section, content, nullif(title, '') AS title, CASE WHEN sec > 0 THEN name WHEN heads > 0 THEN nullif(title, '') END AS section_title, CAST(length(hashes) AS VARCHAR) AS heading_level
FROM g JOIN heads USING (key) LEFT JOIN ti ON ti.key = g.key WHERE content <> ''"""


@query("p3_markdown_sections", MARKDOWN)
def p3(spark, d):
    """Markdown built from documents: first line as the title, each further line a section."""
    body = F.concat(F.lit("# "), F.regexp_replace("text", "\n", "\n## "))
    rows = parse.sections(table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("key"), body.alias("body")), parse.markdown_sections)
    return rows.select("key", "section", "content", *[F.try_element_at("metadata", F.lit(n)).alias(n) for n in ("title", "section_title", "heading_level")])


JAVA = "format_string('package shop.p%s;\\n\\n/** %s. */\\npublic class Part%s {\\n    private int size = %s;\\n\\n    /** Price. */\\n    public double price() {\\n        return %s; // }\\n    }\\n}\\n', p_size, p_name, p_partkey, p_size, p_retailprice)"


def java_files(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("Part"), "p_partkey", F.lit(".java")).alias("key"), F.expr(JAVA).alias("body"))


JAVA_SQL = """WITH j AS (SELECT 'Part' || p_partkey || '.java' AS key, p_partkey AS n, p_size AS size, p_name AS name, CAST(p_retailprice AS VARCHAR) AS price FROM part)
SELECT key, 0 AS section, '/** ' || name || '. */' || chr(10) || 'public class Part' || n || ' {' || chr(10) || chr(10) || '    // Fields' || chr(10) || '    // - size' || chr(10) || '}' AS content, 'class' AS element_type, CAST(NULL AS VARCHAR) AS method_name, 'shop.p' || size || '.Part' || n AS fqcn FROM j
UNION ALL SELECT key, 1, '// Class: Part' || n || ' (shop.p' || size || '.Part' || n || ')' || chr(10) || '// Fields: size' || chr(10) || chr(10) || '/** Price. */' || chr(10) || '    public double price() {' || chr(10) || chr(10) || '        return ' || price || '; // }' || chr(10) || '    }', 'method', 'price', 'shop.p' || size || '.Part' || n FROM j"""


@query("p4_java_sections", JAVA_SQL)
def p4(spark, d):
    rows = parse.sections(java_files(spark, d), parse.java_sections)
    return rows.select("key", "section", "content", *[F.try_element_at("metadata", F.lit(n)).alias(n) for n in ("element_type", "method_name", "fqcn")])


XML = "format_string('<list><component name=\"%s\" class=\"shop.%s.Part%s\"/><component name=\"size\"><property value=\"%s\"/></component></list>', p_name, lower(p_type), p_partkey, p_size)"


def xml_files(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.expr(XML).alias("body"))


XML_SQL = """WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS key, 'shop.' || lower(p_type) || '.Part' || p_partkey AS fqcn, p_name AS name, p_size AS size FROM part)
SELECT key, 0 AS section, '<!-- File: ' || key || ' -->' || chr(10) || '<!-- Parent: <list> -->' || chr(10) || '<component name="' || name || '" class="' || fqcn || '" />' AS content, name AS element_name, fqcn, 'list' AS parent_element FROM x
UNION ALL SELECT key, 1, '<!-- File: ' || key || ' -->' || chr(10) || '<!-- Parent: <list> -->' || chr(10) || '<component name="size"><property value="' || size || '" /></component>', 'size', NULL, 'list' FROM x"""


@query("p5_xml_sections", XML_SQL)
def p5(spark, d):
    rows = parse.sections(xml_files(spark, d), parse.xml_sections)
    return rows.select("key", "section", "content", *[F.try_element_at("metadata", F.lit(n)).alias(n) for n in ("element_name", "fqcn", "parent_element")])


@query("p6_content_kind", "WITH u AS (SELECT 'page' AS tbl, page_id AS id, html AS t FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents) SELECT tbl, id, CASE WHEN starts_with(lower(trim(t)), '<!doctype') OR starts_with(lower(trim(t)), '<html') OR contains(lower(t), '<head>') OR contains(lower(t), '<body>') THEN 'HTML' ELSE 'MARKDOWN' END AS kind FROM u")
def p6(spark, d):
    rows = table(spark, d, "pages").select(F.lit("page").alias("tbl"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    rows = rows.unionByName(table(spark, d, "documents").select(F.lit("document").alias("tbl"), F.col("doc_id").alias("id"), F.col("text").alias("t")))
    return rows.select("tbl", "id", F.when(X.looks_like_html(F.col("t")), "HTML").otherwise("MARKDOWN").alias("kind"))


@query("p7_fault_isolation", "SELECT url AS key, '[' || url || '] blank content' AS error FROM pages WHERE page_id % 10 = 0")
def p7(spark, d):
    rows = table(spark, d, "pages").select(F.col("url").alias("key"), F.when(F.col("page_id") % 10 != 0, F.col("html")).alias("body"))
    return parse.sections(rows, parse.html_sections).filter("error IS NOT NULL").select("key", "error")


RATIO = r"""t AS (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS a, length(regexp_replace(text, '[\s\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]', '', 'g')) AS b FROM documents),
r AS (SELECT doc_id, CASE WHEN a > 0 THEN (a - b) / a ELSE 0 END AS ratio FROM t)"""


@query("c1_japanese_ratio", f"WITH {RATIO} SELECT doc_id, round(ratio, 6) AS ratio FROM r")
def c1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.japanese_ratio(F.col("text")), 6).alias("ratio"))


@query("c2_token_budget", f"WITH {RATIO} SELECT doc_id, CAST(floor(512 * (4.0 - 2.0 * ratio)) AS BIGINT) AS chars FROM r")
def c2(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_budget_chars(512, F.col("text")).alias("chars"))


KIND = "CASE doc_id % 6 WHEN 0 THEN 'HTML' WHEN 1 THEN 'MARKDOWN' WHEN 2 THEN 'TEXT' WHEN 3 THEN 'JAVA' WHEN 4 THEN 'JAVADOC' ELSE 'XML' END"


def _typed(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.expr(KIND).alias("content_type"), F.create_map(F.lit("source"), F.col("source"), F.lit("language"), F.col("lang")).alias("metadata"))


@query("c3_chunks")
def c3(spark, d):
    return chunk.chunked(_typed(spark, d))


@query("c7_chunk_metadata")
def c7(spark, d):
    docs = _typed(spark, d)
    return chunk.with_metadata(chunk.chunked(docs), docs).withColumn("metadata", F.to_json("metadata"))


WINDOW_END = """CASE WHEN {0} + 800 >= length(text) THEN length(text) ELSE {0} + CASE WHEN contains({1}, '。') AND 801 - instr(reverse({1}), '。') > 1 THEN 801 - instr(reverse({1}), '。')
  WHEN NOT contains({1}, '。') AND contains({1}, chr(10)) AND 801 - instr(reverse({1}), chr(10)) > 1 THEN 801 - instr(reverse({1}), chr(10)) ELSE 800 END END"""


def window_end(start):
    return WINDOW_END.format(start, f"substring(text, {start} + 1, 800)")


WINDOWS = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, text, 0::BIGINT AS s, CAST({window_end('0')} AS BIGINT) AS e FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT id, text, n AS s, CAST({window_end('n')} AS BIGINT) AS e FROM (SELECT id, text, greatest(s + 1, e - 100) AS n FROM w WHERE e < length(text))),
p AS (SELECT id, s, CASE WHEN length(text) > 800 THEN trim(substring(text, s + 1, e - s), {SPACE}) ELSE text END AS content FROM w)
SELECT id, {KIND.replace('doc_id', 'id')} AS content_type, CAST(row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY id) AS INTEGER) AS total_chunks, content FROM p WHERE length(content) >= 50"""


@query("c8_fixed_windows", WINDOWS)
def c8(spark, d):
    return chunk.chunked(_typed(spark, d), chunk.fixed_windows)


@query("c9_chunk_quality")
def c9(spark, d):
    docs = _typed(spark, d)
    return chunk.quality(docs, chunk.chunked(docs))


@query("m1_new_urls", f"WITH {LINKS} SELECT DISTINCT url FROM links WHERE url NOT IN (SELECT url FROM pages) AND url NOT IN (SELECT url FROM links WHERE page_id % 3 = 0)")
def m1(spark, d):
    found = source.links(table(spark, d, "pages"), LINK)
    stored = table(spark, d, "pages").select("url").unionByName(found.filter("page_id % 3 = 0").select("url"))
    return store.new_urls(found, stored)


BEFORE = "before AS (SELECT CAST(doc_id AS VARCHAR) AS url, text AS content FROM documents WHERE doc_id % 7 <> 0)"
AFTER = "after AS (SELECT CAST(doc_id AS VARCHAR) AS url, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS content FROM documents WHERE doc_id % 11 <> 0)"
STATUS = f"{BEFORE}, {AFTER}, st AS (SELECT coalesce(a.url, b.url) AS url, CASE WHEN b.url IS NULL THEN 'new' WHEN a.url IS NULL THEN 'deleted' WHEN a.content = b.content THEN 'unchanged' ELSE 'updated' END AS status FROM before b FULL JOIN after a ON a.url = b.url)"


def _versions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), "text")
    before = docs.filter("doc_id % 7 <> 0").select("url", F.col("text").alias("content"))
    after = docs.filter("doc_id % 11 <> 0").select("url", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return before, after


@query("m2_changes", f"WITH {STATUS} SELECT url, status FROM st")
def m2(spark, d):
    return store.changes(*_versions(spark, d))


@query("m2_store_changes", f"WITH {STATUS} SELECT url, status FROM st")
def m2_store(spark, d):
    """m2_changes against a store, of which only the url ranges with other digests are read."""
    before, after = _versions(spark, d)
    kept = Store(spark, fresh_path(spark, "store"))
    kept.append(before.withColumn("source", F.lit("documents")))
    return kept.changes(after)


@query("m2_apply_changes", f"WITH {STATUS} SELECT url, content FROM after")
def m2_apply(spark, d):
    before, after = _versions(spark, d)
    return store.apply_changes(before, after, store.changes(before, after))


VECTOR_SUM = "round(list_sum(list_transform(CAST({0} AS DOUBLE[]), lambda x: x)), 4)"


def _sum(c):
    return F.round(F.aggregate(X.doubles(F.col(c)), F.lit(0.0), lambda s, x: s + x), 4)


@query("m3_write_vectors", f"WITH {CHUNKS} SELECT c.id, {VECTOR_SUM.format('coalesce(f.embedding, e.embedding)')} AS total FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.id LEFT JOIN embeddings f ON f.vec_id = c.id + 1 AND c.id % 2 = 0")
def m3(spark, d):
    fresh = table(spark, d, "embeddings").filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("vector"))
    return store.write_vectors(chunk_vectors(spark, d), fresh).select("id", _sum("vector").alias("total"))


@query("m4_clear_and_backlog", f"WITH {CHUNKS} SELECT c.id, c.source FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.id WHERE e.embedding IS NULL OR c.source = 'src3' ORDER BY c.id LIMIT 50")
def m4(spark, d):
    return store.backlog(store.clear_vectors(chunk_vectors(spark, d), "src3"), 50).select("id", "source")


RESULTS = "r AS (SELECT 'host' || CAST(page_id % 5 AS VARCHAR) AS source, CASE WHEN page_id % 10 = 0 THEN '[' || url || '] blank content' END AS error FROM pages)"


def _results(spark, d):
    rows = table(spark, d, "pages").withColumn("body", F.when(F.col("page_id") % 10 != 0, F.col("html")))
    return source.checked(rows, "body", "url").select(F.concat(F.lit("host"), (F.col("page_id") % 5).cast("string")).alias("source"), "error")


@query("m5_ingest_summary", f"WITH {RESULTS} SELECT source, count(*) AS processed, count(*) FILTER (error IS NULL) AS success, count(error) AS errors FROM r GROUP BY source")
def m5(spark, d):
    return store.ingest_summary(_results(spark, d))


@query("m5_ingest_errors", f"WITH {RESULTS} SELECT source, error AS message, count(*) AS n FROM r WHERE error IS NOT NULL GROUP BY ALL")
def m5_errors(spark, d):
    return store.ingest_errors(_results(spark, d))


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def _pages(spark, d):
    """Pages of five sources; every tenth is blank."""
    rows = table(spark, d, "pages")
    return rows.select(F.concat(F.lit("host"), (F.col("page_id") % 5).cast("string")).alias("source"), "url", F.when(F.col("page_id") % 10 != 0, F.col("html")).alias("body"), "page_id")


@query("ingest_pages")
def ingest_pages(spark, d):
    """Chunks of each url in the store after two incremental runs: every seventh page first, then all pages."""
    path, rows = fresh_path(spark, "store"), _pages(spark, d)
    for part in (rows.filter("page_id % 7 = 0"), rows):
        ingest.ingest(part, path, now())
    return Store(spark, path).read().groupBy("source", "url", "content_type", "tbl").agg(F.count("*").alias("chunks"))


@query("ingest_refresh")
def ingest_refresh(spark, d):
    """Chunks of each source after a full load and a refresh of one source with half of its pages."""
    path, rows = fresh_path(spark, "store"), _pages(spark, d)
    ingest.ingest(rows, path, now(), "replace")
    ingest.ingest(rows.filter("source = 'host3' AND page_id % 2 = 0"), path, now(), "replace")
    return Store(spark, path).read().groupBy("source").agg(F.count_distinct("url").alias("urls"), F.count("*").alias("chunks"))


@query("ingest_articles")
def ingest_articles(spark, d):
    """Articles whose kind is sniffed: pages are HTML, documents Markdown; the summary of the run."""
    marked = F.concat(F.lit("# "), F.regexp_replace("text", "\n", "\n## "))
    articles = table(spark, d, "documents").select("source", F.concat(F.lit("doc/"), "doc_id").alias("url"), marked.alias("body"))
    return ingest.ingest(_pages(spark, d).drop("page_id").unionByName(articles), fresh_path(spark, "store"), now())


FILES_SQL = f"""WITH j AS ({JAVA_SQL}), x AS ({XML_SQL}),
f AS (SELECT 'java/' || key AS url, 'JAVA' AS content_type, content, fqcn FROM j UNION ALL SELECT 'xml/' || replace(content, '<!-- File: ' || key || ' -->', '<!-- File: xml/' || key || '.xml -->') AS url, 'XML', replace(content, '<!-- File: ' || key || ' -->', '<!-- File: xml/' || key || '.xml -->'), fqcn FROM x)
SELECT content_type, 'code' AS tbl, fqcn, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM f WHERE length(content) >= 50 GROUP BY ALL"""


@query("ingest_code", FILES_SQL)
def ingest_code(spark, d):
    """Java and XML files, told by their names, to the code store: chunks and characters by class."""
    java = java_files(spark, d).select(F.lit("java").alias("source"), F.concat(F.lit("java/"), "key").alias("url"), "body")
    xml = xml_files(spark, d).select(F.lit("xml").alias("source"), F.concat(F.lit("xml/"), "key", F.lit(".xml")).alias("url"), "body")
    files, path = java.unionByName(xml).withColumn("kind", ingest.file_kind(F.col("url"), F.col("body"))), fresh_path(spark, "store")
    ingest.ingest(files, path, now())
    rows = Store(spark, path).read()
    return rows.groupBy("content_type", "tbl", "fqcn").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query("m6_store_counts", f"WITH {CHUNKS} SELECT c.source, count(*) AS chunks, count(e.embedding) AS embedded FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.id GROUP BY c.source")
def m6(spark, d):
    return store.counts(chunk_vectors(spark, d))


@query("m7_finders", f"WITH {CHUNKS} SELECT id FROM chunks WHERE module = 'm2' AND app_type = 'batch'")
def m7(spark, d):
    return chunks(spark, d).filter(store.equal(module="m2", app_type="batch")).select("id")


@query("m8_defaults", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'v' ELSE '6u3' END AS version, CASE WHEN lang = 'en' THEN 'ja' ELSE lang END AS language, TIMESTAMP '2024-06-01 00:00:00' AS created_at, TIMESTAMP '2024-06-01 00:00:00' AS updated_at FROM documents")
def m8(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "v").alias("version"), F.nullif("lang", F.lit("en")).alias("language"))
    return store.with_defaults(rows, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))


@query("m9_metadata_columns", "SELECT doc_id, source, lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'm' END AS module, CAST(NULL AS VARCHAR) AS url FROM documents")
def m9(spark, d):
    pairs = F.map_filter(F.create_map(F.lit("source"), F.col("source"), F.lit("language"), F.col("lang"), F.lit("module"), F.when(F.col("doc_id") % 2 == 0, "m")), lambda _, v: v.isNotNull())
    rows = store.metadata_columns(table(spark, d, "documents").select("doc_id", pairs.alias("metadata")))
    return rows.select("doc_id", "source", "language", "module", "url")


ENTITY = [r"[A-Z][a-z]+ing", r"[a-z]+tion"]


@query("q2_entities", r"WITH e AS (SELECT conv_id, turn, list_concat(regexp_extract_all(text, '[A-Z][a-z]+ing'), regexp_extract_all(text, '[a-z]+tion')) AS e FROM conversations WHERE role = 'user') SELECT conv_id, turn, list_filter(e, lambda x, i: list_position(e, x) = i) AS entities FROM e")
def q2(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", analysis.entities(F.col("text"), ENTITY).alias("entities"))


def _asked(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


SYNONYMS = [("the", ["der", "le"]), ("and", ["und", "et"]), ("of", ["von", "de"])]


@query("q3_synonyms", r"""WITH syn AS (SELECT * FROM (VALUES ('the', ['der', 'le']), ('and', ['und', 'et']), ('of', ['von', 'de'])) t(key, synonyms)),
lk AS (SELECT key AS term, synonyms AS terms FROM syn UNION ALL SELECT s AS term, list_concat([key], list_filter(synonyms, lambda x: x <> s)) FROM (SELECT key, synonyms, unnest(synonyms) AS s FROM syn)),
q AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'),
tk AS (SELECT query_id, unnest(regexp_split_to_array(trim(query), '\s+')) AS token, unnest(range(0, len(regexp_split_to_array(trim(query), '\s+')))) AS pos FROM q UNION ALL SELECT query_id, trim(query), 1000000 FROM q),
h AS (SELECT query_id, pos, unnest(terms) AS word, unnest(range(0, len(terms))) AS sub FROM tk JOIN lk ON lk.term = lower(token)),
f AS (SELECT query_id, word, min(pos * 100 + sub) AS place FROM h GROUP BY ALL)
SELECT q.query_id, coalesce(list(word ORDER BY place) FILTER (word IS NOT NULL), []) AS expansions FROM q LEFT JOIN f ON f.query_id = q.query_id GROUP BY q.query_id""")
def q3(spark, d):
    synonyms = spark.createDataFrame(SYNONYMS, "key string, synonyms array<string>")
    return analysis.expanded(_asked(spark, d), synonyms).select("query_id", "expansions")


APP_WORDS = [("th", "web"), ("thing", "rest"), ("ion", "batch"), ("tion", "messaging")]


@query("q4_suggested_filters", r"""WITH w AS (SELECT * FROM (VALUES ('th', 'web'), ('thing', 'rest'), ('ion', 'batch'), ('tion', 'messaging')) t(keyword, app_type)),
q AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'),
h AS (SELECT query_id, app_type, row_number() OVER (PARTITION BY query_id ORDER BY length(keyword) DESC, keyword) AS n FROM q JOIN w ON contains(lower(query), keyword))
SELECT q.query_id, nullif(regexp_extract(query, '[a-z]+ent', 0), '') AS module, h.app_type FROM q LEFT JOIN h ON h.query_id = q.query_id AND n = 1""")
def q4(spark, d):
    words = spark.createDataFrame(APP_WORDS, "keyword string, app_type string")
    return analysis.suggested(_asked(spark, d), r"[a-z]+ent", words).select("query_id", "module", "app_type")
