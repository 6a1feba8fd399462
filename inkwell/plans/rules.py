"""Registered queries of catalogue search, triage, rule scans and the run log, with their SQL.

Catalogues come from the part table, queues from each user's events, texts from documents and pages; rule tables are
small and given here.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkwell.functions import text as X
from inkwell.operators import catalog, latency, scan
from inkwell.plans.views import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


ENTRIES = "entries AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'module' ELSE 'handler' END AS kind, p_name || ' ' || CAST(p_partkey % 50 AS VARCHAR) AS name, p_brand AS brand, p_type AS category FROM part)"
SEARCHES = r"searches AS (SELECT p_partkey AS query_id, split_part(p_name, ' ', 1) || ' #' || CAST(p_size AS VARCHAR) AS query, CASE WHEN p_partkey % 200 = 0 THEN lower(p_type) END AS category FROM part WHERE p_partkey % 100 = 0)"


def entries(spark, d):
    kind = F.when(F.col("p_partkey") % 3 == 0, "api").when(F.col("p_partkey") % 3 == 1, "module").otherwise("handler")
    return table(spark, d, "part").select(kind.alias("kind"), F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 50).cast("string")).alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))


def searches(spark, d):
    words = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" #"), F.col("p_size").cast("string"))
    return table(spark, d, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), words.alias("query"), F.when(F.col("p_partkey") % 200 == 0, F.lower("p_type")).alias("category"))


@query("g1_catalog_search", f"""WITH {ENTRIES}, {SEARCHES}, tk AS (SELECT query_id, category AS wanted, unnest(list_distinct(regexp_split_to_array(lower(trim(query)), '\\s+'))) AS token FROM searches)
SELECT query_id, kind, name, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE kind WHEN 'api' THEN 1 WHEN 'module' THEN 2 ELSE 3 END, name) AS INTEGER) AS place FROM (SELECT DISTINCT query_id, kind, name FROM tk JOIN entries e ON (contains(lower(e.name), token) OR contains(lower(e.brand), token) OR contains(lower(e.category), token)) AND (e.kind <> 'api' OR wanted IS NULL OR lower(e.category) = wanted))""")
def g1(spark, d):
    return catalog.any_token(entries(spark, d), searches(spark, d), ["name", "brand", "category"])


@query("g2_keyed_lookup", "WITH c AS (SELECT p_partkey, 'shop.' || lower(p_type) || '.Part' || CAST(p_partkey AS VARCHAR) AS fqcn FROM part), w AS (SELECT p_partkey AS asked, CASE WHEN p_partkey % 2 = 0 THEN 'Part' || CAST(p_partkey AS VARCHAR) ELSE lower(p_type) || '.Part' || CAST(p_partkey AS VARCHAR) END AS wanted FROM part WHERE p_partkey % 10 = 0) SELECT asked, p_partkey FROM w JOIN c ON fqcn = wanted OR ends_with(fqcn, '.' || wanted)")
def g2(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("shop."), F.lower("p_type"), F.lit(".Part"), F.col("p_partkey").cast("string")).alias("fqcn"))
    short = F.concat(F.lit("Part"), F.col("p_partkey").cast("string"))
    asked = table(spark, d, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("asked"), F.when(F.col("p_partkey") % 2 == 0, short).otherwise(F.concat(F.lower("p_type"), F.lit("."), short)).alias("wanted"))
    return catalog.by_suffix(rows, asked).select("asked", "p_partkey")


@query("g2_named_lookup", "SELECT a.p_partkey AS asked, b.p_partkey FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) WHERE a.p_partkey % 100 = 0")
def g2_named(spark, d):
    parts = table(spark, d, "part")
    asked = parts.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("asked"), F.upper("p_name").alias("wanted"))
    return catalog.by_name(parts.select("p_partkey", "p_name"), asked, "p_name").select("asked", "p_partkey")


@query("g2_name_or_artifact", "SELECT a.p_partkey AS asked, b.p_partkey FROM part a JOIN part b ON lower(b.p_name) = lower(a.p_name) OR lower(b.p_brand || '.' || b.p_partkey) = lower(a.p_name) WHERE a.p_partkey % 100 = 0 UNION ALL SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_brand || '.' || a.p_partkey = b.p_brand || '.' || b.p_partkey WHERE a.p_partkey % 100 = 50")
def g2_artifact(spark, d):
    artifact = F.concat("p_brand", F.lit("."), F.col("p_partkey").cast("string"))
    parts = table(spark, d, "part").select("p_partkey", "p_name", artifact.alias("artifact"))
    asked = parts.filter("p_partkey % 100 IN (0, 50)").select(F.col("p_partkey").alias("asked"), F.when(F.col("p_partkey") % 100 == 0, F.upper("p_name")).otherwise(F.lower("artifact")).alias("wanted"))
    return catalog.by_name(parts, asked, "p_name", "artifact").select("asked", "p_partkey")


@query("g3_catalog_index", "SELECT DISTINCT lower(p_type) AS category, p_name AS name FROM part")
def g3(spark, d):
    return catalog.grouped(table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("name")))


@query("g3_class_index", "SELECT DISTINCT p_brand AS module, p_name AS class_name FROM part")
def g3_classes(spark, d):
    modules = table(spark, d, "part").groupBy(F.col("p_brand").alias("name"), "p_size", F.floor(F.col("p_partkey") / 1000).alias("part")).agg(F.collect_set("p_name").alias("key_classes"))
    return catalog.class_index(modules)


PATTERNS = [
    ("alpha", "data", "the and thing", "of er", "ing tion", ["web"]),
    ("beta", "flow", "entle ion", "de la", "que le", []),
    ("gamma", "flow", "der die das", "und", "heit keit", ["batch", "web"]),
    ("delta", None, "token reading", "ción", "mente", ["rest"]),
]
CATEGORY_WORDS = [("data", "the"), ("data", "of"), ("data", "token"), ("flow", "de"), ("flow", "und"), ("form", "heit"), ("form", "ción"), ("form", "ment")]
PATTERN_SQL = """pt AS (SELECT * FROM (VALUES ('alpha','data','the and thing','of er','ing tion',['web']), ('beta','flow','entle ion','de la','que le',CAST([] AS VARCHAR[])), ('gamma','flow','der die das','und','heit keit',['batch','web']), ('delta',NULL,'token reading','ción','mente',['rest'])) t(name, category, description, problem, solution, app_types)),
w AS (SELECT * FROM (VALUES ('data','the'),('data','of'),('data','token'),('flow','de'),('flow','und'),('form','heit'),('form','ción'),('form','ment')) t(category, keyword)),
asked AS (SELECT conv_id * 1000 + turn AS query_id, text AS query, CASE WHEN turn % 4 = 0 THEN 'web' END AS app_type, CASE WHEN conv_id % 2 = 0 THEN ['und', 'token'] ELSE CAST([] AS VARCHAR[]) END AS constraints FROM conversations WHERE role = 'user'),
held AS (SELECT query_id, w.category, count(*) AS hits, count(*) / (SELECT count(*) FROM w w2 WHERE w2.category = w.category) AS share, list(keyword) AS keywords FROM asked JOIN w ON contains(lower(query), keyword) GROUP BY query_id, w.category),
tops AS (SELECT query_id, arg_min(category, (-share, category)) AS asked, flatten(list(keywords)) AS keywords FROM held GROUP BY query_id)"""


def asked(spark, d):
    rows = table(spark, d, "conversations").filter("role = 'user'")
    limits = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("und"), F.lit("token"))).otherwise(F.expr("cast(array() AS array<string>)"))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), F.when(F.col("turn") % 4 == 0, "web").alias("app_type"), limits.alias("constraints"))


def words(spark):
    return spark.createDataFrame(CATEGORY_WORDS, "category string, keyword string")


@query("g4_recommend", f"""WITH {PATTERN_SQL}, rw AS (SELECT a.query_id, p.name,
  CASE WHEN t.keywords IS NULL THEN 0.5 ELSE len(list_filter(t.keywords, lambda k: contains(body, k))) / len(t.keywords) END AS kw,
  CASE WHEN t.asked IS NULL OR p.category IS NULL THEN 0.5 WHEN p.category = t.asked THEN 1.0 ELSE 0.3 END AS cat,
  CASE WHEN a.app_type IS NULL THEN 0.8 WHEN len(p.app_types) = 0 THEN 0.5 WHEN list_contains(p.app_types, a.app_type) THEN 1.0 ELSE 0.1 END AS app,
  CASE WHEN len(a.constraints) = 0 THEN 0.7 ELSE len(list_filter(a.constraints, lambda k: contains(body, k))) / len(a.constraints) END AS con
  FROM asked a LEFT JOIN tops t ON t.query_id = a.query_id CROSS JOIN (SELECT *, lower(concat_ws(' ', name, description, problem, solution, category)) AS body FROM pt) p),
sc AS (SELECT query_id, name, round(CAST(0.40 * kw + 0.25 * cat + 0.20 * app + 0.15 * con AS DOUBLE), 6) AS score FROM rw),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS INTEGER) AS rank FROM sc WHERE score >= 0.2) SELECT query_id, rank, name, score FROM rk WHERE rank <= 3""")
def g4(spark, d):
    patterns = spark.createDataFrame(PATTERNS, "name string, category string, description string, problem string, solution string, app_types array<string>")
    return catalog.recommended(asked(spark, d), patterns, words(spark)).select("query_id", "rank", "name", "score")


@query("g5_error_category", f"WITH {PATTERN_SQL.replace('conversations WHERE', 'conversations WHERE')}, b AS (SELECT query_id, arg_min(category, (-hits, category)) AS category FROM held GROUP BY query_id) SELECT a.query_id, coalesce(b.category, 'general') AS category FROM asked a LEFT JOIN b ON b.query_id = a.query_id")
def g5(spark, d):
    return catalog.error_category(asked(spark, d), words(spark))


def errors(spark, d):
    """Error reports from events: type, value and user in one line."""
    text = F.concat(F.lit("Failed "), F.initcap("event_type"), F.lit("Handler in shop."), F.col("event_type"), F.lit(".Step: "), F.initcap("event_type"), F.lit("Exception code ERR-"), F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("query_id"), text.alias("query"), F.when(F.col("event_id") % 2 == 0, "ERR-007").when(F.col("event_id") % 3 == 0, "bad").alias("code"), F.when(F.col("event_type") == "error", "handler").otherwise("general").alias("category"))
    return rows


REPORTS = """er AS (SELECT event_id AS query_id, upper(event_type[1]) || lower(event_type[2:]) AS n, event_type AS e, 'ERR-' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') AS found, CASE WHEN event_id % 2 = 0 THEN 'ERR-007' END AS given, CASE WHEN event_type = 'error' THEN 'handler' ELSE 'general' END AS category FROM events)"""


@query("g6_error_features", f"""WITH {REPORTS} SELECT query_id, coalesce(given, found) AS code, ['shop.' || e || '.Step'] AS components, [n || 'Handler'] AS handlers,
list_filter([coalesce(given, found), n || 'Exception', n || 'Handler', CASE WHEN category <> 'general' THEN category END], lambda t: t IS NOT NULL) AS terms FROM er""")
def g6(spark, d):
    return catalog.error_features(errors(spark, d), "shop.").select("query_id", "code", "components", "handlers", "terms")


HELP = [("queue", "The click handler stops"), ("order", "ErrorHandler out of order"), ("money", "purchaseException and PurchaseException"), ("seven", "see err-007"), ("other", "nothing")]
HELP_SQL = "hp AS (SELECT * FROM (VALUES ('queue','The click handler stops'),('order','ErrorHandler out of order'),('money','purchaseException and PurchaseException'),('seven','see err-007'),('other','nothing')) t(name, body))"


@query("g7_error_matches", f"""WITH {REPORTS}, {HELP_SQL}, tk AS (SELECT query_id, unnest([coalesce(given, found), n || 'Exception', n || 'Handler', CASE WHEN category <> 'general' THEN category END]) AS token, 0 AS step FROM er UNION ALL SELECT query_id, n || 'Handler', 1 FROM er UNION ALL SELECT query_id, category, 2 FROM er WHERE category <> 'general'),
f AS (SELECT query_id, name, min(step) AS step FROM tk JOIN hp ON contains(lower(body), lower(token)) WHERE token IS NOT NULL GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY step, name) AS INTEGER) AS rank FROM f) SELECT query_id, rank, name FROM r WHERE rank <= 5""")
def g7(spark, d):
    rows = spark.createDataFrame(HELP, "name string, body string")
    return catalog.error_matches(catalog.error_features(errors(spark, d), "shop."), rows, ["body"])


ITEMS = "it AS (SELECT p_type AS kind, p_name || CAST(p_partkey % 400 AS VARCHAR) AS name, CASE WHEN p_partkey % 9 = 0 THEN 'Shop.' ELSE 'shop.' END || 'Part' || CAST(p_partkey AS VARCHAR) AS fqcn, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) + CASE WHEN p_partkey % 100 = 50 THEN 1 ELSE 0 END AS ord FROM part)"


@query("g8_catalog_checks", f"""WITH {ITEMS}, pl AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ord, name) AS place FROM it)
SELECT kind, name, 'class name' AS problem FROM it WHERE NOT regexp_matches(fqcn, '^[a-z][a-z0-9]*(\\.[a-z][a-z0-9_]*)*\\.[A-Z][A-Za-z0-9_$]*$') UNION ALL SELECT kind, name, 'repeated name' FROM it GROUP BY kind, name HAVING count(*) > 1 UNION ALL SELECT kind, name, 'order' FROM pl WHERE place <> ord""")
def g8(spark, d):
    order = F.row_number().over(W.partitionBy("p_type").orderBy("p_partkey")) + F.when(F.col("p_partkey") % 100 == 50, 1).otherwise(0)
    rows = table(spark, d, "part").select(F.col("p_type").alias("kind"), F.concat("p_name", (F.col("p_partkey") % 400).cast("string")).alias("name"), F.concat(F.when(F.col("p_partkey") % 9 == 0, "Shop.").otherwise("shop."), F.lit("Part"), F.col("p_partkey").cast("string")).alias("fqcn"), order.alias("ord"))
    return catalog.violations(rows)


CATALOGS = "p_brand || '/' || CAST(p_partkey // 1000 AS VARCHAR)"


@query("s7_flatten_catalog", f"""SELECT {CATALOGS} AS catalog, 'brand' AS section, p_name AS name, 'shop.Part' || p_partkey AS fqcn, CAST(NULL AS VARCHAR) AS description, p_type AS usage, CAST(NULL AS VARCHAR) AS source_url, CAST(NULL AS VARCHAR) AS error FROM part
UNION ALL SELECT DISTINCT {CATALOGS}, 'brand', 'brand', NULL, p_brand, NULL, NULL, NULL FROM part""")
def s7(spark, d):
    """A catalogue for each brand and thousand of part keys."""
    item = F.struct(F.col("p_name").alias("name"), F.concat(F.lit("shop.Part"), "p_partkey").alias("fqcn"), F.col("p_type").alias("example"))
    part = F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / 1000).cast("string")).alias("catalog")
    rows = table(spark, d, "part").groupBy(part).agg(F.to_json(F.struct(F.struct(F.first("p_brand").alias("description"), F.sort_array(F.collect_list(item)).alias("parts")).alias("brand"))).alias("body"))
    return catalog.flattened(rows)


QUEUES = "queues AS (SELECT user_id AS queue, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, event_type AS name FROM events)"


def queues(spark, d):
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select(F.col("user_id").alias("queue"), pos.alias("pos"), F.col("event_type").alias("name"))


TYPE_RULES = [(["purchase", "error"], "shop"), (["signup"], "new"), (["click"], "web")]
KINDS = f"{QUEUES}, nm AS (SELECT queue, list_distinct(list(name)) AS names FROM queues GROUP BY queue), kinds AS (SELECT queue, CASE WHEN list_contains(names, 'purchase') AND list_contains(names, 'error') THEN 'shop' WHEN list_contains(names, 'signup') THEN 'new' WHEN list_contains(names, 'click') THEN 'web' END AS app_type FROM nm)"


@query("x1_xml_names", """SELECT page_id AS queue, unnest(range(0, len(m)))::INTEGER AS pos, list_last(string_split(unnest(m), '.')) AS name FROM (SELECT page_id, regexp_extract_all(html, 'class\\s*=\\s*"([^"]+)"', 1) AS m FROM pages) WHERE len(m) > 0""")
def x1(spark, d):
    return scan.xml_names(table(spark, d, "pages").select(F.col("page_id").alias("queue"), F.col("html").alias("body")))


@query("x2_application_types", f"WITH {KINDS} SELECT queue, app_type FROM kinds")
def x2(spark, d):
    return scan.application_types(queues(spark, d), TYPE_RULES)


REQUIRED = [("shop", "view", True), ("shop", "refund", True), ("shop", "click", False), ("new", "signup", True), ("new", "login", True)]


@query("x3_missing_entries", f"""WITH {KINDS}, en AS (SELECT * FROM (VALUES ('shop','view',true),('shop','refund',true),('shop','click',false),('new','signup',true),('new','login',true)) t(app_type, name, required))
SELECT k.queue, en.name FROM kinds k JOIN en ON en.app_type = k.app_type AND required WHERE NOT EXISTS (SELECT 1 FROM queues q WHERE q.queue = k.queue AND q.name = en.name) UNION ALL SELECT queue, NULL FROM kinds WHERE app_type IS NULL OR app_type NOT IN (SELECT app_type FROM en)""")
def x3(spark, d):
    rows = queues(spark, d)
    return scan.missing(rows, scan.application_types(rows, TYPE_RULES), spark.createDataFrame(REQUIRED, "app_type string, name string, required boolean"))


ORDER_RULES = [("view", ["click"], []), ("purchase", [], ["view", "click"]), ("error", ["purchase", "signup"], ["click"])]


def order_rules(spark):
    return spark.createDataFrame(ORDER_RULES, "name string, must_before array<string>, must_after array<string>")


@query("x4_order_violations", f"""WITH {QUEUES}, l AS (SELECT queue, name, max(pos) AS pos FROM queues GROUP BY ALL), r AS (SELECT * FROM (VALUES ('view','before','click'),('purchase','after','view'),('purchase','after','click'),('error','before','purchase'),('error','before','signup'),('error','after','click')) t(name, kind, target))
SELECT a.queue, a.name, kind, target FROM l a JOIN r ON r.name = a.name JOIN l b ON b.queue = a.queue AND b.name = target WHERE CASE WHEN kind = 'before' THEN a.pos >= b.pos ELSE a.pos <= b.pos END""")
def x4(spark, d):
    return scan.order_violations(queues(spark, d), order_rules(spark))


@query("x5_incompatible", f"WITH {QUEUES}, n AS (SELECT DISTINCT queue, name FROM queues) SELECT DISTINCT a.queue, 'error' AS name, b.name AS target FROM n a JOIN n b ON a.queue = b.queue WHERE a.name = 'error' AND b.name IN ('purchase', 'signup')")
def x5(spark, d):
    rules = spark.createDataFrame([("error", ["purchase", "signup"]), ("purchase", ["error"])], "name string, incompatible_with array<string>")
    return scan.incompatible(queues(spark, d), rules)


ABSENT = [("SEC-1", "security", "high", ["shop", "web"], ["signup"], "signup"), ("SEC-2", "security", "medium", ["shop"], ["login", "token"], "login")]
DEVELOPMENT = [("SEC-5", "security", "medium", ["shop"], ["error"])]
SECURITY = f"""{KINDS}, sec AS (SELECT queue, 'SEC-1' AS rule_id, 'security' AS concern, 'high' AS severity, 'signup' AS name FROM kinds JOIN nm USING (queue) WHERE app_type IN ('shop', 'web') AND NOT list_contains(names, 'signup')
UNION ALL SELECT queue, 'SEC-2', 'security', 'medium', 'login' FROM kinds JOIN nm USING (queue) WHERE app_type = 'shop' AND NOT list_has_any(names, ['login', 'token'])
UNION ALL SELECT queue, 'SEC-5', 'security', 'medium', 'error' FROM kinds JOIN nm USING (queue) WHERE app_type = 'shop' AND list_contains(names, 'error'))"""
PERFORMANCE = """rep AS (SELECT queue, 'PERF-2' AS rule_id, 'performance' AS concern, 'medium' AS severity, name FROM queues GROUP BY queue, name HAVING count(*) > 1),
perf AS (SELECT * FROM rep UNION ALL SELECT queue, 'PERF-1', 'performance', 'medium', 'error' FROM nm WHERE list_contains(names, 'error') AND NOT EXISTS (SELECT 1 FROM rep WHERE rep.queue = nm.queue AND rep.name = 'error')
UNION ALL SELECT queue, 'PERF-5', 'performance', 'low', 'view' FROM nm WHERE list_contains(names, 'view'))"""


def _security(spark, d):
    rows = queues(spark, d)
    kinds = scan.application_types(rows, TYPE_RULES)
    absent = spark.createDataFrame(ABSENT, "rule_id string, concern string, severity string, app_types array<string>, names array<string>, report string")
    leftover = spark.createDataFrame(DEVELOPMENT, "rule_id string, concern string, severity string, app_types array<string>, names array<string>")
    return scan.absent(rows, kinds, absent).unionByName(scan.present(rows, kinds, leftover))


def _performance(spark, d):
    rows = queues(spark, d)
    kinds = scan.application_types(rows, TYPE_RULES)
    rules = spark.createDataFrame([("PERF-1", "performance", "medium", None, ["error"]), ("PERF-5", "performance", "low", None, ["view"])], "rule_id string, concern string, severity string, app_types array<string>, names array<string>")
    twice = scan.repeated(rows, "PERF-2")
    some = scan.present(rows, kinds, rules)
    return twice.unionByName(scan.without_reported(some.filter("rule_id = 'PERF-1'"), twice)).unionByName(some.filter("rule_id = 'PERF-5'"))


@query("x6_security_rules", f"WITH {SECURITY} SELECT * FROM sec")
def x6(spark, d):
    return _security(spark, d)


@query("x7_performance_rules", f"WITH {KINDS}, {PERFORMANCE} SELECT * FROM perf")
def x7(spark, d):
    return _performance(spark, d)


@query("x8_findings_report", f"WITH {SECURITY}, {PERFORMANCE}, al AS (SELECT * FROM sec UNION ALL SELECT * FROM perf) SELECT concern, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM al GROUP BY concern")
def x8(spark, d):
    return scan.report(_security(spark, d).unionByName(_performance(spark, d)))


@query("x8_ordered_findings", f"WITH {SECURITY}, {PERFORMANCE}, al AS (SELECT * FROM sec UNION ALL SELECT * FROM perf) SELECT *, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank FROM al")
def x8_ordered(spark, d):
    return scan.ordered(_security(spark, d).unionByName(_performance(spark, d)))


@query("x9_queue_repair")
def x9(spark, d):
    return scan.repair(queues(spark, d), {"view": ["click"]}, {"purchase": ["view"]}, [("login", "click"), ("logout", None)])


MIGRATION = [("MR-1", "namespace", r"token = "), ("MR-2", "api_removal", r"\+1 \(\d+\)"), ("MR-3", "api_change", r"License, (?!version)"), ("MR-4", "namespace", r"rights\s+reserved")]


def _found(spark, d, scope="full"):
    return scan.migration(table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("body")), MIGRATION, scope)


def found_sql(rule, category, pattern, sure="true"):
    """Matches of a pattern with their lines; `sure` is a condition on the text after a match, `rest`."""
    return f"""SELECT file, '{rule}' AS rule_id, '{category}' AS category, m[j] AS found, CAST(1 + length(pre) - length(replace(pre, chr(10), '')) AS INTEGER) AS line
FROM (SELECT file, m, j, array_to_string(list_concat(p[1:j], m[1:j - 1]), '') AS pre, p[j + 1] AS rest FROM (SELECT CAST(doc_id AS VARCHAR) AS file, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS j FROM documents)) WHERE {sure}"""


@query("x10_migration_scan", " UNION ALL ".join([found_sql(*r) for r in MIGRATION if r[0] != "MR-3"] + [found_sql("MR-3", "api_change", "License, ", "NOT starts_with(rest, 'version')")]))
def x10(spark, d):
    return _found(spark, d)


@query("x10_migration_counts", r"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS file, len(regexp_extract_all(text, 'token = ')) AS a, len(regexp_extract_all(text, 'rights\s+reserved')) AS b FROM documents) SELECT file, 'MR-1' AS rule_id, a AS n FROM c WHERE a > 0 UNION ALL SELECT file, 'MR-4', b FROM c WHERE b > 0""")
def x10_counts(spark, d):
    return _found(spark, d, "namespace").groupBy("file", "rule_id").agg(F.count("*").alias("n"))


CODE = r"""CASE WHEN regexp_matches(t, '^<(\?xml|project|component|list)') THEN CASE WHEN contains(t, '<dependency>') OR contains(t, '<artifactId>') THEN 'POM' ELSE 'XML' END
WHEN NOT contains(t, '{') AND NOT contains(t, 'import') AND len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[\w.]+\s*='))) > 0 AND len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[\w.]+\s*='))) >= floor(len(string_split(t, chr(10))) / 2) THEN 'PROPERTIES' ELSE 'JAVA' END"""


@query("x11_code_type", f"WITH u AS (SELECT 'document' AS tbl, doc_id AS id, trim(text) AS t FROM documents UNION ALL SELECT 'page', page_id, trim(html) FROM pages UNION ALL SELECT 'part', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'name=' || p_name || chr(10) || 'size = ' || CAST(p_size AS VARCHAR) ELSE '<project><artifactId>' || p_name || '</artifactId></project>' END FROM part) SELECT tbl, id, {CODE} AS kind FROM u")
def x11(spark, d):
    rows = table(spark, d, "documents").select(F.lit("document").alias("tbl"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    rows = rows.unionByName(table(spark, d, "pages").select(F.lit("page").alias("tbl"), F.col("page_id").alias("id"), F.col("html").alias("t")))
    made = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("name="), "p_name", F.lit("\nsize = "), "p_size")).otherwise(F.concat(F.lit("<project><artifactId>"), "p_name", F.lit("</artifactId></project>")))
    rows = rows.unionByName(table(spark, d, "part").select(F.lit("part").alias("tbl"), F.col("p_partkey").alias("id"), made.alias("t")))
    return rows.select("tbl", "id", X.code_type(F.col("t")).alias("kind"))


@query("x12_versions", "WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.1.2' WHEN 1 THEN CAST(p_size AS VARCHAR) || '.x' WHEN 2 THEN '' ELSE CAST(p_size AS VARCHAR) END AS version, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.1' WHEN 2 THEN '5' ELSE CAST(p_size AS VARCHAR) END AS normal FROM part) SELECT p_partkey, CASE WHEN normal IN ('5', '6', '5.1', '7.1') THEN normal END AS version FROM v")
def x12(spark, d):
    size, n = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    version = F.when(n == 0, F.concat(size, F.lit(".1.2"))).when(n == 1, F.concat(size, F.lit(".x"))).when(n == 2, "").otherwise(size)
    return table(spark, d, "part").select("p_partkey", scan.supported(version, "5", ["5", "6", "5.1", "7.1"]).alias("version"))


@query("x13_migration_summary", r"""WITH c AS (SELECT sum(len(regexp_extract_all(text, 'token = '))) AS a, sum(len(regexp_extract_all(text, 'rights\s+reserved'))) AS b, sum(len(regexp_extract_all(text, '\+1 \(\d+\)'))) AS e FROM documents)
SELECT 'namespace' AS category, CAST(a + b AS BIGINT) AS issues, CAST(a AS BIGINT) AS automatic, CAST(b AS BIGINT) AS manual, CAST(a AS BIGINT) AS trivial, CAST(b AS BIGINT) AS moderate, 0::BIGINT AS major FROM c WHERE a + b > 0 UNION ALL SELECT 'api_removal', CAST(e AS BIGINT), 0, CAST(e AS BIGINT), 0, 0, CAST(e AS BIGINT) FROM c WHERE e > 0""")
def x13(spark, d):
    rules = [("MR-1", "namespace", True, "trivial"), ("MR-2", "api_removal", False, "major"), ("MR-4", "namespace", False, "moderate")]
    return scan.migration_summary(_found(spark, d), spark.createDataFrame(rules, "rule_id string, category string, auto_fixable boolean, effort string"))


@query("x14_placement", f"WITH {QUEUES}, n AS (SELECT *, count(*) OVER (PARTITION BY queue) AS length FROM queues) SELECT DISTINCT queue, name, CASE name WHEN 'signup' THEN 'must_be_outer' ELSE 'must_be_inner' END AS rule FROM n WHERE (name = 'signup' AND NOT pos * 2 < length) OR (name = 'purchase' AND pos * 2 < length)")
def x14(spark, d):
    return scan.misplaced(queues(spark, d), spark.createDataFrame([("signup", "must_be_outer"), ("purchase", "must_be_inner")], "name string, rule string"))


CALLS = "c AS (SELECT event_type AS tool, CASE WHEN event_type = 'error' THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS exception, value AS duration FROM events)"


def calls(spark, d):
    exception = F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select(F.col("event_type").alias("tool"), exception.alias("exception"), F.col("value").alias("duration"))


@query("l1_tool_totals", f"WITH {CALLS} SELECT tool, count(*) AS calls, count(exception) AS errors, round(sum(duration), 6) AS total, max(duration) AS most FROM c GROUP BY tool")
def l1_totals(spark, d):
    return scan.tool_totals(calls(spark, d))


@query("l1_tool_statistics", f"WITH {CALLS} SELECT tool, exception, count(*) AS calls, round(sum(duration), 6) AS total, max(duration) AS most FROM c GROUP BY ALL")
def l1(spark, d):
    return scan.tool_statistics(calls(spark, d))


def _days(spark, d):
    """Sketches of two parts of the events, kept apart and merged, as a second day's run would."""
    rows = table(spark, d, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("name"), F.col("value").alias("duration"), "user_id")
    late = F.col("user_id") % 2 == 0
    return latency.added(latency.kept(rows.filter(~late | late.isNull())), latency.kept(rows.filter(late)))


SINCE, UNTIL = "2024-01-05", "2024-01-20"


@query("l1_latency_periods")
def l1_latency(spark, d):
    return latency.period(_days(spark, d), SINCE, UNTIL)


@query("l1_period_totals", f"""SELECT event_type AS name, count(*) AS calls, count(value) AS timed, round(round(avg(value), 12), 6) AS mean, max(value) AS most
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' GROUP BY event_type""")
def l1_period(spark, d):
    return latency.period(_days(spark, d), SINCE, UNTIL).select("name", "calls", "timed", F.round(X.steady(F.col("mean")), 6).alias("mean"), "most")


@query("l2_log_rows", "SELECT conv_id * 1000 + turn AS id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...(truncated)' ELSE text END AS parameters, CAST(strlen(text) AS INTEGER) AS response_bytes FROM conversations")
def l2(spark, d):
    return scan.log_rows(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("parameters"), F.col("text").alias("response")))
