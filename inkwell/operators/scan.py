"""Rule scans over ordered configurations and source text, and the run log.

Queues are tables (queue, pos, name), where rows without a queue or name meet no rule; rules are small tables, joined by
equality, which Spark broadcasts by their measured size. Everything is keyed by queue or file; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import words as V

CLASS_ATTRIBUTE = r'class\s*=\s*"([^"]+)"'
SEVERITIES = ("high", "medium", "low")


def xml_names(files: DataFrame, pattern: str = CLASS_ATTRIBUTE) -> DataFrame:
    """(queue, pos, name): the last dotted part of every class attribute, in text order from 0."""
    each = files.select("queue", F.posexplode(F.regexp_extract_all("body", F.lit(pattern), F.lit(1))).alias("pos", "class"))
    return each.select("queue", "pos", F.element_at(F.split("class", r"\."), -1).alias("name"))


def application_types(queues: DataFrame, rules: list[tuple[list[str], str]]) -> DataFrame:
    """(queue, app_type): the first rule whose names a queue all holds; null without one."""
    names = queues.groupBy("queue").agg(F.collect_set("name").alias("names"))
    out = F.lit(None).cast("string")
    for needed, kind in reversed(rules):
        held = F.lit(True)
        for n in needed:
            held &= F.array_contains("names", n)
        out = F.when(held, kind).otherwise(out)
    return names.select("queue", out.alias("app_type"))


def missing(queues: DataFrame, kinds: DataFrame, entries: DataFrame) -> DataFrame:
    """(queue, name) of required entries of the queue's type that it lacks; a type without entries gives name null, an error row."""
    required = entries.filter("required").select("app_type", "name")
    known = entries.select("app_type").distinct()
    lacking = kinds.join(required, "app_type").join(queues.select("queue", "name").distinct(), ["queue", "name"], "left_anti").select("queue", "name")
    unknown = kinds.join(known, "app_type", "left_anti").select("queue", F.lit(None).cast("string").alias("name"))
    return lacking.unionByName(unknown)


def _last(queues: DataFrame) -> DataFrame:
    return queues.groupBy("queue", "name").agg(F.max("pos").alias("pos"))


def order_violations(queues: DataFrame, rules: DataFrame) -> DataFrame:
    """(queue, name, kind, target) where both stand and name isn't before, or after, its target; last places count.

    rules: name, must_before and must_after arrays. Queues are first reduced to distinct names.
    """
    last = _last(queues)
    pairs = rules.select("name", F.lit("before").alias("kind"), F.explode("must_before").alias("target")).unionByName(rules.select("name", F.lit("after").alias("kind"), F.explode("must_after").alias("target"))).distinct()
    own = last.join(pairs, "name").withColumnRenamed("pos", "own")
    both = own.join(last.select("queue", F.col("name").alias("target"), F.col("pos").alias("other")), ["queue", "target"])
    broken = F.when(F.col("kind") == "before", F.col("own") >= F.col("other")).otherwise(F.col("own") <= F.col("other"))
    return both.filter(broken).select("queue", "name", "kind", "target").distinct()


def incompatible(queues: DataFrame, rules: DataFrame) -> DataFrame:
    """(queue, name, target) where a queue holds both sides of a pair; each pair once."""
    names = queues.select("queue", "name").distinct()
    pairs = rules.select("name", F.explode("incompatible_with").alias("target"))
    hit = names.join(pairs, "name").join(names.select("queue", F.col("name").alias("target")), ["queue", "target"])
    return hit.select("queue", F.least("name", "target").alias("name"), F.greatest("name", "target").alias("target")).distinct()


def absent(queues: DataFrame, kinds: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of rules (rule_id, concern, severity, app_types, names, report): a queue of these types holds none of the names."""
    rule = rules.select("rule_id", "concern", "severity", "app_types", "names", "report")
    scope = kinds.join(rule.withColumn("app_type", F.explode(F.array_distinct("app_types"))), "app_type")
    held = queues.groupBy("queue").agg(F.collect_set("name").alias("have"))
    return scope.join(held, "queue").filter(~F.arrays_overlap("names", "have")).select("queue", "rule_id", "concern", "severity", F.col("report").alias("name"))


def present(queues: DataFrame, kinds: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of rules (rule_id, concern, severity, app_types or null, names): a queue of these types holds a name."""
    rule = rules.select("rule_id", "concern", "severity", "app_types", F.explode("names").alias("name"))
    scope = queues.select("queue", "name").distinct().join(kinds, "queue").join(rule, "name")
    return scope.filter(F.col("app_types").isNull() | F.array_contains("app_types", F.col("app_type"))).select("queue", "rule_id", "concern", "severity", "name")


def repeated(queues: DataFrame, rule_id: str) -> DataFrame:
    twice = queues.groupBy("queue", "name").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.select("queue", F.lit(rule_id).alias("rule_id"), F.lit("performance").alias("concern"), F.lit("medium").alias("severity"), "name")


def without_reported(findings: DataFrame, reported: DataFrame) -> DataFrame:
    """findings whose (queue, name) isn't reported yet."""
    return findings.join(reported.select("queue", "name").distinct(), ["queue", "name"], "left_anti").select("queue", "rule_id", "concern", "severity", "name")


def report(findings: DataFrame) -> DataFrame:
    """Findings of each concern by severity."""
    return findings.groupBy("concern").pivot("severity", list(SEVERITIES)).count().fillna(0)


def ordered(findings: DataFrame) -> DataFrame:
    """findings with severity_rank (1 high, 2 medium, 3 low), sorted by it, rule, queue and name; the rank keeps the order
    of the report when rows are written."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int")
    return findings.withColumn("severity_rank", rank).orderBy("severity_rank", "rule_id", "queue", "name")


def misplaced(queues: DataFrame, rules: DataFrame) -> DataFrame:
    """(queue, name, rule): must_be_outer entries outside the first half of their queue, must_be_inner outside the second."""
    length = F.count("*").over(W.partitionBy("queue"))
    placed = queues.withColumn("length", length).join(rules.select("name", "rule"), "name")
    outer = F.col("pos") * 2 < F.col("length")
    return placed.filter(((F.col("rule") == "must_be_outer") & ~outer) | ((F.col("rule") == "must_be_inner") & outer)).select("queue", "name", "rule").distinct()


def repaired_order(names: list[str], before: dict[str, list[str]], after: dict[str, list[str]]) -> list[str]:
    """Move one offending entry at a time next to its target until the rules hold, at most twice as often as entries."""
    names = list(names)

    def offender():
        place = {n: i for i, n in enumerate(names)}
        for i, n in enumerate(names):
            for t in before.get(n, ()):
                if t in place and i >= place[t] and t != n:
                    return i, place[t]
            for t in after.get(n, ()):
                if t in place and i <= place[t] and t != n:
                    return i, place[t]
        return None

    for _ in range(2 * len(names)):
        move = offender()
        if move is None:
            break
        at, to = move
        names.insert(to, names.pop(at))
    return names


def inserted(names: list[str], wanted: list[tuple[str, str | None]]) -> list[str]:
    """names with each wanted entry that they lack: after the entry named with it, at the end without one."""
    names = list(names)
    for name, after in wanted:
        if name not in names:
            names.insert(names.index(after) + 1 if after in names else len(names), name)
    return names


def repair(queues: DataFrame, before: dict[str, list[str]], after: dict[str, list[str]], wanted: list[tuple[str, str | None]] = ()) -> DataFrame:
    """(queue, pos, name) after inserting the wanted entries and repairing the order.

    A queue is reduced to distinct names by an aggregate first, so a group is small. Null names take no part; null
    queues are one queue.
    """
    first = queues.filter("name IS NOT NULL").groupBy("queue", "name").agg(F.min("pos").alias("pos"))
    kind = queues.schema["queue"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        names = repaired_order(inserted(table.sort_by([("pos", "ascending"), ("name", "ascending")])["name"].to_pylist(), wanted), before, after)
        queue = table["queue"].slice(0, 1).to_pylist() * len(names)
        return pa.table({"queue": pa.array(queue, table.schema.field("queue").type), "pos": pa.array(range(len(names)), pa.int32()), "name": pa.array(names, pa.string())})

    return first.groupBy("queue").applyInArrow(run, f"queue {kind}, pos int, name string")


FINDINGS = "file string, rule_id string, category string, found string, line int"


def literal(pattern: str) -> str | None:
    """The longest text that every match of a pattern holds, or None: the literals that stand in a row in its top level.

    A pattern that ignores case anywhere has none, since its letters match others of another case.
    """
    if re.compile(pattern).flags & re.IGNORECASE or re.search(r"\(\?[a-zA-Z]*i", pattern):
        return None
    runs, now = [""], ""
    for kind, value in re._parser.parse(pattern):
        now = now + chr(value) if str(kind) == "LITERAL" else ""
        runs.append(now)
    return max(runs, key=len) or None


def migration(files: DataFrame, rules: list[tuple[str, str, str]], scope: str = "full") -> DataFrame:
    """FINDINGS of files (file, body): every match of every rule (rule_id, category, pattern) in scope, with its line.

    Patterns are Python's. Scope is "full", a category, or the beginning of one. One automaton of the literals that the
    rules' matches hold goes over each body, and only rules whose literal is there, or that have none, are matched; so
    cost follows what is found and not the number of rules. Null bodies hold nothing.
    """
    used = [r for r in rules if scope == "full" or r[1].startswith(scope)]
    if not used:
        return files.sparkSession.createDataFrame([], FINDINGS)
    texts = [literal(p) for _, _, p in used]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(i, c, re.compile(p)) for i, c, p in used]
        machine, by_text = V.automaton(t for t in texts if t), {}
        for n, t in enumerate(texts):
            by_text.setdefault(t, []).append(n)
        for batch in batches:
            rows = []
            for f, b in zip(batch["file"], batch["body"]):
                hits = {None} | ({t for _, t in machine.iter(b)} if machine is not None and b else set())
                for n in sorted(n for t in hits for n in by_text.get(t, ())):
                    i, c, p = compiled[n]
                    rows += [(f, i, c, m[0], b.count("\n", 0, m.start()) + 1) for m in p.finditer(b)]
            yield pd.DataFrame(rows, columns=["file", "rule_id", "category", "found", "line"])

    return files.filter("body IS NOT NULL").select(F.col("file").cast("string").alias("file"), "body").mapInPandas(run, FINDINGS)


def migration_summary(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(category, issues, automatic, manual, trivial, moderate, major) of findings."""
    rows = found.drop("category").join(rules.select("rule_id", "category", "auto_fixable", "effort"), "rule_id")
    by_effort = [F.count_if(F.col("effort") == e).alias(e) for e in ("trivial", "moderate", "major")]
    return rows.groupBy("category").agg(F.count("*").alias("issues"), F.count_if(F.col("auto_fixable")).alias("automatic"), F.count_if(~F.col("auto_fixable")).alias("manual"), *by_effort)


def supported(version: Column, default: str, known: list[str]) -> Column:
    """The normal form of a version, null where it isn't a known one."""
    v = X.normal_version(version, default)
    return F.when(v.isin(known), v)


def tool_statistics(calls: DataFrame) -> DataFrame:
    """(tool, exception, calls, total, most): by tool and exception, null where a call had none."""
    return calls.groupBy("tool", "exception").agg(F.count("*").alias("calls"), F.round(F.sum("duration"), 6).alias("total"), F.max("duration").alias("most"))


def tool_totals(calls: DataFrame) -> DataFrame:
    """(tool, calls, errors, total, most): by tool, whatever the exception."""
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count("exception").alias("errors"), F.round(F.sum("duration"), 6).alias("total"), F.max("duration").alias("most"))


def log_rows(calls: DataFrame, most: int = 100) -> DataFrame:
    """(id, parameters, response_bytes): parameters cut for the log, and the response's size in UTF-8."""
    return calls.select("id", X.clipped(F.col("parameters"), most).alias("parameters"), F.octet_length("response").alias("response_bytes"))
