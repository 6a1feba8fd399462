"""Queries without SQL, over whole tables, against the plain versions of `plain`, which share no code with the library."""

import json
import re
import zlib
from collections import Counter

from inkwell.operators import scan
from inkwell.operators import words as V
from inkwell.plans import registry, rules
from inkwell.plans.views import table

from .plain import chunks_of, plain_text_of, sections_of

KINDS = ["HTML", "MARKDOWN", "TEXT", "JAVA", "JAVADOC", "XML"]
LIMITS = {"JAVA": (512, 0), "JAVADOC": (None,), "XML": (None,)}


def documents(spark, sf):
    return [(r["doc_id"], r["text"], KINDS[r["doc_id"] % 6], r["source"], r["lang"]) for r in table(spark, sf, "documents").collect()]


def plain_chunks(text, kind):
    return [] if text is None else chunks_of(text, *LIMITS.get(kind, (512, 128)))


def test_c3_chunks(spark, sf):
    want = Counter((key, kind, i, len(made), part) for key, text, kind, *_ in documents(spark, sf) for made in [plain_chunks(text, kind)] for i, part in enumerate(made))
    got = registry.QUERIES["c3_chunks"](spark, sf).select("id", "content_type", "chunk_index", "total_chunks", "content")
    assert Counter(map(tuple, got.collect())) == want and sum(row[3] > 1 for row in want) > 100


def test_c7_metadata(spark, sf):
    want = Counter()
    for key, text, kind, source, lang in documents(spark, sf):
        made = plain_chunks(text, kind)
        for i in range(len(made)):
            meta = {"source": source, "language": lang, "content_type": kind, "chunk_index": str(i), "total_chunks": str(len(made))}
            want[key, i, json.dumps({k: v for k, v in meta.items() if v is not None}, sort_keys=True)] += 1
    got = registry.QUERIES["c7_chunk_metadata"](spark, sf).select("id", "chunk_index", "metadata").collect()
    assert Counter((r[0], r[1], json.dumps({k: v for k, v in json.loads(r[2]).items() if v is not None}, sort_keys=True)) for r in got) == want


def test_c9_quality(spark, sf):
    own = {k: [] for k in KINDS}
    for _, text, kind, *_ in documents(spark, sf):
        own[kind].append((text, plain_chunks(text, kind)))
    for r in registry.QUERIES["c9_chunk_quality"](spark, sf).collect():
        tokens = [len(c) / 4 for _, made in own[r["content_type"]] for c in made]
        assert (r["documents"], r["chunks"]) == (len(own[r["content_type"]]), len(tokens))
        assert (r["with_chunks"], r["too_short"]) == (sum(bool(m) for _, m in own[r["content_type"]]), sum(len(t) < 50 for t, _ in own[r["content_type"]]))
        assert [r["to_128"], r["to_256"], r["to_512"], r["above_512"]] == [sum(lo <= t < hi for t in tokens) for lo, hi in ((0, 128), (128, 256), (256, 512), (512, 1e9))]
        assert r["mean_tokens"] == round(sum(tokens) / len(tokens), 6)


def test_p1_sections(spark, sf):
    want = Counter((r["url"], i, content) for r in table(spark, sf, "pages").collect() for i, content in enumerate(sections_of(r["html"])))
    got = registry.QUERIES["p1_html_sections"](spark, sf)
    assert got.filter("error IS NOT NULL").count() == 0
    assert Counter(map(tuple, got.select("key", "section", "content").collect())) == want


def test_p2_text(spark, sf):
    want = {r["url"]: plain_text_of(r["html"]) for r in table(spark, sf, "pages").collect()}
    got = {r["key"]: r["text"] for r in registry.QUERIES["p2_html_text"](spark, sf).collect()}
    assert got == {url: text for url, text in want.items() if len(text) >= 50}


def test_e1_vectors(spark, sf):
    for r in registry.QUERIES["e1_embed"](spark, sf).sample(0.3, 1).collect():
        want = Counter(zlib.crc32(r["content"][i : i + 3].encode()) % 64 for i in range(len(r["content"]) - 2))
        assert r["vector"] == [float(want[k]) for k in range(64)]


def test_x9_repaired_orders(spark, sf):
    """Queues against a plain search: names as they first stand, wanted ones put in, then moved until both rules hold."""
    first = {}
    for r in rules.queues(spark, sf).orderBy("queue", "pos").collect():
        if r["name"] is not None:
            first.setdefault(r["queue"], {}).setdefault(r["name"], r["pos"])
    got = {}
    for r in registry.QUERIES["x9_queue_repair"](spark, sf).orderBy("queue", "pos").collect():
        got.setdefault(r["queue"], []).append(r["name"])
    assert got.keys() == first.keys()
    for queue, names in first.items():
        order, made = sorted(names, key=names.get), got[queue]
        assert sorted(made) == sorted({*order, "login", "logout"})
        if "view" in made and "click" in made:
            assert made.index("view") < made.index("click")
        if "purchase" in made and "view" in made:
            assert made.index("purchase") > made.index("view")
        # names that no rule moves keep their order
        free = [n for n in order if n not in ("view", "click", "purchase", "login", "logout")]
        assert [n for n in made if n in free] == free


def test_x10_with_any_patterns(spark):
    """Findings equal those of every rule run over every text, for patterns on other than ASCII text too."""
    patterns = [r"import \w", r"\bé\w+", r"(?i)straße", r"(?P<n>a+)b", r"(?P<n>x)(?P=n)", r"a|b", r"colou?r", r"[^\x00-\x7f]", r"ab{2,}c", r"(?:token) = \d", r"", r"(a)\1", r"K", r"(?i:k)elvin", r"\.\*"]
    found = [(f"R{i}", "c", p) for i, p in enumerate(patterns)] + [(f"W{i}", "c", f"word{i}x") for i in range(3_000)]
    bodies = ["import é.b", "élan été", "STRASSE straße Straße", "aaab xx\nb color", "abbbc token = 1", "", "\u212aelvin kelvin Kelvin ſ", "word17x word2999x .*", "日本語 import 日", None]
    files = spark.createDataFrame(list(enumerate(bodies)), "file int, body string")
    want = Counter((str(f), i, "c", m[0], b.count("\n", 0, m.start()) + 1) for f, b in enumerate(bodies) if b is not None for i, _, p in found for m in re.finditer(p, b))
    assert Counter(map(tuple, scan.migration(files, found).collect())) == want
    assert scan.migration(files.limit(0), found).count() == 0


def test_literals_stand_in_every_match():
    assert [scan.literal(p) for p in ("abc", "ab?c", r"x\.y+z", "a|b", "(?i)abc", "(?:abc)+", "^abc$", "", "a(?i:b)cde")] == ["abc", "a", "x.", None, None, None, "abc", None, None]


def test_any_number_of_words_patterns_and_settings(spark, sf, monkeypatch):
    """Results are the same whether rules go to every task or meet the rows in blocks and by joins."""
    names = ("g5_error_category", "g4_recommend", "g7_error_matches", "q4_suggested_filters", "g1_catalog_search", "r9_parameter_sweep")
    whole = {n: Counter(map(str, registry.QUERIES[n](spark, sf).collect())) for n in names}
    monkeypatch.setattr(V, "RULES", 2)
    monkeypatch.setattr(V, "AUTOMATON_BYTES", 0)
    for n, rows in whole.items():
        assert Counter(map(str, registry.QUERIES[n](spark, sf).collect())) == rows, n
