"""Periodic runs, language and importance resampling against brute force, on awkward rows and on held-out texts."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from inkwell.llm import importance, langid, runs
from inkwell.llm.common import table
from pyspark.sql import functions as F

from .conftest import edge_rows


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def plain_runs(w, least_words=24, least_periods=3):
    """Every maximal stretch by trying all periods at all starts, smallest periods first."""
    out = []
    for p in range(1, len(w) // least_periods + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            start, length = i, j - i + p
            if length >= max(least_words, least_periods * p):
                smallest = next(q for q in range(1, p + 1) if all(w[k] == w[k + q] for k in range(start, start + length - q)))
                if smallest == p:
                    out.append((start, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_all_periods_tried():
    rnd = random.Random(5)
    seen = 0
    for k in range(1500):
        letters = rnd.choice(["a", "ab", "abc", "abcdefgh"])
        w = [rnd.choice(letters).encode() for _ in range(rnd.randrange(70))]
        for _ in range(rnd.randrange(3)):
            at, p = rnd.randrange(len(w) + 1), rnd.randrange(1, 12)
            w[at:at] = [rnd.choice("abcdefgh").encode() for _ in range(p)] * rnd.randrange(2, 9)
        want = plain_runs(w)
        seen += len(want)
        assert runs.runs(w) == want
        assert runs.runs(w, 6, 2) == plain_runs(w, 6, 2)
    assert seen > 500


def test_runs_of_awkward_words():
    assert runs.runs([]) == runs.runs([b"a"] * 23) == []
    assert runs.runs([b"a"] * 24) == [(0, 24, 1)]
    long = [b"x%d" % (i % 7) for i in range(30_000)]
    assert runs.runs(long) == [(0, 30_000, 7)] and runs.kept(long, [(0, 30_000, 7)]) == long[:7]
    fibonacci = [b"a", b"ab"]
    while len(fibonacci[-1]) < 3_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    w = [bytes([c]) for c in fibonacci[-1][:1500]]
    assert runs.runs(w, 12, 2) == plain_runs(w, 12, 2) and runs.runs(w) == plain_runs(w)
    thue = [bytes([bin(i).count("1") % 2]) for i in range(4096)]
    assert runs.runs(thue) == []


def plain_detected(key, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
    four = (*top, math.floor(Fraction(1000 * top[1], top[2]))) if top else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (key, len(found), *four, sha(lines.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_op11_on_awkward_rows(spark, edge):
    rows = [(k, t) for k, t, *_ in edge_rows() if t is None or len(t) < 100_000]
    got = runs.op11_runs(spark, edge).filter("n_words < 20000").select(*RUN_COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(plain_detected(*r) for r in rows)
    (long,) = runs.op11_runs(spark, edge).filter("n_words >= 20000").select("n_runs", "start", "length", "period").distinct().collect()
    assert tuple(long) == (1, 0, 30_000, 1)


def test_op11_on_whole_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    want = Counter(plain_detected(*r) for r in docs if len(r["text"]) < 6_000)
    got = runs.op11_runs(spark, sf).join(table(spark, sf, "documents").filter("length(text) < 6000").select("doc_id"), "doc_id")
    assert Counter(map(tuple, got.select(*RUN_COLUMNS).collect())) == want
    assert sum(n for row, n in want.items() if row[1]) > 5


def test_forward_backward_equals_all_labellings():
    rnd = np.random.default_rng(1)
    for kinds, sizes, block in ((2, [5, 1, 3], 2), (3, [4, 6], 3), (3, [1], 4), (2, [9], 1), (4, [4, 2], 64)):
        e, a, sizes = rnd.normal(size=(sum(sizes), kinds)), rnd.normal(size=(kinds, kinds)), np.array(sizes)
        got, at, logs, pairs = langid.forward_backward(e, sizes, a, True, block), 0, 0.0, np.zeros((kinds, kinds))
        for n in sizes.tolist():
            want, total = np.zeros((n, kinds)), 0.0
            for labels in itertools.product(range(kinds), repeat=n):
                weight = math.exp(sum(e[at + i, k] for i, k in enumerate(labels)) + sum(a[j, k] for j, k in zip(labels, labels[1:])))
                total += weight
                for i, k in enumerate(labels):
                    want[i, k] += weight
            for labels in itertools.product(range(kinds), repeat=n):
                weight = math.exp(sum(e[at + i, k] for i, k in enumerate(labels)) + sum(a[j, k] for j, k in zip(labels, labels[1:])))
                for j, k in zip(labels, labels[1:]):
                    pairs[j, k] += weight / total
            assert np.allclose(got.words[at : at + n], want / total)
            logs, at = logs + math.log(total), at + n
        assert np.allclose(got.transitions, pairs) and got.total == pytest.approx(logs)


def test_words_and_features_are_those_of_the_text():
    texts = ["Ein Wörtchen, zwei!", "", "12 ²³ a1b", "x" * 300 + " ñandú"]
    words = langid.split(texts)
    want = [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^\W\d_]+", t.lower()) if w.isalpha()]
    joined = "\n" + "\n".join(t.lower() for t in texts) + "\n"
    assert [(int(o), joined[s:e]) for o, s, e in zip(words.of, words.starts, words.ends)] == want
    one = langid.split(["a haus baum", "haus"])
    whole, affixes, letters, first = langid.hashed(one)
    assert whole[1] == whole[3] and (affixes[1] == affixes[3]).all() and len(set(whole.tolist())) == 3
    assert (affixes[0][1:4] == 0).all() and affixes[0][0] != 0 and np.diff([*first, len(letters)]).tolist() == [1, 4, 4, 4]


def test_languages_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    got = langid.op12_language(spark, sf)
    assert {tuple(r) for r in got.select("doc_id", "held_out").collect()} == {(r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in docs.select("doc_id").collect()}
    right = got.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] >= 0.97 and 0 <= right[1] <= right[2] <= 1


def test_held_out_languages_are_never_learned(spark, sf):
    """Languages of held-out documents, sources and other ids change no prediction."""
    docs = table(spark, sf, "documents")
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    one, two = langid.learned(docs), langid.learned(other)
    assert one.names == two.names == ["de", "en", "es", "fr"] and np.allclose(one.weights, two.weights)


def test_code_switched_text_has_segments(spark, sf):
    docs = table(spark, sf, "documents")
    pick = {r["lang"]: r["text"] for r in docs.filter("length(text) BETWEEN 300 AND 2000").orderBy("doc_id").collect()}
    model = langid.learned(docs)
    mixed = spark.createDataFrame([(1, pick["de"] + " 123 " + pick["en"]), (2, None), (3, "12 ²"), (None, pick["fr"]), (5, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in langid.identified(mixed, model).collect()}
    count = {lang: sum(s["words"] for s in got[1]["segments"] if s["lang"] == lang) for lang in ("de", "en")}
    assert sum(count.values()) >= 0.9 * got[1]["n_words"] and min(count.values()) > 20
    places = [(s["first"], s["words"]) for s in got[1]["segments"]]
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) == got[1]["n_words"]
    assert [(got[k]["lang_pred"], got[k]["score"], got[k]["segments"]) for k in (2, 3, 5)] == [("und", 0.0, [])] * 3 and got[None]["lang_pred"] == "fr"
    nobody = langid.learned(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identified(docs, nobody).collect()} == {"und"}


def test_op12_on_awkward_rows(spark, edge):
    got = langid.op12_language(spark, edge)
    rows = edge_rows()
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r[0] for r in rows)
    blank = {r[0] for r in rows if not re.search(r"[^\W\d_]", r[1] or "")}
    assert {r["doc_id"] for r in got.filter("lang_pred = 'und'").collect()} == blank


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def plain_draw(docs, target):
    own = [(k, *plain_features(t)) for k, t in docs]
    corpus, wanted = Counter(b for _, f, _ in own for b in f), Counter(b for t in target for b in plain_features(t)[0])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((corpus[b] + 1) * (t + 10_000)))) for b in corpus}
    rows = []
    for k, f, n in own:
        h = int(sha(f"42:{'' if k is None else k}".encode())[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    most = 5 * len(fit) // 100
    return Counter([(*r[:4], i + 1 if i < most else None) for i, r in enumerate(fit)] + [(*r[:4], None) for r in rows if r[4] < 20])


NAMES = ("doc_id", "n_features", "weight", "score", "rank")


def test_op13_on_whole_documents(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = plain_draw(docs, [r["text"] for r in table(spark, sf, "benchmark").collect()])
    assert Counter(map(tuple, importance.op13_importance(spark, sf).select(*NAMES).collect())) == want
    assert sum(r[4] is not None for r in want) > 5


def test_draw_on_awkward_rows(spark, edge):
    rows = [(k, t) for k, t, *_ in edge_rows()] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("score", F.lit("x")).withColumn("row", F.lit(1))
    target = spark.createDataFrame([("alpha beta gamma",), (None,)], "text string")
    assert Counter(map(tuple, importance.drawn(docs, target).collect())) == plain_draw(rows, ["alpha beta gamma", None])
    assert importance.drawn(docs.limit(0), target).count() == 0
    assert importance.drawn(docs, target.limit(0)).count() == len(rows)


def test_draw_has_every_rank_once_in_order(spark):
    rows = [(i, f"w{i % 7} " * 25) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = importance.drawn(docs, docs.limit(3), percent=50).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in got)
