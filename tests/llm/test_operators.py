"""The ten operators against brute force on small tables with awkward rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkwell.llm import bpe, licenses, media, mixing, pii, repeats, simhash, substrings, suffixes, topk, toxicity
from inkwell.llm.common import table
from inkwell.llm.queries import QUERIES

from .conftest import edge_rows


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def bag(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, bare, name):
    assert QUERIES[name](spark, bare).count() == 0


def test_media(spark, edge):
    want = Counter()
    for key, text, *_ in edge_rows():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(576, math.ceil(len(raw) / 576) * 576) - len(raw))
        want[key, len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(payload) // 24] += 1
    got = media.op1_media_columns(spark, edge)
    assert bag(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "height") == want
    by_payload = {}
    for r in got.collect():
        assert by_payload.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_png_is_lossless_and_readable():
    payload = bytes(random.Random(1).randrange(256) for _ in range(576 * 3))
    assert media.from_png(media.to_png(payload)) == payload


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            twice = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choice("aB1234.@+-() %_é\n0905") for _ in range(rnd.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("4111 1111 1111 1111") == [(0, 2, 19)]


def test_pii(spark, edge):
    want = Counter()
    for key, text, *_ in edge_rows():
        spans = plain_spans(text or "")
        want[(key, *(sum(k == i for _, k, _ in spans) for i in range(4)), sha(",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in spans).encode()))] += 1
    got = pii.op2_pii(spark, edge)
    assert bag(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_contexts_find_identifiers_that_no_pattern_finds(spark):
    seeds = [(i, f"please wire to account {4000000000000000 + x} today") for i, x in enumerate(range(2, 4000)) if pii.luhn(str(4000000000000000 + x))][:40]
    docs = spark.createDataFrame([*seeds, (900, "please wire to account 99887-7 today"), (901, "the year 20240101 was long")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["all"] for r in pii.identify(docs).collect()}
    assert [tuple(s) for s in got[900]] == [(23, 2, 30)] and got[901] == []
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert red[900] == "please wire to account [CARD] today" and red[901] == "the year 20240101 was long"


def hidden_identifiers(rnd):
    """(doc_id, text, hidden identifier or None): half the identifiers of two kinds have a shape that no pattern finds."""
    word = lambda n: " ".join(rnd.choice("alpha beta gamma delta omega the of and to".split()) for _ in range(n))
    rows = []
    for i in range(120):
        hidden = f"user{i}(at)intranet" if i % 2 else None
        rows.append((i, f"{word(5)} please mail me at {hidden or f'u{i}@host{i}.example.com'} for details {word(5)}", hidden))
    for i in range(120, 180):
        hidden = f"020 7946 {i:04d}" if i % 2 else None
        rows.append((i, f"{word(5)} ring us on {hidden or f'+1 (555) 010-{i:04d}'} before noon {word(5)} {i}", hidden))
    for i in range(180, 220):
        rows.append((i, f"he will mail me at home {word(20)} home alone, see you at noon on {i}", None))
    return rows


def test_held_out_identifiers_come_back(spark):
    """All hidden identifiers are found and nothing else is, though ordinary words stand in the same slots."""
    rows = hidden_identifiers(random.Random(1))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    docs = docs.unionByName(docs.filter("doc_id % 7 = 0"))
    found = {r["doc_id"]: {rows[r["doc_id"]][1][s["start"] : s["end"]] for s in r["all"]} - {rows[r["doc_id"]][1][s["start"] : s["end"]] for s in r["base"]} for r in pii.identify(docs).collect()}
    assert found == {i: {hidden} if hidden else set() for i, _, hidden in rows}


def test_contexts_without_regularity_find_nothing(spark, sf):
    """The corpus has its identifiers between random words, so no pattern is confident and only base spans stay."""
    docs = table(spark, sf, "documents")
    assert pii.bootstrap(docs.select("text"), pii.scan(docs))[0] is None
    for r in pii.op2_pii(spark, sf).join(docs, "doc_id").collect():
        assert r["spans"] == ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in plain_spans(r["text"] or ""))


def distinct_first(rows):
    """Rows in corpus order: by id, null last."""
    return sorted(((math.inf if k is None else k, i, (t or "").encode(), k) for i, (k, t, *_) in enumerate(rows)), key=lambda r: (r[0], r[1]))


def test_substrings(spark, edge):
    seen, want = set(), Counter()
    for _, _, raw, key in distinct_first(edge_rows()):
        words = raw.split()
        gone = set()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone.update(range(i, i + 20))
            seen.add(w)
        want[key, len(words), len(gone), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))] += 1
    assert bag(substrings.op3_substrings(spark, edge), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_suffixes(spark, edge):
    rows = [(k, (t or "").encode()) for k, t, *_ in edge_rows()]
    seen = Counter(hash(r[i : i + 200]) for _, r in rows for i in range(len(r) - 199))
    want = Counter()
    for key, raw in rows:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if seen[hash(raw[i : i + 200])] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = len(re.findall(b"\x01+", bytes(gone)))
        want[key, len(raw), sum(gone), runs, sha(bytes(b for b, g in zip(raw, gone) if not g))] += 1
    assert bag(suffixes.op5_suffixes(spark, edge), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_hot_anchors_give_the_same_result(spark, edge, monkeypatch):
    plain = bag(substrings.op3_substrings(spark, edge), "doc_id", "n_removed", "kept_sha256")
    monkeypatch.setattr(repeats, "LEVELS", ((0, 0), (2, 4), (5, 1 << 20)))
    assert bag(substrings.op3_substrings(spark, edge), "doc_id", "n_removed", "kept_sha256") == plain


def test_induced_sorting_in_little_memory():
    rnd = random.Random(5)
    for _ in range(150):
        window, letters, n = rnd.choice([8, 9, 16, 21]), rnd.choice([1, 2, 3, 5]), rnd.randrange(1, 250)
        text = [rnd.randrange(1, 1 + letters) for _ in range(n)]
        if n > 45:
            at = rnd.randrange(n - 40)
            text += text[at : at + 40]
        seen = Counter(tuple(text[i : i + window]) for i in range(len(text) - window + 1))
        want = [i for i in range(len(text) - window + 1) if seen[tuple(text[i : i + window])] > 1]
        found = suffixes.repeated(np.array(text), window, memory=rnd.choice([64, 1 << 20]))
        assert [i for i in np.flatnonzero(found).tolist() if i <= len(text) - window] == want


def test_automaton_streams_matching_statistics():
    rnd = random.Random(8)
    for _ in range(100):
        auto, seen = substrings.Automaton(), set()
        for _ in range(6):
            words = [b"ab"[x : x + 1] for x in (rnd.randrange(2) for _ in range(rnd.randrange(30)))]
            want = []
            for i in range(len(words) - 3):
                if tuple(words[i : i + 4]) in seen:
                    want.append(i)
                seen.add(tuple(words[i : i + 4]))
            assert auto.stream(words, 4) == want


def test_topk(spark, edge):
    vectors = []
    for r in table(spark, edge, "embeddings").collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((r["vec_id"], [math.floor(256 * x) for x in v]))
    assert len(vectors) > len({k for k, _ in vectors})
    want = Counter()
    for at, (q, own) in enumerate(vectors):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v)), k) for i, (k, v) in enumerate(vectors) if i != at)[:5]
            want.update((q, i, k, -s) for i, (s, k) in enumerate(best, 1))
    assert bag(topk.op4_topk(spark, edge), "query_id", "rank", "vec_id", "score") == want
    points = topk.integers(table(spark, edge, "embeddings"))
    small = topk.top_k(points, F.col("vec_id") % 50 == 0, shard_rows=9)
    assert bag(small, "query_id", "rank", "vec_id", "score") == want


def test_simhash(spark, edge):
    def fingerprint(raw):
        words = raw.lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = [(k, fingerprint((t or "").encode())) for k, t, *_ in edge_rows()]
    root = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    low = {r: min((k for (k, _), x in zip(rows, root) if x == r and k is not None), default=None) for r in set(root)}
    want = Counter((k, f"{f:016x}", low[r]) for (k, f), r in zip(rows, root))
    assert bag(simhash.op6_simhash(spark, edge), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("count", [1000, 1 << 23])
def test_chain_keys_lose_no_pair(count):
    """Any two fingerprints within four bits share a key whose start passes the chain test."""
    rnd = random.Random(4)
    m, keys = simhash.chain_keys(count)
    width = 64 // m
    for _ in range(2000):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(5)))
        part = lambda v, j: v >> (j * width) & ((1 << width) - 1)
        shared = [s for s, own in keys if all(part(a, j) == part(b, j) for j in own)]
        ok = simhash.passes(np.array([a] * len(shared), np.uint64), np.array([b] * len(shared), np.uint64), np.array(shared, np.int64), m, 4)
        assert ok.any()


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rnd = random.Random(6)
    fps = sorted({(1 << 40) ^ sum(1 << x for x in rnd.sample(range(30), rnd.randrange(4))) for _ in range(300)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    assert {r["root"] for r in simhash.components(simhash.links(nodes)).collect()} == {min(fps)}


def test_near_copies_beyond_the_bits_are_dropped(spark):
    rnd, texts = random.Random(11), []
    for _ in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(100)]
        for changed in (0, 1, 2, 3):
            own = list(words)
            for at in rnd.sample(range(10, 90), changed):
                own[at] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for t in texts]
    bits, root = [simhash.fingerprint(t.encode()) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) or (bits[i] ^ bits[j]).bit_count() <= 4:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert any(root[i] == root[j] and (bits[i] ^ bits[j]).bit_count() > 4 for i in range(len(texts)) for j in range(i))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect()) == sorted(set(root))


def test_bands_meet_at_the_least_similarity():
    rnd, met = np.random.default_rng(12), 0
    for _ in range(300):
        pool = rnd.integers(0, 1 << 64, 100, np.uint64)
        met += bool({*enumerate(simhash.bands(pool[:90]))} & {*enumerate(simhash.bands(pool[10:]))})
    assert met >= 299


def test_licenses(spark, edge):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    want = Counter()
    for key, text, *_ in edge_rows():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
        places = [i for i, _ in found]
        want[key, len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))] += 1
    got = licenses.op7_licenses(spark, edge)
    assert bag(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    row = got.filter("doc_id = 7").first()
    assert row["labels"] == "cc-by,cc-by-4.0-reference,mit-reference,reserved" and 0 < row["score"] <= 1


def as_pattern(markup):
    """The same language as a regular expression over words that each end in a blank."""
    out = []
    for token in re.findall(r"<<optional>>|<<end>>|<<var \d+-\d+>>|\w+", markup):
        var = re.match(r"<<var (\d+)-(\d+)>>", token)
        out.append({"<<optional>>": "(?:", "<<end>>": ")?"}.get(token) or (rf"(?:\S+ ){{{var[1]},{var[2]}}}" if var else f"{token} "))
    return re.compile("".join(out))


def plain_licenses(text):
    """Labels and share of covered words by trying every start and end of every template."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    labels, covered = set(), set()
    for label, pattern in [(x, as_pattern(m)) for x, m in licenses.TEMPLATES] + [(x, re.compile("".join(f"{w} " for w in p))) for p, x in licenses.PHRASES.items()]:
        for i in range(len(words)):
            ends = [j for j in range(i + 1, min(len(words), i + 400) + 1) if pattern.fullmatch("".join(f"{w} " for w in words[i:j]))] if pattern.match("".join(f"{w} " for w in words[i : i + 400])) else []
            if ends:
                labels.add(label)
                covered.update(range(i, max(ends)))
    return ",".join(sorted(labels)), len(covered) / len(words) if words else 0.0


def licence_texts():
    """Each template with its optional and replaceable regions left out, filled, and with one mandatory word changed."""
    rnd, out = random.Random(13), []
    for label, markup in licenses.TEMPLATES:
        least = re.sub(r"<<var (\d+)-\d+>>", lambda m: "x1 " * int(m[1]), re.sub(r"<<optional>>[^<]*(?:<<(?:optional|var)[^<]*(?:<<end>>)?[^<]*)*?<<end>>", "", markup))
        most = re.sub(r"<<var \d+-(\d+)>>", lambda m: "y2 " * int(m[1]), markup).replace("<<optional>>", "").replace("<<end>>", "")
        words = most.split()
        at = rnd.randrange(1, len(words) - 1)
        out += [f"Before. {least.upper()}. After", f"x {most} y", " ".join([*words[:at], "changed", *words[at + 1 :]])]
    return out


def test_labels_and_scores_equal_brute_force(spark, edge):
    rows = list(enumerate([*licence_texts(), *[t for _, t, *_ in edge_rows() if t and len(t) < 2000]]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in licenses.licenses(docs).collect():
        labels, score = plain_licenses(rows[r["doc_id"]][1])
        assert r["labels"] == labels and r["score"] == pytest.approx(score), rows[r["doc_id"]]


def test_templates_want_their_mandatory_words():
    label = lambda t: {x[2] for x in licenses.matches(t.encode().split())[1]}
    for name, markup in licenses.TEMPLATES:
        mandatory = licenses.Automaton(name, markup).mandatory
        assert any(a in w for a in licenses.ANCHORS for w in mandatory), name
    first = dict(licenses.TEMPLATES)["mit"].split("copies of the software and")[0].split("<<end>>")[-1]
    assert label(first) == set() and label("licensed under an mit license") == set()
    assert label("licensed under the apache license version 2 0") == {"apache-2.0-reference"}
    assert "copyright-notice" in label("copyright c 2020 some holder ltd all rights reserved")
    assert "copyright-notice" not in label("copyright all rights reserved")


def test_mixing(spark, edge):
    rows = [(k, len((t or "").encode().split()), s) for k, t, _, s in edge_rows()]
    totals = Counter()
    for _, n, s in rows:
        totals[s] += n
    names = sorted((s for s in totals if s is not None)) + [None]
    weights, target, free, left = dict(zip(names, [5, 2, 1] * 9)), {}, set(names), sum(totals.values())
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * totals[s]}
        if not over:
            break
        target |= {s: 3 * totals[s] for s in over}
        left, free = left - sum(target[s] for s in over), free - over
    target |= share
    got = mixing.mix(table(spark, edge, "documents")).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((k, n, totals[s]) for k, n, s in rows)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["position"] is None if r["taken"] == 0 else 0 <= r["position"] <= 1
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names if totals[s])
    again = mixing.mix(table(spark, edge, "documents").repartition(5), buckets=7)
    assert Counter(r["source"] for r in again.collect()) == Counter(r["source"] for r in got)
    one, two = (bag(mixing.op8_mixing(spark, edge), "doc_id", "taken", "position") for _ in range(2))
    assert one == two


def test_each_source_follows_its_schedule(spark):
    """Sources that are cut to less than their size and ones that are repeated, one of each schedule at least."""
    rnd, sizes = random.Random(9), {"a": 300, "b": 900, "c": 700, "d": 400, "e": 200, "f": 1500}
    rows = [(i, "w " * rnd.randrange(1, 9), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = mixing.mix(docs).collect()
    assert {r["target"] < r["source_size"] for r in got} == {True, False}
    demand = {s: next(round(r["target"]) for r in got if r["source"] == s) for s in sizes}
    opening, closing = (sum(demand[s] * mixing.SCHEDULES[k % 3][end] for k, s in enumerate(sorted(sizes))) for end in (0, 1))
    clock = lambda u: (opening * u + (closing - opening) * u * u / 2) / sum(demand.values())
    for rank, s in enumerate(sorted(sizes)):
        own = [r for r in got if r["source"] == s]
        total = sum(r["taken"] for r in own)
        assert abs(total - own[0]["target"]) <= 1 and max(r["source_size"] for r in own) == sum(r["size"] for r in own)
        takes = [(p, min(r["size"], r["taken"] - k * r["size"])) for r in own for k, p in enumerate(r["positions"] or ())]
        assert sum(n for _, n in takes) == total
        a, b = mixing.SCHEDULES[rank % 3]
        for u in (0.1, 0.25, 0.5, 0.75, 0.9, 1.0):
            want = (a * u + (b - a) * u * u / 2) / ((a + b) / 2)
            assert abs(sum(n for p, n in takes if p < clock(u)) / total - want) <= 10 / total, (s, u)
    ids = [r["doc_id"] for r in mixing.resample(docs).collect()]
    times = {r["doc_id"]: round(r["taken"] / r["size"]) for r in got}
    assert sum(abs(Counter(ids)[k] - n) for k, n in times.items()) <= 2 * len(sizes)
    twice = [k for k, n in times.items() if n > 1]
    assert any(ids[i] != ids[i + 1] for i in range(len(ids) - 1) if ids[i] in twice)
    half = [sum(rows[k][2] == s for k in ids[: len(ids) // 2]) / sum(rows[k][2] == s for k in ids) for s in sorted(sizes)]
    assert half[0] > half[1] > half[2]


def test_each_tenth_of_the_mix_has_the_scheduled_weights(spark):
    """A tenth of the positions holds a tenth of the words, and in it each source its normalised weight."""
    rnd, sizes = random.Random(5), {"a": 6000, "b": 2500, "c": 900, "d": 1200}
    rows = [(i, "w " * rnd.randrange(1, 9), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    takes = [(p, r["source"], min(r["size"], r["taken"] - k * r["size"])) for r in got for k, p in enumerate(r["positions"] or ())]
    demand = {r["source"]: round(r["target"]) for r in got}
    total, steps = sum(demand.values()), 20_000
    want = [Counter() for _ in range(10)]  # words by source and tenth, stepped along u
    done = 0.0
    for i in range(steps):
        u = (i + 0.5) / steps
        step = {s: demand[s] * (a + (b - a) * u) / ((a + b) / 2) / steps for (a, b), s in zip(mixing.SCHEDULES * 2, sorted(sizes))}
        for s, n in step.items():
            want[min(9, int(10 * done / total))][s] += n
        done += sum(step.values())
    for tenth in range(10):
        own = [(s, n) for p, s, n in takes if tenth <= 10 * p < tenth + 1]
        assert abs(sum(n for _, n in own) / total - 0.1) <= 40 / total, tenth
        for s in sizes:
            assert abs(sum(n for x, n in own if x == s) - want[tenth][s]) <= 30, (tenth, s)


def test_bpe(spark, edge):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(bpe.vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for key, text, *_ in edge_rows():
        ids = known.encode_ordinary(text or "")
        want[key, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())] += 1
    assert bag(bpe.op9_byte_bpe(spark, edge), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    codec, rnd = bpe.Codec.load(bpe.vocabulary_path()), random.Random(7)
    odd = ["".join(rnd.choice("ab'sstmdrevell   \n\t12.,!é　½漢\U0001F600") for _ in range(rnd.randrange(50))) for _ in range(2000)] + ["y" * 5000]
    for text, ids in zip(odd, codec.ids(bpe.slices(odd))):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
        raw, offsets = codec.decode(ids)
        assert raw == text.encode() and list(offsets[:1]) == [0] * bool(text)


def test_offsets_and_columns_are_kept(spark, edge):
    got = bpe.encode(table(spark, edge, "documents")).filter("doc_id = 3").first()
    assert got["offsets"][0] == 0 and len(got["ids"]) == len(got["offsets"]) and got["fp"] == "f"


def test_toxicity_on_held_out_labels(spark, sf):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))).join(labels.filter("doc_id % 3 = 0").selectExpr("doc_id", "toxic AS truth"), "doc_id")
    rows = scored.select("truth", "toxic", "expected_severity").collect()
    hit = sum(r["truth"] == 1 and r["toxic"] for r in rows)
    assert hit >= 0.7 * sum(r["truth"] == 1 for r in rows)
    assert sum(r["truth"] == 0 and r["toxic"] for r in rows) <= 0.03 * len(rows)
    assert all(0 <= r["expected_severity"] <= 2 for r in rows)


def test_toxicity_keeps_all_rows_and_needs_both_labels(spark, edge):
    assert toxicity.op10_toxicity(spark, edge).count() == len(edge_rows())
    docs = table(spark, edge, "documents")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int"))
    assert toxicity.score(docs, model).filter("toxic").count() == 0
