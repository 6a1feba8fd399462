"""The pipeline's stages on the awkward rows, each against a plain version, and on empty tables."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
from inkwell.llm import bpe, mixing, simhash, toxicity
from inkwell.llm.common import scope, table
from pyspark.sql import functions as F

from .test_operators import plain_spans


def staged(spark, path, tmp_path):
    docs, out = table(spark, path, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append((name, docs))
    return out


def whole(df):
    return Counter(tuple(r) for r in df.collect())


def survivors(rows):
    """Of each group of near copies the row of the smallest doc_id, by comparing all pairs."""
    words = [(r["text"] or "").lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    bits, root = [simhash.fingerprint(" ".join(w).encode()) for w in words], list(range(len(rows)))
    far = 0
    for i in range(len(rows)):
        for j in range(i):
            close = (bits[i] ^ bits[j]).bit_count() <= 4
            alike = sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            far += bool(alike and not close)
            if close or alike:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    groups = {}
    for row, r in zip(rows, root):
        groups.setdefault(r, []).append(row)
    return [min(own, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for own in groups.values()], far


def masked(text):
    out, at = [], 0
    for a, k, b in plain_spans(text or ""):
        if b > at:
            out += [text[at : max(at, a)], f"[{['EMAIL', 'IP', 'CARD', 'PHONE'][k]}]" if a >= at else ""]
            at = b
    return None if text is None else "".join(out) + text[at:]


def test_each_stage_does_what_a_plain_version_does(spark, edge, tmp_path):
    """Rows of every stage, judged on the rows that the stage before it has kept.

    Near copies are those of five-word shingles at a similarity of 0.8 or more, with op6's links beside them.
    """
    docs = table(spark, edge, "documents")
    steps = dict(staged(spark, edge, tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "bpe"]
    assert all(steps[n].columns == docs.columns for n in ("toxicity", "simhash", "pii", "mixing"))

    model = toxicity.fit(docs, table(spark, edge, "labels"))
    clean = lambda t: model.probabilities(sum(model.weights.get(f, 0.0) for f in toxicity.present(t or "")))[0] < toxicity.THRESHOLD
    assert whole(steps["toxicity"]) == Counter(tuple(r) for r in docs.collect() if clean(r["text"]))

    kept, far = survivors(steps["toxicity"].collect())
    assert far and Counter((r["doc_id"], r["text"]) for r in kept) == Counter((r["doc_id"], r["text"]) for r in steps["simhash"].collect())

    redone = [r.asDict() | {"text": masked(r["text"]), "n_chars": None if r["text"] is None else len(masked(r["text"]))} for r in steps["simhash"].collect()]
    assert whole(steps["pii"]) == Counter(tuple(r[c] for c in docs.columns) for r in redone)

    times = {(r["doc_id"], r["size"]): 1 if r["size"] == 0 else round(r["taken"] / r["size"]) for r in mixing.mix(steps["pii"]).collect()}
    want = Counter()
    for r in steps["pii"].collect():
        want[tuple(r)] += times[r["doc_id"], len((r["text"] or "").encode().split())]
    assert whole(steps["mixing"]) == +want

    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(bpe.vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    last = [(r["doc_id"], known.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in steps["mixing"].collect()]
    assert whole(steps["bpe"].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == Counter((k, len(i), sha(np.array(i, "<u4").tobytes()), sha(raw)) for k, i, raw in last)
    assert whole(corpus_pipeline.run(spark, edge)) == whole(steps["bpe"])


def test_frames_of_a_stage_stay_readable(spark, edge):
    """A second call, or a later stage, removes nothing that an earlier frame reads; what none reads is gone at once."""
    docs = table(spark, edge, "documents")
    with scope() as made:
        one = corpus_pipeline.mixing_stage(spark, docs, edge)
    two = corpus_pipeline.mixing_stage(spark, docs, edge)
    corpus_pipeline.bpe_stage(spark, two, edge).count()
    assert one.count() == two.count() and 0 < len(made) <= 2


def test_large_group_of_near_copies(spark, monkeypatch):
    """Same survivors as by all pairs, from far fewer candidate pairs than the group has, copies of copies included."""
    rnd = random.Random(11)
    origin = [f"w{rnd.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(240):
        words = list(origin)
        for _ in range(min(30, int(rnd.expovariate(0.3)))):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(400)}"
        if i % 8 == 0:
            del words[rnd.randrange(140) :][: rnd.randrange(12)]
        rows.append({"doc_id": rnd.randrange(10**6), "text": " ".join(words)})
    rows += [{"doc_id": 10**6 + k, "text": rows[k]["text"]} for k in range(20)]
    pairs, write = [], simhash.written

    def watched(df, name):
        out = write(df, name)
        if name == "simhash-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", watched)
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want, far = survivors(rows)
    assert far > 1000 and {r["doc_id"] for r in kept} == {r["doc_id"] for r in want} and len(kept) == len(want) > 20
    assert sum(pairs) < 4 * len(rows)


def test_empty(spark, bare):
    assert corpus_pipeline.run(spark, bare).count() == 0


def test_buckets_in_blocks_hold_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    placed = spark.createDataFrame([(k, n) for k, size in ((1, 11), (2, 2), (3, 1)) for n in range(size)], "key int, node bigint")
    one, two = simhash.in_blocks(placed)
    both = one.select("key", "i", "j", "node").join(two.select("key", "i", "j", F.col("node").alias("other")), ["key", "i", "j"])
    assert Counter(map(tuple, both.select("key", "node", "other").collect())) == Counter((k, a, b) for k, size in ((1, 11), (2, 2), (3, 1)) for a in range(size) for b in range(size))
    assert both.groupBy("key", "i", "j").count().filter("key = 1").count() == 16


def test_operators_run_at_once_as_they_do_alone(spark, sf):
    """Tables of one thread aren't removed by another."""
    from concurrent.futures import ThreadPoolExecutor

    from inkwell.llm.queries import QUERIES

    names = ["op3_substrings", "op6_simhash", "op8_mixing", "op13_importance"]
    run = lambda name: Counter(map(str, QUERIES[name](spark, sf).collect()))
    alone = {name: run(name) for name in names}
    with ThreadPoolExecutor(5) as pool:
        piped = pool.submit(lambda: whole(corpus_pipeline.run(spark, sf)))
        at_once = dict(zip(names, pool.map(run, names)))
        assert at_once == alone and piped.result() == whole(corpus_pipeline.run(spark, sf))
