"""Language of words and texts by a linear-chain conditional random field.

A text is the sequence of its words, runs of letters in lower case. A word's score for each language is the sum of the
weights of its features: beginnings and endings of up to AFFIX letters, runs of two and three letters with the word's
edges, the whole word, and whether the lexicon of a language has it. Learned transition weights join neighbouring words,
and forward-backward gives each word's distribution over languages, so code-switched texts get segments. A text's
language is the one with the largest mean over its words, and that mean is its score.

The field is fitted on the driver on a bounded sample: up to SAMPLE_TEXTS texts, chosen by a hash among those that may be
learned from, and of each up to STRETCHES stretches of STRETCH_WORDS consecutive words from anywhere in it. Stretches
follow each other in chains, in the order of the hash, so that changes of language are seen as well. Features are hashed
to rows of one table of weights, which is bounded whatever the number of languages. Labelling is one Arrow pass over all
texts without a shuffle, with whole pieces in array operations: a text of any length is cut in blocks, whose transfer
matrices are composed first.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, table

#: Bounds of the sample: texts, stretches of each, words of a stretch, letters of its words, stretches in a chain.
SAMPLE_TEXTS, STRETCHES, STRETCH_WORDS, MOST_LETTERS, CHAIN = 1_000, 3, 32, 64, 8
#: Longest affixes; rows of the table of weights, and the most weights in it; least stretches that hold a lexicon's word.
AFFIX, ROWS, MOST_WEIGHTS, LEAST_HELD = 4, 1 << 17, 1 << 24, 3
#: Share of a lexicon word's stretches in one language from which it is a mark of it; ridge penalty; steps of the fit.
MARK, RIDGE, STEPS = 0.9, 1e-5, 25
#: Text of one step of the pass, and words of the blocks that are stepped together.
PIECE, BLOCK = 1 << 20, 64
#: Residue of crc32(doc_id) that is held out, and the modulus.
HELD_OUT, FOLDS = 0, 5
UNKNOWN = "und"
#: Odd factors of the hashes of features.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """The words of some texts: text of each, its letters' places, and code points with 0 for all but letters."""

    of: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    points: np.ndarray


def split(texts: list[str]) -> Words:
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le"), np.uint32)
    on = letters()[points]
    starts = np.flatnonzero(on[1:] & ~on[:-1]) + 1
    ends = np.flatnonzero(on[:-1] & ~on[1:]) + 1
    begins = np.cumsum([1, *[len(t) + 1 for t in low[:-1]]])
    return Words(np.searchsorted(begins, starts, "right") - 1, starts, ends, np.where(on, points, 0).astype(np.uint64))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * MIX[1]
    return values ^ (values >> np.uint64(32))


def hashed(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, affixes, runs, edges): a hash of each word; hashes of its affixes, 0 where it is too short, a column for
    each; hashes of letter runs, two for each letter, and where the runs of each word begin."""
    p, starts, ends = words.points, words.starts, words.ends
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.repeat(starts - first, size) + np.arange(int(size.sum()))
    before, own, after = p[at - 1], p[at], p[at + 1]
    two = _mixed(own * MIX[1] + after * MIX[2] + MIX[0])
    runs = np.stack([two, _mixed(before * MIX[3] + own * MIX[1] + after * MIX[2])], 1)
    power = np.cumprod(np.full(int(size.max(initial=1)), MIX[0]))
    whole = _mixed(np.add.reduceat(own * power[at - np.repeat(starts, size)], first) + MIX[3]) if len(at) else np.zeros(0, np.uint64)
    affixes = np.zeros((len(size), 2 * AFFIX), np.uint64)
    head, tail = np.full(len(size), MIX[2]), np.full(len(size), MIX[3])
    for k in range(AFFIX):
        long = size > k
        head = head * MIX[1] + p[np.minimum(starts + k, len(p) - 1)]
        tail = tail * MIX[1] + p[np.maximum(ends - 1 - k, 0)]
        affixes[long, k], affixes[long, AFFIX + k] = _mixed(head[long]), _mixed(tail[long])
    return whole, affixes, runs, first


@dataclass
class Model:
    """Languages, rows of hashed weights, the lexicon (hashes of words, and for each its row of weights), transitions."""

    names: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    marks: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """The score of each word for each language."""
        whole, affixes, runs, first = hashed(words)
        rows = np.uint64(len(self.weights) - 1)
        out = self.weights[(whole % rows).astype(np.int64) + 1].copy()
        if len(first):
            out += np.add.reduceat(self.weights[(runs % rows).astype(np.int64) + 1].sum(1), first)
        for column in affixes.T:
            out += self.weights[np.where(column == 0, 0, column % rows + np.uint64(1)).astype(np.int64)]  # row 0 is zero
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
            out += np.where((self.lexicon[at] == whole)[:, None], self.marks[at], 0)
        return out


@dataclass
class Marginals:
    """Distribution of each word's language, expected transitions, and the log of all sequences' total weight."""

    words: np.ndarray
    transitions: np.ndarray
    total: float


def forward_backward(emissions: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, expected: bool = False, block: int = BLOCK) -> Marginals:
    """Marginals of sequences of these sizes (none empty), which follow each other in emissions.

    Every sequence is cut in blocks. All blocks step together, first for their transfer matrices, whose composition along
    a sequence gives each block's entry, then for the forward and the backward weights of each word.
    """
    n, kinds = emissions.shape
    high = emissions.max(1, keepdims=True)
    e, a = np.exp((emissions - high).astype(float)), np.exp(transitions - transitions.max())
    counts = -(-sizes // block)
    of = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(sizes) - sizes)[of] + nth * block
    length = np.minimum(block, sizes[of] - nth * block)
    order = np.argsort(-length, kind="stable")
    of, nth, start, length = of[order], nth[order], start[order], length[order]
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(block)]
    fresh = (nth == 0)[:, None]
    transfer = np.tile(np.eye(kinds), (len(of), 1, 1))
    for t, m in enumerate(live):
        if m:
            moved = transfer[:m] @ a
            moved = np.where(fresh[:m, :, None], transfer[:m], moved) if t == 0 else moved
            moved = moved * e[start[:m] + t][:, None, :]
            transfer[:m] = moved / moved.max((1, 2), keepdims=True)
    enter, leave = np.ones((len(of), kinds)), np.ones((len(of), kinds))
    by = np.argsort(nth, kind="stable")
    edges = np.searchsorted(nth[by], np.arange(int(counts.max(initial=0)) + 1))
    now = np.ones((len(sizes), kinds))
    for lo, hi in zip(edges, edges[1:]):
        b = by[lo:hi]
        enter[b] = now[of[b]]
        out = np.einsum("bi,bij->bj", enter[b], transfer[b])
        now[of[b]] = out / out.sum(1, keepdims=True)
    now = np.ones((len(sizes), kinds))
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        b = by[lo:hi]
        leave[b] = now[of[b]]
        out = np.einsum("bij,bj->bi", transfer[b], leave[b])
        now[of[b]] = out / out.sum(1, keepdims=True)
    ahead, back, total = np.empty((n, kinds)), np.empty((n, kinds)), float(high.sum())
    for t, m in enumerate(live):
        if m:
            moved = enter[:m] @ a
            moved = (np.where(fresh[:m], enter[:m], moved) if t == 0 else moved) * e[start[:m] + t]
            scale = moved.sum(1, keepdims=True)
            total += float(np.log(scale).sum())
            enter[:m] = ahead[start[:m] + t] = moved / scale
    for t, m in reversed(list(enumerate(live))):
        if m:
            at = start[:m] + t
            back[at] = leave[:m]
            moved = (e[at] * leave[:m]) @ a.T
            leave[:m] = moved / moved.sum(1, keepdims=True)
    words = ahead * back
    words /= words.sum(1, keepdims=True)
    pairs = np.zeros((kinds, kinds))
    if expected and n > 1:
        inner = np.ones(n, bool)
        inner[np.cumsum(sizes) - sizes] = False
        two = np.flatnonzero(inner)
        both = ahead[two - 1][:, :, None] * a * (e[two] * back[two])[:, None, :]
        pairs = (both / both.sum((1, 2), keepdims=True)).sum(0)
        total += float(transitions.max()) * len(two)
    return Marginals(words, pairs, total)


def lexicon_of(whole: np.ndarray, labels: np.ndarray, stretch: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, marks): hashes of the words that LEAST_HELD stretches hold, sorted, and for each the language and whether
    it is a mark of that one alone, as 2 * language + mark."""
    names, index = np.unique(whole, return_inverse=True)
    once = np.unique(np.stack([index, labels, stretch]), axis=1)
    held = np.zeros((len(names), kinds))
    np.add.at(held, (once[0], once[1]), 1)
    often = held.sum(1) >= LEAST_HELD
    held = held[often]
    top = held.argmax(1) if len(held) else np.zeros(0, np.int64)
    return names[often], 2 * top + (held.max(1, initial=0) >= MARK * held.sum(1))


def train(stretches: list[tuple[str, list[str]]]) -> Model:
    """The field fitted to stretches (language, words) by L-BFGS; CHAIN of them follow each other in a sequence."""
    names = sorted({name for name, _ in stretches})
    kinds = len(names)
    if not kinds:
        return Model([], np.zeros((2, 0), np.float32), np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    rows = ROWS
    while rows * kinds > MOST_WEIGHTS:
        rows //= 2
    distinct: dict[str, int] = {}
    index = np.array([distinct.setdefault(w, len(distinct)) for _, own in stretches for w in own], np.int64)
    sizes = np.array([len(own) for _, own in stretches])
    label = np.repeat([names.index(name) for name, _ in stretches], sizes)
    stretch = np.repeat(np.arange(len(stretches)), sizes)
    whole, affixes, runs, first = hashed(split(list(distinct)))
    lexicon, marks = lexicon_of(whole[index], label, stretch, kinds)
    at = np.minimum(np.searchsorted(lexicon, whole), max(len(lexicon) - 1, 0))
    marked = np.where(lexicon[at] == whole, marks[at] + rows + 1, 0) if len(lexicon) else np.zeros(len(whole), np.int64)
    slot = lambda h: (h % np.uint64(rows)).astype(np.int64) + 1
    letters_of = np.repeat(np.arange(len(whole)), np.diff([*first, len(runs)]))
    parts = [(slot(whole), np.arange(len(whole))), *[(slot(r), letters_of) for r in runs.T], (marked, np.arange(len(whole)))]
    parts += [(np.where(c == 0, 0, slot(c)), np.arange(len(whole))) for c in affixes.T]
    feature, word = (np.concatenate(x) for x in zip(*parts))
    feature, word = feature[feature > 0], word[feature > 0]
    used, feature = np.unique(feature, return_inverse=True)
    chains = np.add.reduceat(sizes, np.arange(0, len(sizes), CHAIN))
    inner = np.ones(len(label), bool)
    inner[np.cumsum(chains) - chains] = False
    two = np.flatnonzero(inner)
    seen = np.bincount(label[two - 1] * kinds + label[two], minlength=kinds * kinds).reshape(kinds, kinds)

    def loss(x):
        w, trans = x[: -kinds * kinds].reshape(-1, kinds), x[-kinds * kinds :].reshape(kinds, kinds)
        by_word = np.stack([np.bincount(word, w[feature, k], len(whole)) for k in range(kinds)], 1)
        emissions = by_word[index]
        got = forward_backward(emissions, chains, trans, True)
        value = got.total - emissions[np.arange(len(label)), label].sum() - (seen * trans).sum()
        off = got.words
        off[np.arange(len(label)), label] -= 1
        per_word = [np.bincount(index, off[:, k], len(whole)) for k in range(kinds)]
        grad = np.stack([np.bincount(feature, per_word[k][word], len(used)) for k in range(kinds)], 1)
        n = len(label)
        return value / n + RIDGE * (x @ x) / 2, np.concatenate([grad.ravel(), (got.transitions - seen).ravel()]) / n + RIDGE * x

    x = minimised(loss, np.zeros(len(used) * kinds + kinds * kinds), STEPS)
    weights = np.zeros((rows + 1 + 2 * kinds, kinds), np.float32)
    weights[used] = x[: -kinds * kinds].reshape(-1, kinds)
    table_of_marks = weights[marks + rows + 1] if len(lexicon) else np.zeros((0, kinds), np.float32)
    return Model(names, weights[: rows + 1], lexicon, table_of_marks, x[-kinds * kinds :].reshape(kinds, kinds))


def minimised(f, x: np.ndarray, steps: int) -> np.ndarray:
    """A point of low f (which gives value and gradient), by limited-memory BFGS from x."""
    past: list[tuple[np.ndarray, np.ndarray]] = []
    now, g = f(x)
    for _ in range(steps):
        q, used = g.copy(), []
        for s, d in reversed(past):
            used.append((s @ q) / (s @ d))
            q -= used[-1] * d
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, d), share in zip(past, reversed(used)):
            q += s * (share - (d @ q) / (s @ d))
        rate = 1.0
        while (got := f(x - rate * q))[0] > now - 1e-4 * rate * (g @ q) and rate > 1e-8:
            rate /= 2
        if rate <= 1e-8 or now - got[0] < 1e-7:
            break
        s, d = -rate * q, got[1] - g
        x, now, g = x + s, *got
        if s @ d > 1e-14:
            past = [*past[-7:], (s, d)]
    return x


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def learned(docs: DataFrame) -> Model:
    """The field fitted on rows of docs (doc_id, text, lang) that aren't held out and have a text and a language.

    Texts are chosen by a hash of id and text; repeated rows count once, before any of them is moved in full number. Words
    of more than MOST_LETTERS letters aren't learned from. Without such rows the model knows no language.
    """
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.agg(F.count("*")).first()[0]
    if not n:
        return train([])
    share = min(1 << 40, (SAMPLE_TEXTS * (1 << 40)) // n + 1)
    picked = known.withColumn("place", F.xxhash64("doc_id", "text")).filter(F.pmod("place", F.lit(1 << 40)) < share)

    def step(batch):
        out = [_stretches(t, place) for t, place in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist())]
        return {"place": batch.column("place"), "lang": batch.column("lang"), "stretches": out}

    cut = arrow_pass(picked.select("place", "lang", "text"), step, "place bigint, lang string, stretches array<string>")
    rows = cut.groupBy("place").agg(F.min("lang").alias("lang"), F.first("stretches").alias("stretches")).orderBy("place").limit(2 * SAMPLE_TEXTS).collect()
    each = sorted((xxhash.xxh64_intdigest(f"{r['place']}:{k}"), r["lang"], s) for r in rows for k, s in enumerate(r["stretches"]))
    return train([(lang, s.split()) for _, lang, s in each])


def _stretches(text: str, place: int) -> list[str]:
    """Up to STRETCHES stretches of consecutive words of a text, chosen by a hash."""
    words = split([text])
    short = words.ends - words.starts <= MOST_LETTERS
    blocks = range(-(-len(short) // STRETCH_WORDS))
    low = text.lower()
    out = []
    for b in sorted(blocks, key=lambda b: xxhash.xxh64_intdigest(f"{place}:{b}"))[:STRETCHES]:
        own = slice(b * STRETCH_WORDS, (b + 1) * STRETCH_WORDS)
        picked = [low[s - 1 : e - 1] for s, e, fit in zip(words.starts[own], words.ends[own], short[own]) if fit]
        out += [" ".join(picked)] if picked else []
    return out


LABELLED = "lang_pred string, score double, n_words bigint, segments array<struct<first:bigint,words:bigint,lang:string>>"


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """LABELLED columns beside doc_id for every row of docs (doc_id, text).

    lang_pred is the language with the largest mean over the words (ties to the smaller name), score that mean; segments
    are the stretches of words whose likeliest language is the same, words numbered from 0. A text that is null or has no
    letter is `und` with score 0 and no segment, and so is every text if the model knows no language. A very long text is
    a step of its own; repeated rows are rows of their own, an empty table gives an empty one, and other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_WEIGHTS weights

    def step(batch):
        field, own = shared.value, [t or "" for t in batch.column("text").to_pylist()]
        n, kinds = len(own), len(field.names)
        words = split(own)
        sizes = np.bincount(words.of, minlength=n) if kinds else np.zeros(n, np.int64)
        name, score, offsets = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n + 1, np.int64)
        first = count = kind = np.zeros(0, np.int64)
        if sizes.any():
            got = forward_backward(field.emissions(words), sizes[sizes > 0], field.transitions).words
            begins = (np.cumsum(sizes) - sizes)[sizes > 0]
            mean = np.add.reduceat(got, begins) / sizes[sizes > 0][:, None]
            name[sizes > 0] = np.array(field.names, object)[mean.argmax(1)]
            score[sizes > 0] = np.round(mean.max(1), 6).clip(0, 1)
            label = got.argmax(1)
            new = np.ones(len(label), bool)
            new[1:] = label[1:] != label[:-1]
            new[begins] = True
            at = np.flatnonzero(new)
            count, kind, of = np.diff([*at, len(label)]), label[at], words.of[at]
            first = at - (np.cumsum(sizes) - sizes)[of]
            offsets = np.searchsorted(of, np.arange(n + 1))
        langs = pa.array(np.array(field.names, object)[kind] if len(kind) else [], pa.string())
        parts = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(count, pa.int64()), langs], names=["first", "words", "lang"])
        return {"doc_id": batch.column("doc_id"), "lang_pred": name.tolist(), "score": score, "n_words": sizes, "segments": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_pass(rows, step, f"doc_id bigint, {LABELLED}", PIECE)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs, learned(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", F.size("segments").cast("bigint").alias("n_segments"))
