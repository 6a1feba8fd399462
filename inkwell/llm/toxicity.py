"""Toxicity by cumulative-link ordinal regression.

Features are the words of a text and their beginnings of 4 to 7 letters, at levels "occurs", "twice" and "three times".
An L1 fit on the toxic labels selects features. The labels say toxic or not but not how much, so the grades are: 0 not
toxic, 1 toxic, 2 toxic with more selected features than the median toxic text. The ordinal fit shares one weight
vector across all thresholds, P(grade >= k) = sigmoid(x.w - theta_k), and the expected severity is their sum.

The fit runs on the driver on at most MAX_ROWS labelled texts, chosen by a hash of their id, which are reached by a
broadcast of those ids alone; scoring is one Arrow pass over all texts without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, table, texts

#: Most labelled texts that the fit uses.
MAX_ROWS = 4_000
#: Letters of the word beginnings that count as features; levels of each; least texts of the sample that hold a feature.
BEGINNINGS, LEVELS, LEAST_TEXTS = (4, 5, 6, 7), 3, 3
#: P(grade >= 1) from which a text counts as toxic.
THRESHOLD = 0.5
#: Selection penalty in units of the gradient's noise, ridge penalty of the refit, and steps of each fit; features are
#: scaled to unit variance meanwhile.
L1, RIDGE, STEPS = 3.0, 1e-4, (60, 200)
#: Words whose features a task remembers.
CACHE_WORDS = 200_000
WORD = re.compile(r"[^\W\d_]+")
#: Features of words that carry weight in the model of this name; a worker outlives the models that it serves.
_cache: dict[str, dict] = {}


def features(word: str) -> list[int]:
    names = [f"{word}$"] + [word[:n] for n in BEGINNINGS if len(word) >= n]
    return [(xxhash.xxh64_intdigest(n) >> 2 << 2) - (1 << 63) for n in names]


def present(text: str) -> list[int]:
    """The features of a text; the lowest two bits are the level."""
    counts: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for f in features(word):
            counts[f] += n
    return sorted(f + level for f, n in counts.items() for level in range(1, min(n, LEVELS) + 1))


@dataclass
class Model:
    """Weights by feature, and the thresholds."""

    weights: dict[int, float]
    thresholds: list[float]

    def probabilities(self, score: float) -> list[float]:
        return [float(1 / (1 + np.exp(np.clip(t - score, -60, 60)))) for t in self.thresholds]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on up to max_rows rows of labels (doc_id, toxic) that have a text in docs.

    Null labels and ids take no part; of rows that share an id the least text counts, before anything reaches the driver;
    without both toxic and clean texts, and so for empty tables, the model calls nothing toxic.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("grade")).dropna().filter("grade IN (0, 1)")
    chosen = known.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rows of them
    rows = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def step(batch):
        out = [np.array(present(t.decode()), np.int64) for t in texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "features": out}

    sparse = arrow_pass(rows.select(F.col("doc_id").cast("bigint"), "grade", "text"), step, "doc_id bigint, grade int, features array<bigint>")
    got = sparse.toArrow().combine_chunks()
    ids = got["doc_id"].to_numpy()
    own = np.argsort(ids, kind="stable")
    grades, rows = got["grade"].to_numpy(), got["features"]
    return train([int(grades[i]) for i in own], [rows[int(i)].values.to_numpy() for i in own])


def train(toxic: list[int], rows: list[list[int]]) -> Model:
    """The model for texts with these labels (0 or 1) and features."""
    if len(set(toxic)) < 2:
        return Model({}, [60.0])
    y = np.array(toxic)
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
    names, index, df = np.unique(flat, return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    on = df[index] >= LEAST_TEXTS
    index, of = index[on], of[on]
    scale = np.sqrt(len(y) / df)
    w = _select(_Likelihood(y, of, index, scale), L1 * np.sqrt(y.mean() * (1 - y.mean()) / len(y)), STEPS[0])
    picked = np.flatnonzero(w > 0)  # evidence for severity only: the absence of a word never calls a text toxic
    if not len(picked):
        return Model({}, [60.0])
    place = np.full(len(names), -1)
    place[picked] = np.arange(len(picked))
    on = place[index] >= 0
    evidence = np.bincount(of[on], minlength=len(y))
    severe = (y == 1) & (evidence > np.median(evidence[y == 1]))
    grades = np.unique(y + severe, return_inverse=True)[1]
    w, theta = _refit(_Likelihood(grades, of[on], place[index[on]], scale[picked], RIDGE), STEPS[1])
    return Model({int(names[k]): float(v) for k, v in zip(picked, w * scale[picked])}, theta.tolist())


class _Likelihood:
    """Mean negative log-likelihood of the grades and its gradient; a point is [scaled weights, thresholds]."""

    def __init__(self, y, of, index, scale, ridge=0.0):
        self.y, self.of, self.index, self.scale, self.ridge = y, of, index, scale, ridge
        self.n, self.top, self.d = len(y), int(y.max()), len(scale)

    def start(self) -> np.ndarray:
        shares = [np.mean(self.y >= k) for k in range(1, self.top + 1)]
        return np.concatenate([np.zeros(self.d), [-np.log(s / (1 - s)) for s in shares]])

    def __call__(self, x):
        w, theta = x[: self.d], x[self.d :]
        if (np.diff(theta) <= 0).any():
            return np.inf, np.zeros_like(x)
        n, y = self.n, self.y
        s = np.bincount(self.of, (w * self.scale)[self.index], minlength=n)
        up = np.ones((self.top + 2, n))
        up[1:-1] = 1 / (1 + np.exp(np.clip(theta[:, None] - s, -60, 60)))
        up[-1] = 0
        p = np.maximum(np.take_along_axis(up[:-1] - up[1:], y[None], 0)[0], 1e-12)
        slope = up * (1 - up)
        low, high = (np.take_along_axis(slope, y[None] + k, 0)[0] for k in (0, 1))
        g_score = (high - low) / p / n
        gw = np.bincount(self.index, g_score[self.of], minlength=self.d) * self.scale + self.ridge * w
        gt = [(slope[k] / p * ((y == k).astype(int) - (y == k - 1))).sum() / n for k in range(1, self.top + 1)]
        return -np.log(p).mean() + self.ridge * (w @ w) / 2, np.concatenate([gw, gt])


def _select(f: _Likelihood, l1: float, steps: int) -> np.ndarray:
    """Weights under an L1 penalty, by proximal gradient steps with backtracking."""
    x, rate = f.start(), 1.0
    now, g = f(x)
    for _ in range(steps):
        while rate > 1e-8:
            nx = x - rate * g
            nx[: f.d] = np.sign(nx[: f.d]) * np.maximum(np.abs(nx[: f.d]) - rate * l1, 0)
            loss, ng = f(nx)
            d = nx - x
            if loss <= now + g @ d + d @ d / (2 * rate) + 1e-12:
                break
            rate /= 2
        x, now, g, rate = nx, loss, ng, rate * 1.5
    return x[: f.d]


def _refit(f: _Likelihood, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by limited-memory BFGS."""
    x, past = f.start(), []
    now, g = f(x)
    for _ in range(steps):
        q, used = g.copy(), []
        for s, d in reversed(past):
            used.append((s @ q) / (s @ d))
            q -= used[-1] * d
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, d), a in zip(past, reversed(used)):
            q += s * (a - (d @ q) / (s @ d))
        rate = 1.0
        while (got := f(x - rate * q))[0] > now - 1e-4 * rate * (g @ q) and rate > 1e-10:
            rate /= 2
        if rate <= 1e-10 or now - got[0] < 1e-9:
            break
        s, d = -rate * q, got[1] - g
        x, now, g = x + s, *got
        if s @ d > 1e-12:
            past = [*past[-9:], (s, d)]
    return x[: f.d], x[f.d :]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with expected_severity, severity (the likeliest grade), p_toxic and toxic added, columns of these names replaced.

    A null or empty text has no features and so the base rate's score; a very long one is a step of its own; every row is
    kept, repeated ones too, and an empty table gives an empty one.
    """
    added = [("expected_severity", T.DoubleType()), ("severity", T.IntegerType()), ("p_toxic", T.DoubleType()), ("toxic", T.BooleanType())]
    kept = [f for f in docs.schema.fields if f.name not in {n for n, _ in added}]
    weights, name = model.weights, uuid.uuid4().hex

    def step(batch):
        if name not in _cache or len(_cache[name]) > CACHE_WORDS:
            _cache.clear()
            _cache[name] = {}
        cache = _cache[name]
        rows = []
        for raw in texts(batch.column("text")):
            counts: dict[int, int] = {}
            for word, n in Counter(WORD.findall(raw.decode().lower())).items():
                got = cache.get(word)
                if got is None:
                    got = cache[word] = tuple(f for f in features(word) if any(f + level in weights for level in range(1, LEVELS + 1)))
                for f in got:
                    counts[f] = counts.get(f, 0) + n
            hits = [f + level for f in sorted(counts) for level in range(1, min(counts[f], LEVELS) + 1)]
            up = model.probabilities(sum(weights.get(h, 0.0) for h in hits))
            each = -np.diff([1.0, *up, 0.0])
            rows.append((round(sum(up), 6), int(np.argmax(each)), round(up[0], 6), up[0] >= THRESHOLD))
        return {f.name: batch.column(f.name) for f in kept} | dict(zip([n for n, _ in added], zip(*rows)))

    schema = T.StructType([*kept, *[T.StructField(n, k) for n, k in added]])
    return arrow_pass(docs.select(*[F.col(f"`{f.name}`") for f in kept]), step, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model fitted on docs and labels doesn't call toxic, columns as they were."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{n}`") for n in names if n != "text"]).alias("doc"), F.col("text").cast("string").alias("text"))
    scored = score(inner, fit(docs, labels)).filter(~F.col("toxic"))
    return scored.select(*[F.col("text").cast(docs.schema[n].dataType) if n == "text" else F.col("doc").getField(n).alias(n) for n in names])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
