"""Kept sketches of durations against exact ranks."""

import math
import random
from bisect import bisect_left, bisect_right
from collections import defaultdict
from datetime import datetime

from inkwell.operators import evaluate, latency

CALLS = "at timestamp, name string, duration double, note string"


def test_merged_days_keep_the_rank_error(spark):
    rng = random.Random(5)
    rows = [(datetime(2024, 1, 1 + rng.randrange(6)), "hot" if rng.random() < 0.9 else "cold", rng.lognormvariate(0, 2), "x") for _ in range(40_000)]
    first, second = (latency.kept(spark.createDataFrame(part, CALLS).repartition(5)) for part in (rows[:25_000], rows[25_000:]))
    both = latency.added(first, second)
    assert both.count() == 12
    for since, until in ((None, None), ("2024-01-02", "2024-01-04")):
        exact = defaultdict(list)
        for at, name, duration, _ in rows:
            if since is None or since <= at.date().isoformat() <= until:
                exact[name].append(duration)
        found = {r["name"]: r for r in latency.period(both, since, until).collect()}
        assert found.keys() == exact.keys()
        for name, values in exact.items():
            values.sort()
            r, n = found[name], len(values)
            assert (r.calls, r.timed, r.most) == (n, n, values[-1]) and abs(r["mean"] - sum(values) / n) < 1e-9 * r["mean"] + 1e-9
            for q, v in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
                assert bisect_left(values, v) / n - latency.RANK_ERROR <= q <= bisect_right(values, v) / n + latency.RANK_ERROR


def test_awkward_rows(spark):
    day = datetime(2024, 1, 1)
    rows = [(day, "a", None, "x"), (day, "a", float("nan"), "x"), (day, "b", 1.0, "x"), (day, "b", 1.0, "x"), (None, "b", 3.0, "x"), (day, None, float("inf"), "x")]
    days = latency.kept(spark.createDataFrame(rows, CALLS))
    every = {r["name"]: r[1:] for r in latency.period(days).collect()}
    assert every == {"a": (2, 0, None, None, None, None, None), "b": (3, 3, 5 / 3, 3.0, 1.0, 3.0, 3.0), None: (1, 0, None, None, None, None, None)}
    assert {r["name"]: r.calls for r in latency.period(days, since="2024-01-01").collect()} == {"a": 2, "b": 2, None: 1}
    empty = latency.kept(spark.createDataFrame([], CALLS))
    assert empty.count() == 0 and latency.period(empty).count() == 0
    assert latency.added(days, empty).count() == days.count()


def test_latency_is_exact_above_the_size_of_a_sketch(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.lognormvariate(0, 3)) for _ in range(60_000)] + [("c", 1.0)] * 500 + [("d", None), (None, 2.0)]
    exact = {}
    for name, v in rows:
        exact.setdefault(name, []).extend([v] if v is not None else [])
    got = {r[0]: r[1:] for r in evaluate.latency(spark.createDataFrame(rows, "name string, value double").repartition(7), "value", "name").collect()}
    assert got.keys() == exact.keys()
    for name, values in exact.items():
        values.sort()
        want = [round(values[math.ceil(len(values) * p / 100) - 1], 6) if values else None for p in (50, 95, 99)]
        assert list(got[name]) == want
