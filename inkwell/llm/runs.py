"""Periodic runs of words: descending-LCP Kruskal over the suffixes of each document.

Suffixes are ordered by prefix doubling over word numbers, and neighbours' common prefixes come from the ranks of the
doublings. The edges between neighbours are then taken by decreasing common prefix, as in Kruskal's algorithm: union-find
joins the classes of suffixes, each with the ordered set of its positions, the smaller set into the larger. Two positions
that become neighbours in a set, at a distance d within the common prefix L, share d + L words with period d; if the word
before them differs, that stretch is a run. Every run of at least two periods is found so, with its smallest period: a
smaller one would have put a position between the two at a higher level already.

Only edges whose common prefix is long enough for a wanted run are taken, and only documents with such a repeated window
are sorted at all. Documents are dealt as they are read: nothing is shuffled or collected. Memory follows the longest
document, about 16 bytes a word for each doubling.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, table, texts

#: Least words of a run, and least periods in it.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Odd factor that spreads word numbers over 64 bits, for the windows that sort out documents without repeats.
SPREAD = 0x9E3779B97F4A7C15

Run = tuple[int, int, int]


def least_prefix(words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> int:
    """The least common prefix of two suffixes that start a run of that many words and periods, a period apart."""
    return min(max(words - d, (periods - 1) * d) for d in range(1, words + 1))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal words alike."""
    names: dict[bytes, int] = {}
    return np.array([names.setdefault(w, len(names)) for w in words], np.int64)


def repeats(ids: np.ndarray, size: int) -> bool:
    """Whether some window of size words may occur twice; windows are compared by a hash, so never false if one does."""
    if len(ids) <= size:
        return False
    # at has a hash of each window of own words; windows of size are put together from those of powers of two
    at, own, left, factor = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(SPREAD), 1, size, SPREAD
    rolled, done = np.zeros(len(ids) + 1, np.uint64), 0
    while left:
        if left & 1:
            rolled = rolled[: len(at) - done] * np.uint64(factor) + at[done:]
            done += own
        left >>= 1
        if left:
            at, own, factor = at[:-own] * np.uint64(factor) + at[own:], own * 2, factor * factor % (1 << 64)
    rolled = np.sort(rolled)
    return bool((rolled[1:] == rolled[:-1]).any())


def ordered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes, and the common prefix of each with its next."""
    n, rank, levels, half = len(ids), ids, [], 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:-half] = rank[half:] + 1
        key = rank * (n + 1) + nxt if levels else ids
        order = np.argsort(key, kind="stable")
        apart = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank = np.empty(n, np.int64)
        rank[order] = apart
        levels.append(rank.astype(np.int32))
        if apart[-1] == n - 1:
            break
        half = 1 << (len(levels) - 1)
    one, two, prefix = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = one + prefix, two + prefix
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[level][a[inside]] == levels[level][b[inside]]]
        prefix[same] += 1 << level
    return order, prefix


def seeds(order: np.ndarray, prefix: np.ndarray, least: int) -> Iterator[Run]:
    """(position, distance, common prefix) of positions that become neighbours at a distance within their common prefix."""
    edges = np.flatnonzero(prefix >= least)
    edges = edges[np.argsort(-prefix[edges], kind="stable")]
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(slot: int) -> int:
        while (up := parent.get(slot, slot)) != slot:
            parent[slot] = slot = parent.get(up, up)
        return slot

    places = order.tolist()
    for edge, common in zip(edges.tolist(), prefix[edges].tolist()):
        one, two = find(edge), find(edge + 1)
        large, small = members.pop(one, None) or [places[one]], members.pop(two, None) or [places[two]]
        if len(large) < len(small):
            large, small, one, two = small, large, two, one
        parent[two] = one
        before = -1
        for x, after in zip(small, [*small[1:], len(places)]):
            at = bisect_left(large, x)
            if at and before < large[at - 1] and x - large[at - 1] <= common:
                yield large[at - 1], x - large[at - 1], common
            if at < len(large) and large[at] < after and large[at] - x <= common:
                yield x, large[at] - x, common
            before = x
        if 8 * len(small) < len(large):
            for x in small:
                insort(large, x)
        else:
            large = sorted(large + small)
        members[one] = large


def runs(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """(start, length, period) of every maximal run of at least so many words and periods (two or more), by start and period."""
    least = max(1, least_prefix(least_words, least_periods))
    if len(words) < max(least_words, least_periods):
        return []
    ids = numbered(words)
    if not repeats(ids, least):
        return []
    found = set()
    for at, distance, common in seeds(*ordered(ids), least):
        whole = distance + common
        if whole >= max(least_words, least_periods * distance) and (at == 0 or ids[at - 1] != ids[at + distance - 1]):
            found.add((at, whole, distance))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words: list[bytes], found: list[Run]) -> list[bytes]:
    """words without those that stand in a run after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """words, of which one id in ten has a tail that repeats; a null id leaves them as they are."""
    if key is None or not words:
        return words
    last, rest = crc32(str(key).encode()) % 10, crc32(str(key).encode()) // 10
    if last:
        return words
    at = rest % len(words)
    left = len(words) - at
    period = 1 + left // (3 + rest % 8)
    return words[:at] + (words[at : at + period] * (left // period + 1))[:left]


def best(found: list[Run]) -> Run | None:
    """The run with the most periods, ties to the smallest start and then period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def detected(docs: DataFrame, prepare=lambda words, key: words) -> DataFrame:
    """(doc_id, n_words, n_kept, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row
    of docs (doc_id, text); prepare may change a document's words first.

    A null or empty text, or one of blanks, has no word and no run: its four numbers of the best run are null and both
    digests those of nothing. A very long text is a step of its own; repeated rows are rows of their own, an empty table
    gives an empty one, and columns beside doc_id and text aren't read.
    """

    def step(batch):
        rows = []
        for raw, key in zip(texts(batch.column("text")), batch.column("doc_id").to_pylist()):
            words = prepare(raw.split(), key)
            found = runs(words)
            left = kept(words, found)
            top = best(found)
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
            numbers = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
            rows.append((len(words), len(left), len(found), *numbers, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
        names = ("n_words", "n_kept", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, zip(*rows)))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbers = ", ".join(f"{n} bigint" for n in ("doc_id", "n_words", "n_kept", "n_runs", "start", "length", "period", "exponent_milli"))
    return arrow_pass(rows, step, f"{numbers}, runs_sha256 string, collapsed_sha256 string")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents"), planted)
