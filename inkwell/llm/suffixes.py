"""Substring dedup by external induced suffix sorting.

The repeated windows of the corpus, as `repeats` finds and routes them, form shards; each shard's distinct pieces are
one text whose suffixes are sorted by induction. A queue keyed by first symbol carries suffixes with the common-prefix
value to the suffix popped before; popping a bucket pushes the suffixes one symbol to the left, whose common prefix is
one more than the least value between their sources. The queue keeps at most MEMORY bytes and holds the rest in a file.
The leftmost S-suffixes that start the induction are sorted by naming their substrings (an induction of its own) and
renaming pairs of names until they differ or cover a window. Windows whose suffix shares a window's length with a
neighbour stand at another place too.
"""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import MIX, Unit, remove

#: Bytes of a window and of an anchor, and bytes of a shard.
BYTES = Unit(words=False, window=200, gram=48, shard=2_000_000)
#: Bytes of suffix tuples that a queue holds in memory.
MEMORY = 1 << 20
FAR = 1 << 30
TUPLE = np.dtype([("at", np.int32), ("lcp", np.int32)])


class SuffixQueue:
    """Suffix tuples by first symbol, in order of arrival; all go to the task's scratch file when memory is full."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.spilled, self.parts, self.file = memory, 0, 0, {}, None

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        tuples = np.empty(len(at), TUPLE)
        tuples["at"], tuples["lcp"] = at, lcp
        self.parts.setdefault(symbol, []).append(tuples)
        self.held += tuples.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for parts in self.parts.values():
            for k, p in enumerate(parts):
                if isinstance(p, np.ndarray):
                    self.file.write(p)
                    parts[k] = at, len(p)
                    at += p.nbytes
        self.spilled, self.held = self.spilled + self.held, 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        got = []
        for p in self.parts.pop(symbol, []):
            if isinstance(p, np.ndarray):
                self.held -= p.nbytes
            else:
                self.file.seek(p[0])
                p = np.frombuffer(self.file.read(p[1] * TUPLE.itemsize), TUPLE)
            got.append(p)
        all_of = np.concatenate(got) if got else np.zeros(0, TUPLE)
        return all_of["at"].copy(), all_of["lcp"].copy()


def shared(text: np.ndarray, eights: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, exact below most (a multiple of 8)."""
    out, live, n = np.zeros(len(a), np.int64), np.arange(len(a)), len(text)
    for step in range(0, most, 8):
        x, y = a[live] + step, b[live] + step
        differ = np.where((x < n) & (y < n), eights[np.minimum(x, n - 1)] ^ eights[np.minimum(y, n - 1)], np.uint64(1))
        same = differ == 0
        first = np.zeros(len(live), np.int64)
        odd = differ[~same]
        low = odd & (~odd + np.uint64(1))
        first[~same] = np.bitwise_count(low - np.uint64(1)) // 8
        out[live] += np.where(same, 8, first)
        live = live[same]
        if not len(live):
            break
    return out


def induce(text, symbols, is_s, fixed, up, memory, with_lcp, seam):
    """Induce L-suffixes upwards (from fixed leftmost S-suffixes) or S-suffixes downwards (from fixed L-suffixes).

    fixed: symbol to (places, common prefixes) in popping order. Returns the induced ones in the same form, and the
    joints (last induced, first fixed, common prefix) of each bucket.
    """
    queue, run, out, joints = SuffixQueue(memory), np.zeros(int(symbols[-1]) + 1, np.int64), {}, []

    def spread(at, lcp):
        before = at - 1
        on = np.flatnonzero((at > 0) & (is_s[before] != up))
        if not with_lcp:
            kinds = text[before[on]]
            order = np.argsort(kinds, kind="stable")
            for part in np.split(on[order], np.flatnonzero(np.diff(kinds[order])) + 1) if len(on) else ():
                queue.push(int(text[before[part[0]]]), before[part], np.zeros(len(part), np.int32))
            return
        kinds = text[before[on]]
        order = np.argsort(kinds, kind="stable")
        least = lcp.min()
        groups = np.split(on[order], np.flatnonzero(np.diff(kinds[order])) + 1) if len(on) else []
        held = {int(text[before[g[0]]]): run[text[before[g[0]]]] for g in groups}
        np.minimum(run, least, out=run)
        for g in groups:
            symbol = int(text[before[g[0]]])
            cuts = np.concatenate([[0], g + 1])
            tail = cuts[-1] < len(lcp)
            mins = np.minimum.reduceat(lcp, cuts if tail else cuts[:-1])
            own = mins[: len(g)].astype(np.int64)
            own[0] = min(own[0], held[symbol])
            run[symbol] = mins[-1] if tail else FAR
            queue.push(symbol, before[g], np.minimum(own + 1, FAR))

    for symbol in symbols if up else symbols[::-1]:
        symbol, own = int(symbol), []
        while True:
            at, lcp = queue.pop(symbol)
            if not len(at):
                break
            if not own:
                lcp[0] = 0
            own.append((at, lcp))
            spread(at, lcp)
        if own:
            out[symbol] = tuple(map(np.concatenate, zip(*own)))
        if symbol in fixed and len(fixed[symbol][0]):
            at, lcp = fixed[symbol][0], fixed[symbol][1].copy()
            lcp[0] = seam(out[symbol][0][-1], at[0]) if own and with_lcp else 0
            if own:
                joints.append((int(out[symbol][0][-1]), int(at[0]), int(lcp[0])))
            spread(at, lcp)
    return out, joints


def by_symbol(text, at, lcp):
    if not len(at):
        return {}
    cuts = np.flatnonzero(np.diff(text[at])) + 1
    return {int(text[a[0]]): (a, b) for a, b in zip(np.split(at, cuts), np.split(lcp, cuts))}


def backwards(lists):
    """L-suffixes in downward order: the common prefix now belongs to the smaller of two neighbours."""
    return {s: (at[::-1], np.concatenate([[0], lcp[:0:-1]]).astype(np.int32)) for s, (at, lcp) in lists.items()}


def repeated(text: np.ndarray, window: int, memory: int = MEMORY) -> np.ndarray:
    """Which places of text (symbols from 1 up) begin `window` symbols that begin at another place too."""
    text = np.append(text, 0).astype(np.int32)
    n, most = len(text), (window // 8 + 2) * 8
    last_of_run = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    grows = np.append(text[1:] > text[:-1], True)
    is_s = grows[last_of_run][np.searchsorted(last_of_run, np.arange(n))]
    lms = np.flatnonzero(is_s & ~np.concatenate([[True], is_s[:-1]]))
    symbols = np.unique(text)
    zero = np.zeros(len(lms), np.int32)
    order = lms[np.argsort(text[lms], kind="stable")].astype(np.int32)

    low, _ = induce(text, symbols, is_s, by_symbol(text, order, zero), True, memory, False, None)
    high, _ = induce(text, symbols, is_s, backwards(low), False, memory, False, None)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = np.concatenate([at[::-1] for _, (at, _) in sorted(high.items())] or [lms[-1:]])
    ranked = ranked[is_lms[ranked]]
    if len(ranked) < len(lms):  # the sentinel is nobody's predecessor
        ranked = np.concatenate([lms[-1:], ranked])

    follow = np.append(lms[1:], n - 1)
    slot = np.zeros(n, np.int64)
    slot[lms] = np.arange(len(lms))
    power = np.cumprod(np.full(n + 1, MIX[0]))
    back = np.cumprod(np.full(n + 1, np.uint64(pow(int(MIX[0]), -1, 1 << 64))))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((text + 1).astype(np.uint64) * power[:n])])
    ends = follow[slot[ranked]] + 1
    digest = (sums[ends] - sums[ranked]) * back[ranked]
    new = np.ones(len(ranked), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (np.diff(ends - ranked) != 0)
    names = np.empty(len(lms), np.int64)
    names[slot[ranked]] = np.cumsum(new)
    reach = 1
    while True:
        beyond = np.zeros(len(names), np.int64)
        beyond[: max(0, len(names) - reach)] = names[reach:]
        pair = names * (len(names) + 2) + beyond
        by = np.argsort(pair, kind="stable")
        if reach * 2 > most or names.max() == len(names):
            break
        fresh = np.ones(len(by), bool)
        fresh[1:] = pair[by][1:] != pair[by][:-1]
        names[by] = np.cumsum(fresh)
        reach *= 2

    sorted_lms = lms[by].astype(np.int32)
    eights = np.zeros(n, np.uint64)
    padded = np.append(np.minimum(text, 255).astype(np.uint64), np.zeros(8, np.uint64))
    for k in range(8):
        eights |= padded[k : k + n] << np.uint64(8 * k)
    prefix = np.zeros(len(lms), np.int32)
    prefix[1:] = shared(text, eights, sorted_lms[:-1].astype(np.int64), sorted_lms[1:].astype(np.int64), most)

    def seam(a, b):
        k = 0
        while k < most and text[min(a + k, n - 1)] == text[min(b + k, n - 1)] and max(a, b) + k < n:
            k += 1
        return k

    low, _ = induce(text, symbols, is_s, by_symbol(text, sorted_lms, prefix), True, memory, True, seam)
    high, joints = induce(text, symbols, is_s, backwards(low), False, memory, True, seam)
    found = np.zeros(n, bool)
    for at, lcp in [*low.values(), *high.values()]:
        near = np.flatnonzero(lcp >= window)
        found[at[near]] = True
        found[at[near - 1]] = True
    for a, b, lcp in joints:
        if lcp >= window:
            found[[a, b]] = True
    return found[:-1]


def solve(pieces: list[tuple[bytes, bool]], unit: Unit, memory: int = MEMORY) -> list[list[int]]:
    """Windows of each distinct piece that stand at another place: all of a piece that itself occurs again."""
    joined = b"\0".join(c.replace(b"\0", b"\1") if b"\0" in c else c for c, _ in pieces)
    text = np.frombuffer(joined, np.uint8).astype(np.int32) + 1
    if any(b"\0" in c or b"\1" in c for c, _ in pieces):  # bytes 0 and 1 occur: shift all real bytes above the separator
        text = np.concatenate([np.append(np.frombuffer(c, np.uint8).astype(np.int32) + 2, 1) for c, _ in pieces])[:-1]
    found, at, out = repeated(text, unit.window, memory), 0, []
    for content, many in pieces:
        windows = len(content) - unit.window + 1
        out.append(list(range(windows)) if many else np.flatnonzero(found[at : at + windows]).tolist())
        at += len(content) + 1
    return out


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Each row's bytes that no window standing elsewhere covers; see repeats.remove for nulls and repeated rows."""
    return remove(docs.select("doc_id", "text"), BYTES, solve, first_stays=False)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("n_units", "n_bytes")


OP5_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substring(x, 2 * i - 1, 400)) AS k
  FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 198)) AS i FROM b WHERE length(x) >= 400)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
bytes AS (SELECT doc_id, p, substring(x, 2 * p - 1, 2) AS y FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 + 1)) AS p FROM b)),
last AS (SELECT bytes.doc_id, p, y, coalesce(p - max(i) OVER (PARTITION BY bytes.doc_id ORDER BY p), 200) < 200 AS gone
  FROM bytes LEFT JOIN again ON again.doc_id = bytes.doc_id AND i = p),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS head FROM last),
done AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(y, '' ORDER BY p) FILTER (NOT gone) AS kept FROM runs GROUP BY doc_id)
SELECT b.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN done ON done.doc_id = b.doc_id
"""
