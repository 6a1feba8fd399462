"""Repeated windows of a corpus, found without moving all windows: what both substring operators share.

A window's anchor is the least hash of the k-grams inside it, so equal windows have equal anchors wherever they stand.
Anchors that occur only once are dropped after one pre-aggregated count; what stands around the others is cut into
pieces, runs of windows with one anchor. Equal pieces collapse to their first occurrence, and each distinct piece goes
to the shard of its anchor, where the operator's own index (suffix automaton, suffix order) decides window by window.
The pieces of a frequent anchor are cut further, into bands, by where the anchor stands in a window, and dealt
by the stretch around the anchor that all windows of such a band hold; so no shard grows with a hot passage.

Texts that repeat as a whole are one text to all of this; only their counts differ. They are known by 128 bits of their
SHA-256, as equal pieces are by 128 bits of a hash of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, texts, tidy, written

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
#: Levels of an anchor: occurrences above which it has the level, and bands that its windows are cut into at least.
LEVELS = ((0, 0), (2_000, 4), (200_000, 8))
FAR = (1 << 63) - 1
#: Text that one step of a pass holds as arrays of 8 bytes a unit.
STEP = 2 << 20


@dataclass(frozen=True)
class Unit:
    """How texts are cut: words or bytes; a window has `window` of them, an anchor `gram`; shards hold `shard` units."""

    words: bool
    window: int
    gram: int
    shard: int

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * MIX[1]
    return x ^ x >> np.uint64(29)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return x if size == width else pick(x[: len(x) - (width - size)], x[width - size :])


def grams(x: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of every `width` neighbours, by doubling."""
    out, have, power, part, step = None, 0, MIX[0], x, 1
    while width:
        if width & 1:
            out = part if out is None else out[: len(x) - have - step + 1] * power + part[have : len(x) - step + 1]
            have += step
        width >>= 1
        if width:
            part = part[:-step] * power + part[step:]
            power = power * power
            step *= 2
    return out


class Texts:
    """Texts of a batch as one array of units, with the hash of each unit."""

    def __init__(self, raw: list[bytes], unit: Unit):
        self.unit, self.raw = unit, raw
        joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        begins = np.cumsum([0] + [len(r) + 1 for r in raw])
        if unit.words:
            blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
            edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
            self.starts, self.ends = edge[0::2], edge[1::2]
            power = np.cumprod(np.full(len(joined) + 1, MIX[0]))
            sums = np.concatenate([[np.uint64(0)], np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[:-1])])
            inverse = np.uint64(pow(int(MIX[0]), -1, 1 << 64))
            back = np.cumprod(np.full(len(joined) + 1, inverse))
            self.hashes = mixed((sums[self.ends] - sums[self.starts]) * back[self.starts])
        else:
            self.starts = np.delete(np.arange(len(joined)), begins[1:] - 1)
            self.hashes = mixed(joined[self.starts].astype(np.uint64) + np.uint64(1))
        self.doc = np.searchsorted(begins, self.starts, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(raw) + 1))
        self.joined, self.begins = joined, begins

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of every gram, anchor of every window (0 where a text ends inside), and which windows are whole."""
        unit, n = self.unit, len(self.hashes)
        if n < unit.window:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        g = mixed(grams(self.hashes, unit.gram)) | np.uint64(1)
        low = sliding(g, unit.span, np.minimum)
        whole = self.doc[: n - unit.window + 1] == self.doc[unit.window - 1 :]
        return g, np.where(whole, low, np.uint64(0)), whole

    def marks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(distinct anchors, whether the anchor's gram stands at more than one place) of every text."""
        g, low, _ = self.anchors()
        pad = np.zeros(self.unit.span - 1, np.uint64)
        at = np.flatnonzero(g == sliding(np.concatenate([pad, low, pad]), self.unit.span, np.maximum)[: len(g)]) if len(g) else np.zeros(0, np.int64)
        doc, value = self.doc[at], g[at]
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        heads = np.flatnonzero(new)
        more = np.diff(np.append(heads, len(at))) > 1
        cut = np.searchsorted(doc[heads], np.arange(len(self.raw) + 1))
        return [(value[heads[a:b]].view(np.int64), more[a:b]) for a, b in zip(cut, cut[1:])]

    def pieces(self, hits: list[dict[int, int]]) -> dict:
        """Runs of whole windows that share an anchor among the text's hits (anchor to its level); see LEVELS."""
        unit = self.unit
        g, low, _ = self.anchors()
        out = {n: [] for n in ("text", "start", "windows", "anchor", "route", "content")}
        signed = low.view(np.int64)
        for k, own in enumerate(hits):
            a, b = int(self.first[k]), int(self.first[k + 1]) - unit.window + 1
            if b <= a or not own:
                continue
            mine = signed[a:b]
            cuts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            stops = np.append(cuts[1:], len(mine))
            keep = np.isin(mine[cuts], np.fromiter(own, np.int64, len(own)))
            for s, e in zip(cuts[keep].tolist(), stops[keep].tolist()):
                anchor = int(mine[s])
                for start, end, core in self.bands(g, a, s, e, own[anchor]):
                    out["text"].append(k)
                    out["start"].append(start)
                    out["windows"].append(end - start)
                    out["anchor"].append(anchor)
                    out["route"].append(xxhash.xxh64_intdigest(self.cut(k, *core)) - (1 << 63) if core else 0)
                    out["content"].append(self.cut(k, start, end + unit.window - 1))
        return out

    def bands(self, g: np.ndarray, at: int, s: int, e: int, level: int):
        """(start, end, core) of the run of windows s to e of the text at unit `at`, cut by where the anchor stands in them.

        A band holds the windows whose first anchor gram stands at one of `width` neighbouring offsets; all of them hold
        its core, a stretch that stands at the same place from the anchor, so equal windows have equal cores.
        """
        if not level:
            yield s, e, None
            return
        unit = self.unit
        width = max(1, unit.window // LEVELS[level][1])
        views = np.lib.stride_tricks.sliding_window_view(g[at + s : at + e + unit.span - 1], unit.span)
        offset = views.argmin(1)
        place, band = offset + np.arange(s, e), offset // width
        cuts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (band[1:] != band[:-1])])).tolist()
        for i, j in zip(cuts, cuts[1:] + [e - s]):
            head = int(place[i] - band[i] * width)
            yield s + i, s + j, (head, head - width + 1 + unit.window)

    def cut(self, k: int, start: int, end: int) -> bytes:
        """Units start to end of text k: words joined by one space, or bytes."""
        at = int(self.first[k])
        if not self.unit.words:
            return self.raw[k][start:end]
        return b" ".join([self.joined[s:e].tobytes() for s, e in zip(self.starts[at + start : at + end].tolist(), self.ends[at + start : at + end].tolist())])


def whole_digest(raw: bytes, unit: Unit) -> str:
    return hashlib.sha256(b" ".join(raw.split()) if unit.words else raw).hexdigest()


def kept(raw: bytes, spans: list[tuple[int, int]], unit: Unit) -> tuple[int, int, str]:
    """Units removed, maximal removed runs, and the digest of what is left."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    units = raw.split() if unit.words else raw
    parts, at = [], 0
    for a, b in merged:
        parts.append(units[at:a])
        at = b
    parts.append(units[at:])
    left = b" ".join([w for p in parts for w in p]) if unit.words else b"".join(parts)
    return sum(b - a for a, b in merged), len(merged), hashlib.sha256(left).hexdigest()


Solver = Callable[[list[tuple[bytes, bool]], Unit], list[list[int]]]


@tidy
def remove(docs: DataFrame, unit: Unit, solve: Solver, first_stays: bool) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept_sha256) of every row of docs (doc_id, text).

    A unit goes if a window over it also stands elsewhere: earlier if first_stays, else anywhere. solve gets a shard's
    distinct pieces in corpus order, each with whether it occurs more than once, and returns the windows of each piece
    that other places hold. Null texts are empty; a very long text is a step of its own; null ids come last; rows that
    repeat an id or a whole text are rows of their own; an empty table gives an empty one; other columns are dropped.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FAR))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("place"), body.alias("text"))
    half = lambda k: F.conv(F.substring(F.sha2("text", 256), 1 + 16 * k, 16), 16, -10).cast("bigint")
    given = given.withColumns({"h1": half(0), "h2": half(1)})

    def measure(batch):
        raw = texts(batch.column("text"))
        own = Texts(raw, unit)
        marks = own.marks()
        return {n: batch.column(n) for n in ("doc_id", "place", "h1", "h2")} | {
            "n_units": own.counts(), "whole": [whole_digest(r, unit) for r in raw], "anchors": [m[0] for m in marks], "self": [m[1] for m in marks],
        }

    rows = arrow_pass(given, measure, "doc_id bigint, place bigint, h1 bigint, h2 bigint, n_units bigint, whole string, anchors array<bigint>, self array<boolean>", STEP)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "repeats-rows")
    heads = rows.groupBy("h1", "h2").agg(F.min(F.struct("place", "row")).alias("f"), F.count("*").alias("copies"))
    heads = written(heads.select("h1", "h2", F.col("f.place").alias("place"), F.col("f.row").alias("head"), "copies"), "repeats-heads")

    marks = rows.select("h1", "h2", F.explode(F.arrays_zip("anchors", "self")).alias("m")).select("h1", "h2", F.col("m.anchors").alias("anchor"), F.col("m.self").alias("self"))
    seen = marks.groupBy("anchor").agg(F.min("h1").alias("least"), F.max("h1").alias("most"), F.max("self").alias("self"), F.count("*").alias("n"))
    again = written(seen.filter((F.col("least") < F.col("most")) | F.col("self")).select("anchor", F.when(F.col("n") > LEVELS[2][0], 2).when(F.col("n") > LEVELS[1][0], 1).otherwise(0).alias("level")), "repeats-anchors")
    hits = marks.select("h1", "h2", "anchor").join(again, "anchor").groupBy("h1", "h2").agg(F.collect_set(F.struct("anchor", "level")).alias("hits"))
    hits = written(hits, "repeats-hits")
    hits = hits.join(heads.drop("copies"), ["h1", "h2"]).withColumnsRenamed({"h1": "t1", "h2": "t2", "place": "t3"})

    def own_rows(side):
        same = (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")) & (F.col("place") == F.col("t3"))
        return given.select("place", "h1", "h2", "text").join(side, same).drop("t1", "t2", "t3", "h1", "h2")

    def cut(batch):
        hit = [{h["anchor"]: h["level"] for h in x} for x in batch.column("hits").to_pylist()]
        out = Texts(texts(batch.column("text")), unit).pieces(hit)
        at = np.array(out.pop("text"), np.int64)
        hashes = [xxhash.xxh3_128_intdigest(c) for c in out["content"]]
        return out | {
            "place": batch.column("place").to_numpy()[at], "head": batch.column("head").to_numpy()[at],
            "c1": np.array([h >> 64 for h in hashes], np.uint64).view(np.int64), "c2": np.array([h & (1 << 64) - 1 for h in hashes], np.uint64).view(np.int64),
        }

    pieces = arrow_pass(own_rows(hits), cut, "place bigint, head bigint, start bigint, windows bigint, anchor bigint, route bigint, c1 bigint, c2 bigint, content binary", STEP)
    pieces = written(pieces, "repeats-pieces")
    where = F.struct("place", "head", "start", "windows", "content")
    firsts = pieces.groupBy("anchor", "route", "c1", "c2").agg(F.min(where).alias("f"), F.max(F.struct("head", "start")).alias("l"), F.min(F.struct("head", "start")).alias("m"))
    firsts = firsts.select("anchor", "route", "f.*", (F.col("l") != F.col("m")).alias("many"))
    firsts = written(firsts, "repeats-firsts")
    units = firsts.agg(F.sum(F.col("windows") + unit.window - 1)).first()[0] or 0
    shards = max(1, units // unit.shard)
    dealt = firsts.withColumn("shard", F.pmod(F.xxhash64("anchor", "route"), F.lit(shards)))

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("head", "ascending"), ("start", "ascending")])
        found = solve(list(zip(table["content"].to_pylist(), table["many"].to_pylist())), unit)
        out = {"head": [], "from": [], "to": []}
        for head, start, windows in zip(table["head"].to_pylist(), table["start"].to_pylist(), found):
            i = 0
            while i < len(windows):
                j = i
                while j + 1 < len(windows) and windows[j + 1] == windows[j] + 1:
                    j += 1
                out["head"].append(head)
                out["from"].append(start + windows[i])
                out["to"].append(start + windows[j] + unit.window)
                i = j + 1
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    partly = dealt.select("shard", "place", "head", "start", "content", "many").groupBy("shard").applyInArrow(decide, "head bigint, from bigint, to bigint")
    later = pieces.select("head", "start", "windows").join(firsts.select("head", "start"), ["head", "start"], "left_anti")
    later = later.select("head", F.col("start").alias("from"), (F.col("start") + F.col("windows") + (unit.window - 1)).alias("to"))
    spans = partly.unionByName(later).groupBy("head").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    spans = written(spans, "repeats-spans")
    side = heads.join(spans, "head").select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), F.col("place").alias("t3"), "head", "spans")

    def trim(batch):
        got = [kept(r, [(s["from"], s["to"]) for s in x], unit) for r, x in zip(texts(batch.column("text")), batch.column("spans").to_pylist())]
        return {"head": batch.column("head")} | dict(zip(["removed", "runs", "left"], zip(*got)))

    trimmed = arrow_pass(own_rows(side), trim, "head bigint, removed bigint, runs bigint, left string", STEP).dropDuplicates(["head"])
    trimmed = written(heads.join(trimmed, "head", "left"), "repeats-trimmed")
    out = rows.drop("anchors", "self").join(trimmed.drop("place"), ["h1", "h2"])
    copied = F.col("row") != F.col("head") if first_stays else F.col("copies") > 1
    gone = copied & (F.col("n_units") >= unit.window)
    return out.select(
        "doc_id", "n_units",
        F.when(gone, F.col("n_units")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left", "whole")).alias("kept_sha256"),
    )
