"""Personal data by bootstrapped contextual extraction.

The base identifiers of the texts are the seeds. What stands around them induces lexical patterns: the two units before,
the one before and the one after, or the one before alone. A unit is a white-space token without the punctuation at its
edges, or a run of such tokens of digits; whatever fills the slot of a good pattern can be an identifier, whatever its
shape. Patterns and instances are the two sides of a graph that is scored in turns:

* a pattern with SUPPORT different known instances in SUPPORT different texts gets, for its kind, the share of all its
  slots in the corpus that known instances fill; function words have slots everywhere, so their share is near 0;
* an unknown instance in slots of patterns of at least CONFIDENCE gets 1 - prod(1 - confidence), and counts only if
  SPECIFIC of all its own places in the corpus are such slots; so ordinary words drop out;
* the instances of at least SCORE are identifiers wherever they stand, and induce patterns in the next turn.

It ends when a turn brings no new pattern or no new instance. Each turn scans the texts, vectorised; only what stands at
a pattern or instance of the turn leaves a scan, which tasks know from a bitmap of bounded size, and an equality join
then drops what met the bitmap by chance. Slots are counted before they are fetched, and only slots of confident
patterns are fetched, so a hot pattern costs one row a batch. Patterns are known by a 64-bit hash of their words.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, table, texts, tidy, written

KINDS = ("email", "ip", "card", "phone")
#: Production parameters: least known instances and texts of a pattern, least confidence of a pattern, least share of an
#: instance's places that are confident slots, least score of an instance.
SUPPORT, CONFIDENCE, SPECIFIC, SCORE = 3, 0.25, 0.6, 0.6
#: Most bits of a bitmap, bits for each of its hashes, and bytes of text of one step of a scan.
BITS, SPARSE, STEP = 1 << 26, 16, 1 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
EDGE = "\"'`()[]{}<>,;:.!?*#$%&|=_~"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, found outwards from each @ so that time stays linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base identifiers, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


PRIME = np.uint64(0x9E3779B97F4A7C15)
#: What stands for a text's edges and for any unit of digits in a pattern.
BEGIN, END, NUMBER = np.uint64(0x1B873593), np.uint64(0x85EBCA6B), np.uint64(0xC2B2AE35)
_is = np.zeros((4, 256), bool)  # blank, edge, digit, letter
_is[0, [32, *range(9, 14)]] = True
_is[1, [ord(c) for c in EDGE]] = True
_is[2, 48:58] = True
_is[3, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Slots:
    """The units of a batch of texts: text, byte range, hash of the lower case, and hashes of the three patterns around."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        self.begins = np.cumsum([0] + [len(r) + 1 for r in raw])
        blank, edge, digit, letter = (k[joined] for k in _is)
        cuts = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        start, end = cuts[0::2], cuts[1::2]
        core = np.flatnonzero(~(blank | edge))
        i, j = np.searchsorted(core, start), np.searchsorted(core, end)
        has = j > i
        start[has], end[has] = core[i[has]], core[j[has] - 1] + 1
        within = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[end] - c[start]
        number = (within(digit) > 0) & (within(letter) == 0)
        text = np.searchsorted(self.begins, start, "right") - 1
        new = np.ones(len(start), bool)
        new[1:] = ~(number[1:] & number[:-1] & (text[1:] == text[:-1]))
        heads = np.flatnonzero(new)
        self.start, self.end = start[heads], end[np.append(heads[1:], len(start)) - 1] if len(heads) else end[:0]
        self.text, self.number = text[heads], number[heads]
        power = np.cumprod(np.full(len(joined) + 1, PRIME))
        back = np.cumprod(np.full(len(joined) + 1, np.uint64(pow(int(PRIME), -1, 1 << 64))))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOWER[joined].astype(np.uint64) + np.uint64(1)) * power[:-1])])
        self.hash = _mix((sums[self.end] - sums[self.start]) * back[self.start])
        self.first = np.searchsorted(self.text, np.arange(len(raw) + 1))
        self.word = np.where(self.number, NUMBER, self.hash)
        n = np.arange(len(heads))
        self.patterns = self.around(self.text, n - 1, n + 1)

    def around(self, text: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The three patterns of slots between the units left and right of these texts."""
        a, b = self.first[text], self.first[text + 1]
        padded = np.append(self.word, np.zeros(1, np.uint64))
        one, two = np.where(left >= a, padded[left], BEGIN), np.where(left - 1 >= a, padded[left - 1], BEGIN)
        after = np.where(right < b, padded[np.minimum(right, len(self.word))], END)
        k1, k2, k3 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
        return np.stack([_mix(two * k1 + one * k2 + np.uint64(1)), _mix(one * k2 + after * k3 + np.uint64(2)), _mix(one * k2 + np.uint64(3))]).view(np.int64)

    def place(self, k: int) -> tuple[int, int]:
        """Code points of unit k in its text."""
        raw, at = self.raw[self.text[k]], int(self.begins[self.text[k]])
        a = len(raw[: int(self.start[k]) - at].decode(errors="ignore"))
        return a, a + len(self.body(k))

    def body(self, k: int) -> str:
        at = int(self.begins[self.text[k]])
        return self.raw[self.text[k]][int(self.start[k]) - at : int(self.end[k]) - at].decode(errors="ignore")


def seeds(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """instance, kind and patterns of each base identifier of a text."""
    if not base:
        return []
    raw = text.encode()
    slots = Slots([raw])
    at = [(len(text[:a].encode()), len(text[:b].encode())) for a, _, b in base]
    left = np.searchsorted(slots.end, [a for a, _ in at], "right") - 1
    right = np.searchsorted(slots.start, [b for _, b in at])
    around = slots.around(np.zeros(len(base), np.int64), left, right)
    return [{"instance": text[a:b], "kind": KINDS[k], "patterns": around[:, i].tolist()} for i, (a, k, b) in enumerate(base)]


def digest(raw: bytes) -> tuple[int, int]:
    """128 bits of the SHA-256 of a text: what spans of equal texts are known by."""
    d = hashlib.sha256(raw).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:16], "big", signed=True)


SPAN = "struct<start:bigint,ord:int,end:bigint>"
ROWS = f"doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base array<{SPAN}>, seen array<struct<instance:string,kind:string,patterns:array<bigint>>>, t1 bigint, t2 bigint"


def scan(docs: DataFrame) -> DataFrame:
    """A written table of ROWS for every row of docs."""

    def step(batch):
        rows = []
        for key, raw in zip(batch.column("__key").to_pylist(), texts(batch.column("__text"))):
            text = raw.decode()
            base = base_spans(text)
            n = [sum(k == i for _, k, _ in base) for i in range(4)]
            said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
            rows.append((key, *n, hashlib.sha256(said.encode()).hexdigest(), [{"start": a, "ord": k, "end": b} for a, k, b in base], seeds(text, base), *digest(raw)))
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "seen", "t1", "t2"]
        return dict(zip(names, zip(*rows)))

    given = docs.select(F.col("doc_id").cast("bigint").alias("__key"), F.col("text").cast("string").alias("__text"))
    return written(arrow_pass(given, step, ROWS), "pii-rows")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits at the hashes (hash) modulo their number, a power of two of at most BITS; the driver gets BITS / 64 rows at most."""
    n, bits = hashes.count(), 1 << 10
    while bits < min(n * SPARSE, BITS):
        bits *= 2
    slot = hashes.select(F.pmod("hash", F.lit(bits)).alias("s"))
    words = slot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint64)


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63).view(np.uint64) & np.uint64(1)).astype(bool)


def totals(docs: DataFrame, asked: DataFrame, what: str) -> DataFrame:
    """A written table (hash, total): how often each asked hash (hash) is the pattern or, with what "hash", the unit of a slot."""
    bits = bitmap(asked)

    def step(batch):
        slots = Slots(texts(batch.column(0)))
        each = slots.patterns.ravel() if what == "patterns" else slots.hash.view(np.int64)
        hashes, n = np.unique(each[marked(bits, each)], return_counts=True)
        return {"hash": hashes, "total": n}

    found = arrow_pass(docs.select(F.col("text").cast("string")), step, "hash bigint, total bigint", STEP)
    return written(found.groupBy("hash").agg(F.sum("total").alias("total")).join(asked, "hash", "left_semi"), "pii-totals")


PLACES = "t1 bigint, t2 bigint, start bigint, end bigint, instance string, hash bigint, patterns array<bigint>"


def places(docs: DataFrame, asked: DataFrame, what: str) -> DataFrame:
    """PLACES with n: the slots at asked hashes (or at ones that meet the bitmap by chance) that no base identifier
    touches, once for equal texts, which n counts."""
    bits = bitmap(asked)

    def step(batch):
        raw = texts(batch.column(0))
        slots, out = Slots(raw), []
        hit = marked(bits, slots.patterns).any(0) if what == "patterns" else marked(bits, slots.hash.view(np.int64))
        at, base, key = -1, [], None
        for k in np.flatnonzero(hit).tolist():
            if slots.text[k] != at:
                at = int(slots.text[k])
                base, key = base_spans(raw[at].decode()), digest(raw[at])
            a, b = slots.place(k)
            if not any(x < b and a < y for x, _, y in base):
                out.append((*key, a, b, slots.body(k), int(slots.hash[k].view(np.int64)), slots.patterns[:, k].tolist()))
        return dict(zip(["t1", "t2", "start", "end", "instance", "hash", "patterns"], zip(*out) if out else [()] * 7))

    each = arrow_pass(docs.select(F.col("text").cast("string")), step, PLACES, STEP)
    return each.groupBy(*each.columns).agg(F.count("*").alias("n"))


def bootstrap(docs: DataFrame, rows: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, specific: float = SPECIFIC, score: float = SCORE) -> tuple[DataFrame | None, DataFrame]:
    """(found: PLACES with kind and score, None if there are none; patterns: hash, kind, confidence) that the seeds of rows lead to."""
    spark = docs.sparkSession
    known = rows.select("t1", "t2", F.explode("seen").alias("s")).select("t1", "t2", "s.instance", "s.kind", F.lit(1.0).alias("score"), "s.patterns")
    known = known.groupBy(*known.columns).agg(F.count("*").alias("n"))
    known = written(known, "pii-known")
    counted, patterns, found = None, spark.createDataFrame([], "hash bigint, kind string, confidence double"), None
    while True:
        edges = known.select("t1", "t2", "instance", "kind", "score", "n", F.explode("patterns").alias("hash"))
        induced = edges.groupBy("hash", "kind").agg(F.sum(F.col("score") * F.col("n")).alias("hits"), F.count_distinct("instance").alias("i"), F.count_distinct("t1", "t2").alias("t"))
        induced = written(induced.filter((F.col("i") >= support) & (F.col("t") >= support)).select("hash", "kind", "hits"), "pii-induced")
        fresh = induced.select("hash").distinct()
        fresh = fresh if counted is None else fresh.join(counted, "hash", "left_anti")
        if fresh.take(1):
            more = totals(docs, written(fresh, "pii-fresh"), "patterns")
            counted = more if counted is None else written(counted.unionByName(more), "pii-counted")
        if counted is None:
            return found, patterns
        sure = F.least(F.lit(1.0), F.col("hits") / (F.col("total") + 1))
        good = written(induced.join(counted, "hash").select("hash", "kind", sure.alias("confidence")).filter(F.col("confidence") >= confidence), "pii-patterns")
        fresh = good.select("hash").distinct().join(patterns.select("hash").distinct(), "hash", "left_anti")
        patterns = good
        if not fresh.take(1):
            return found, patterns
        asked = written(good.select("hash").distinct(), "pii-asked")
        slots = places(docs, asked, "patterns").select("t1", "t2", "start", "instance", "n", F.col("hash").alias("own"), F.explode(F.array_distinct("patterns")).alias("hash"))
        slots = written(slots.join(good, "hash"), "pii-slots")
        best = slots.groupBy("instance", "own", "kind", "hash").agg(F.max("confidence").alias("c")).groupBy("instance", "own", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("c", F.lit(0.999999)))))).alias("score"))
        best = best.groupBy("instance", "own").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", F.col("own").alias("hash"), "b.kind", "b.score").filter(F.col("score") >= score)
        inside = slots.groupBy("t1", "t2", "start", F.col("own").alias("hash")).agg(F.max("n").alias("n")).groupBy("hash").agg(F.sum("n").alias("inside"))
        new = best if found is None else best.join(found.select("instance").distinct(), "instance", "left_anti")
        new = written(new.join(inside, "hash"), "pii-new")
        if not new.take(1):
            return found, patterns
        all_of = totals(docs, new.select("hash").distinct(), "hash")
        new = written(new.join(all_of, "hash").filter(F.col("inside") >= specific * F.col("total")).select("instance", "hash", "kind", "score"), "pii-sure")
        if not new.take(1):
            return found, patterns
        more = places(docs, new.select("hash").distinct(), "hash").drop("hash").join(new.drop("hash"), "instance")
        found = written(more if found is None else more.unionByName(found.select(more.columns)), "pii-found")
        known = written(known.unionByName(more.select(known.columns)), "pii-known")


def _found(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(t1, t2, found): the spans that the method adds to texts; None if it adds none."""
    found, _ = bootstrap(docs.select("text").filter("text IS NOT NULL"), rows)
    if found is None:
        return None
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    return found.groupBy("t1", "t2").agg(F.collect_set(F.struct(F.col("start"), place.alias("ord"), F.col("end"))).alias("found"))


@tidy
def identify(docs: DataFrame) -> DataFrame:
    """Every row of docs with counts and digest of its base spans and `all`, its base and found spans in order.

    A null or empty text has no spans; a very long one is a step of its own; repeated rows are kept; an empty table
    gives an empty one; other columns of docs are dropped.
    """
    rows = scan(docs)
    spans = _found(docs, rows)
    if spans is None:
        return rows.drop("seen", "t1", "t2").withColumn("all", F.col("base"))
    both = rows.drop("seen").join(spans, ["t1", "t2"], "left").drop("t1", "t2")
    return both.withColumn("all", F.array_sort(F.concat("base", F.coalesce("found", F.expr(f"cast(array() AS array<{SPAN}>)"))))).drop("found")


@tidy
def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets; columns and rows stay as they are."""
    names = docs.columns
    spans = _found(docs, scan(docs.select("doc_id", "text")))
    given = docs.select(F.struct(*[F.col(f"`{n}`") for n in names if n != "text"]).alias("doc"), F.col("text").cast("string").alias("text"))
    if spans is None:
        given = given.withColumn("found", F.expr(f"cast(NULL AS array<{SPAN}>)"))
    else:
        half = lambda k: F.conv(F.substring(F.sha2("text", 256), 1 + 16 * k, 16), 16, -10).cast("bigint")
        given = given.withColumns({"t1": half(0), "t2": half(1)}).join(spans, ["t1", "t2"], "left").select("doc", "text", "found")

    def step(batch):
        out = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            parts, at = [], 0
            for a, k, b in sorted(base_spans(text) + [(s["start"], s["ord"], s["end"]) for s in found or ()]) if text is not None else ():
                if b > at:
                    parts += [text[at : max(at, a)], f"[{KINDS[k].upper()}]" if a >= at else ""]
                    at = b
            out.append(None if text is None else "".join(parts) + text[at:])
        return {"doc": batch.column("doc"), "text": out}

    schema = T.StructType([given.schema["doc"], given.schema["text"]])
    masked = arrow_pass(given, step, schema)
    return masked.select(*[F.col("text" if n == "text" else f"doc.`{n}`").cast(docs.schema[n].dataType).alias(n) for n in names])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identify(table(spark, sf_dir, "documents"))
    kind = F.array(*map(F.lit, KINDS))
    said = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.get(kind, s["ord"]), s["start"], s["end"])), ",")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", said.alias("spans"))
