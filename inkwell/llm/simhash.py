"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a ring of equal segments. If two fingerprints differ in at most `most` bits, some segment starts
a chain in which every prefix of l segments differs in at most l * most / m bits, m being the number of segments. The
first segments of such a chain must mostly agree, which gives the index keys; a pair that shares a key must then pass
the chain test of its start before the full Hamming check.

Texts with equal fingerprints are one node, so groups of copies cost one row. Key buckets above BLOCK rows are split
into pairs of blocks, each compared in a task of its own; a bucket yields a star for each linked cluster, never all
pairs. Components are joined by alternating star contraction, each half written to the shared folder.

Few near copies differ in so few bits, so `drop_near_copies` links more than op6 does: pairs that share a MinHash band
are candidates, and those whose sets of five-word shingles have a Jaccard similarity of ALIKE or more are linked too.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, table, texts, tidy, written

#: Words of a shingle, seed of its hash, and most differing bits of a link.
SHINGLE, SEED, MOST = 4, 42, 4
#: Words of a shingle and least Jaccard similarity of near copies; bands and minima of a band, which miss a pair at
#: ALIKE with probability (1 - ALIKE ** MINIMA) ** BANDS, below 0.0001.
WORDS, ALIKE, BANDS, MINIMA = 5, 0.8, 24, 5
#: Classes of shingle hashes by which common shingles are counted, a power of two.
CLASSES = 64
#: Columns of one text of a pair, and their names in the pair.
HUB = {"node": "x", "root": "a", "n": "m", "common": "theirs"}
#: Bits of the broadcast bitmap of row numbers for each of them, and at most: BITS / 64 rows are broadcast.
SPARSE, BITS = 16, 1 << 24
#: Text of a step that holds sets of shingles.
SETS_BYTES = 1 << 20
_RANDOM = np.random.default_rng(SEED)
FACTORS, SHIFTS = (_RANDOM.integers(0, 1 << 64, (BANDS * MINIMA, 1), np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)
#: Rows of a key bucket that one task compares at once.
BLOCK = 1024
#: (segments of the ring, segments that every chain shares exactly, segments after them, how many of those agree), by
#: the distinct fingerprints up to which the key's bits keep buckets small.
FAMILIES = [(1 << 22, (8, 1, 2, 1)), (1 << 64, (16, 3, 4, 3))]


def fingerprint(raw: bytes) -> int:
    """The unsigned fingerprint of a text's lower-cased words."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: bool = False) -> DataFrame:
    """(doc_id, fp) of every row of docs, fp as a signed long; with keep, all columns of docs in a struct `doc` too."""
    kept = [F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc")] if keep else []
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)

    def step(batch):
        fp = np.array([fingerprint(t) for t in texts(batch.column("text"))], np.uint64).view(np.int64)
        return {n: batch.column(n) for n in batch.schema.names} | {"fp": fp}

    schema = T.StructType([*given.drop("text").schema.fields, T.StructField("fp", T.LongType())])
    return arrow_pass(given, step, schema)


def chain_keys(count: int) -> tuple[int, list[tuple[int, tuple[int, ...]]]]:
    """Segments of the ring, and (start, segments that agree) of every key, for so many distinct fingerprints."""
    m, exact, after, agree = next(f for most, f in FAMILIES if count <= most)
    return m, [(i, tuple((i + k) % m for k in (*range(exact), *(exact + c for c in some)))) for i in range(m) for some in combinations(range(after), agree)]


def passes(a: np.ndarray, b: np.ndarray, starts: np.ndarray, m: int, most: int) -> np.ndarray:
    """Which pairs stay within the proportional budget over every prefix of the chain from their start."""
    width = 64 // m
    diff, mask = a ^ b, np.uint64((1 << width) - 1)
    total, ok = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for k in range(m):
        total += np.bitwise_count(diff >> (((starts + k) % m) * width).astype(np.uint64) & mask)
        ok &= total * m <= (k + 1) * most
    return ok


def links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links between distinct fingerprints of nodes (fp), enough of them to connect all that differ by `most` bits."""
    if most > MOST:
        raise ValueError(f"the chain keys hold for at most {MOST} differing bits")
    count = nodes.count()
    m, keys = chain_keys(count)
    width = 64 // m

    def expand(batch):
        fp = batch.column(0).to_numpy().view(np.uint64)
        seg = np.stack([fp >> np.uint64(j * width) & np.uint64((1 << width) - 1) for j in range(m)])
        out = np.empty((len(keys), len(fp)), np.uint64)
        for k, (_, own) in enumerate(keys):
            out[k] = k
            for j in own:
                out[k] = out[k] << np.uint64(width) | seg[j]
        return {"key": out.ravel().view(np.int64), "fp": np.tile(fp, len(keys)).view(np.int64)}

    keyed = written(arrow_pass(nodes.select("fp"), expand, "key bigint, fp bigint"), "simhash-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
    blocks = written(sizes.filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "simhash-hot")
    dealt = keyed.join(blocks, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda x: F.least(x, "own").cast("bigint") * (1 << 31) + F.greatest(x, "own"))
    dealt = dealt.select("key", F.explode(pair).alias("pair"), "fp").repartition("key", "pair").sortWithinPartitions("key", "pair", "fp")
    shift, start_of = np.uint64(width * len(keys[0][1])), np.array([i for i, _ in keys])

    def compare(batches):
        rest = None
        for batch in batches:
            cols = [batch.column(n).to_numpy() for n in ("key", "pair", "fp")]
            cols = [np.concatenate(x) for x in zip(rest, cols)] if rest is not None else cols
            if not len(cols[0]):
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.argmax(same))
            rest = [c[cut:] for c in cols]
            yield from clusters(*[c[:cut] for c in cols])
        if rest is not None:
            yield from clusters(*rest)

    def clusters(key, pair, fp):
        found, i, d = [], np.arange(len(fp)), 1
        value, start = fp.view(np.uint64), start_of[(key.view(np.uint64) >> shift).astype(np.int64)]
        while True:
            i = i[i + d < len(fp)]
            i = i[(key[i] == key[i + d]) & (pair[i] == pair[i + d])]
            if not len(i):
                break
            ok = i[passes(value[i], value[i + d], start[i], m, most)]
            ok = ok[np.bitwise_count(value[ok] ^ value[ok + d]) <= most]
            found.append(np.stack([ok, ok + d]))
            d += 1
        if found and found[0].shape[1] + sum(f.shape[1] for f in found[1:]):
            a, b = forest(*np.concatenate(found, 1), len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return dealt.mapInArrow(compare, "a bigint, b bigint").filter("a <> b")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for the members other than roots of the components of links between n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        while (nxt != nxt[nxt]).any():
            nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    own = np.flatnonzero(root != np.arange(n))
    return own, root[own]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by alternating large and small stars."""
    edges, before = written(edges.distinct(), "simhash-edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = _star(both, F.col("b") > F.col("a"))
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = _star(down, F.lit(True))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _star(pairs: DataFrame, moved) -> DataFrame:
    """Link the moved neighbours of each node, and the node itself, to the smallest of the node and its neighbours."""
    lows = written(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "simhash-lows")
    joined = pairs.filter(moved).join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return written(joined.unionByName(lows.select("a", F.col("low").alias("b"))).filter("a <> b").distinct(), "simhash-edges")


def rooted(rows: DataFrame, most: int = MOST) -> DataFrame:
    """A written table (fp, low, root): each fingerprint of rows, its smallest doc_id, and its component."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = written(components(links(nodes, most)), "simhash-roots")
    return written(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-placed")


def grouped(rows: DataFrame, most: int = MOST) -> DataFrame:
    """rows, a written table with doc_id and fp, with component_id: the smallest doc_id reachable by links.

    Null ids are linked like others but never the smallest while another id is there; repeated rows share a component;
    texts without words have fingerprint 0 and are linked like any other.
    """
    placed = rooted(rows, most)
    lowest = written(placed.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lowest")
    named = written(placed.join(lowest, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp", "left")


def shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles; a shorter text is one shingle."""
    words = raw.lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + WORDS]), SEED) for i in range(max(1, len(words) - WORDS + 1))] if words else [], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a set of shingles: one for each band of minima."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12)] * FACTORS + SHIFTS).min(1))
    raw = least.reshape(BANDS, MINIMA)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(raw)]


def banded(rows: DataFrame) -> DataFrame:
    """(node, fp, n, keys): the bands of each distinct text of rows (row, fp, text), and its shingles' number."""

    def step(batch):
        sets = [(raw, shingles(raw)) for raw in texts(batch.column("text"))]
        digest = [xxhash.xxh64_intdigest(b" ".join(raw.lower().split())) - (1 << 63) for raw, _ in sets]
        keys = [bands(h) if len(h) else [] for _, h in sets]
        return {"node": batch.column("row"), "fp": batch.column("fp"), "digest": digest, "n": [len(h) for _, h in sets], "keys": keys}

    # equal words give equal fingerprints, so one row stands for all copies
    schema = "node bigint, fp bigint, digest bigint, n bigint, keys array<bigint>"
    return arrow_pass(rows, step, schema, SETS_BYTES).dropDuplicates(["digest", "fp"]).drop("digest")


def sieved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with `may`, which is true for each row in ids (row, a written table) and for few others.

    So rows that need no exact join stay where they are. The bitmap of row numbers that is broadcast has at most BITS bits;
    where ids are so many that it fills, more rows go through the exact join.
    """
    n, bits = ids.count(), 1 << 10
    while bits < min(n * SPARSE, BITS):
        bits *= 2
    slot = F.pmod(F.xxhash64("row"), F.lit(bits))
    own = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(own).alias("mask"))
    given = rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6))
    given = given.join(F.broadcast(written(words, "simhash-words")), "word", "left")
    return given.withColumn("may", F.coalesce(F.col("mask").bitwiseAND(own) != 0, F.lit(False))).drop("slot", "word", "mask")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the roots of those pairs (x, y, a, b), a written table, whose sets (node, hashes) reach ALIKE.

    Only the sets of nodes in a pair are moved, so the work follows the pairs and not the corpus.
    """
    asked = written(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "simhash-asked")
    own = written(sets.select("node", "hashes").join(asked, "node", "left_semi"), "simhash-own")
    given = pairs.join(own.toDF("x", "left"), "x").join(own.toDF("y", "right"), "y").select("a", "b", "left", "right")

    def step(batch):
        close = []
        for one, two in zip(batch.column("left"), batch.column("right")):
            one, two = one.values.to_numpy(), two.values.to_numpy()
            both = len(np.intersect1d(one, two, True))
            close.append(both >= ALIKE * (len(one) + len(two) - both))
        return {"a": batch.column("a"), "b": batch.column("b"), "close": close}

    return arrow_pass(given, step, "a bigint, b bigint, close boolean", SETS_BYTES).filter("close").select("a", "b")


def shared(nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes, texts of rows: a written table (node, sizes, hashes) of its shingles, their number by class of hashes; and
    (node, lone, common): how many of them no other node has, and how many of the rest fall in each class.

    Two texts share at most the sum over classes of the smaller count, so the pair of counts rules out most pairs that
    miss ALIKE; a hash that two shingles share only makes that bound looser.
    """

    def step(batch):
        sets = [shingles(raw) for raw in texts(batch.column("text"))]
        sizes = [np.bincount((h % CLASSES).astype(np.int64), minlength=CLASSES) for h in sets]
        return {"node": batch.column("row"), "sizes": sizes, "hashes": [h.view(np.int64) for h in sets]}

    nodes = written(nodes.withColumnRenamed("node", "row"), "simhash-asked")
    given = sieved(rows.select("row", "text"), nodes).filter("may").join(nodes, "row", "left_semi").select("row", "text")
    sets = written(arrow_pass(given, step, "node bigint, sizes array<int>, hashes array<bigint>", SETS_BYTES), "simhash-sets")
    once = sets.select(F.explode("hashes").alias("hash"), "node").groupBy("hash").agg(F.count("*").alias("texts"), F.min("node").alias("node")).filter("texts = 1")
    by_class = once.groupBy("node", F.col("hash").bitwiseAND(CLASSES - 1).cast("int").alias("class")).agg(F.count("*").cast("int").alias("n"))
    lone = by_class.groupBy("node").agg(F.sum("n").alias("lone"), F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("own"))
    own = lambda k: F.coalesce(F.try_element_at("own", k), F.lit(0))
    common = F.transform("sizes", lambda n, k: n - own(k))
    return sets, sets.drop("hashes").join(lone, "node", "left").select("node", F.coalesce("lone", F.lit(0)).alias("lone"), common.alias("common"))


def in_blocks(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """placed (key, node) twice, with block numbers i and j: rows of both that share key, i and j are all pairs of a key,
    each once, and a key of more than BLOCK rows is many such cells."""
    sizes = placed.groupBy("key").agg(F.count("*").alias("rows"))
    hot = sizes.filter(F.col("rows") > BLOCK).select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = placed.join(written(hot, "simhash-hot"), "key", "left").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    return dealt.select("*", F.col("own").alias("i"), every.alias("j")), dealt.select("*", F.col("own").alias("j"), every.alias("i"))


def merged(rows: DataFrame, most: int = MOST) -> DataFrame:
    """A written table (fp, root): components of rows (row, doc_id, fp, text) by links and by near copies.

    Buckets of a band first compare all their texts with the one that has the fewest shingles of its own, the likely
    origin of a group, then every pair that is still apart and whose counts of common shingles let it reach ALIKE; there a
    large bucket is cut into pairs of blocks. A
    bucket that has become one component drops out, so a large group of near copies doesn't cost its square, as long as
    its members differ from its origin by words of their own.
    """
    roots = rooted(rows.select("doc_id", "fp"), most).select("fp", "root")
    keyed = banded(rows.select("row", "fp", "text")).join(roots, "fp")
    placed = written(keyed.select(F.explode("keys").alias("key"), "node", "n", "root"), "simhash-bands")
    for star in (True, False):
        apart = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("key")
        placed = written(placed.join(written(apart, "simhash-apart"), "key"), "simhash-open")
        if star:
            sets, counts = shared(placed.select("node").distinct(), rows)
            # a text whose common shingles are too few for ALIKE has no partner
            placed = written(placed.join(counts, "node").filter(F.col("n") - F.col("lone") >= ALIKE * F.col("n")), "simhash-counted")
            hub = placed.groupBy("key").agg(F.min_by(F.struct("node", "n", "root", "common"), F.struct("lone", "node")).alias("hub"))
            one = hub.select("key", *[F.col(f"hub.{was}").alias(name) for was, name in HUB.items()])
            two, at = placed, ["key"]
        else:
            one, two, at = *in_blocks(placed), ["key", "i", "j"]
            one = one.select(*at, *[F.col(was).alias(name) for was, name in HUB.items()])
        two = two.select(*at, F.col("node").alias("y"), F.col("root").alias("b"), "n", "common")
        other = F.lit(True) if star else F.col("x") < F.col("y")
        # sets whose sizes, or common shingles, differ more can't reach ALIKE
        sizes = F.least("m", "n") >= ALIKE * F.greatest("m", "n")
        both = F.aggregate(F.zip_with("common", "theirs", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
        reach = both >= ALIKE / (1 + ALIKE) * (F.col("m") + F.col("n")) - 1e-6
        pairs = two.join(one, at).filter(other & (F.col("a") != F.col("b")) & sizes & reach).select("x", "y", "a", "b").distinct()
        joined = components(alike(written(pairs, "simhash-pairs"), sets)).toDF("was", "to")
        root = F.coalesce("to", "root").alias("root")
        roots = written(roots.join(joined, F.col("root") == F.col("was"), "left").select("fp", root), "simhash-merged")
        placed = placed.join(joined, F.col("root") == F.col("was"), "left").select("key", "node", "n", "common", root)
    return roots


@tidy
def drop_near_copies(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row of docs for each component of `merged`: that of the smallest doc_id, the first such row if it repeats."""
    names = docs.columns
    rows = written(fingerprints(docs, keep=True).withColumn("row", F.monotonically_increasing_id()), "simhash-docs")
    roots = merged(rows.select("row", "doc_id", "fp", F.col("doc.text").cast("string").alias("text")), most)
    placed = rows.select("doc_id", "fp", "row").join(roots, "fp")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("f"))
    gone = written(placed.select("row").join(first.select(F.col("f.row").alias("row")), "row", "left_anti"), "simhash-gone")
    judged = sieved(rows.select("row", "doc"), gone)
    kept = judged.filter("NOT may").unionByName(judged.filter("may").join(gone, "row", "left_anti"))
    return kept.select(*[F.col("doc").getField(n).alias(n) for n in names])


@tidy
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(fingerprints(table(spark, sf_dir, "documents")), "simhash-rows")
    return grouped(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
