"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Texts of a batch become one array of code points. A class table turns it into symbols of an eight-state machine (which
run is open: letters, digits, other, white space, a joined space, a contraction). The array is cut in equal blocks; all
blocks step together, each composing its transition function from the eight possible entry states; an associative scan
over the blocks' functions gives every block its true entry state; a second stepping marks where slices begin. No
regular expression is run. Slices then go through a bounded cache to rank-ordered pair merging.

Work is per document inside Arrow batches: nothing is shuffled or collected, whatever the text's length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, keeps, table, texts

#: The vocabulary file, and the code points of Unicode's White_Space property.
VOCABULARY = "byte_bpe_50k.tiktoken"
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols: letter, digit, other, white space that stays in its run, last white space before a word (a space, or not),
# apostrophe before s t m d, apostrophe before re ve ll, end of a document.
LETTER, DIGIT, OTHER, BLANK, SPACE, LAST, TICK1, TICK2, END = range(9)
# States: nothing open, letters, digits, other, white space, joined space, one or two letters of a contraction to come.
SHUT, IN_L, IN_D, IN_O, IN_W, JOIN, C1, C2 = range(8)
STATES = 8
#: Most slices that the merge cache keeps.
CACHE_SLICES = 200_000
#: Slices of up to this many bytes are merged together with all others of their length.
SHORT = 40


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """LETTER, DIGIT, OTHER or BLANK of every code point."""
    kinds = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = BLANK
    return out


@lru_cache(maxsize=1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 where a slice begins) by state and symbol."""
    nxt, cut = np.zeros((STATES, 9), np.uint8), np.ones((STATES, 9), np.uint8)
    for state in range(STATES):
        nxt[state] = [IN_L, IN_D, IN_O, IN_W, JOIN, SHUT, C1, C2, SHUT]
        for symbol, home in ((LETTER, IN_L), (DIGIT, IN_D), (OTHER, IN_O), (TICK1, IN_O), (TICK2, IN_O)):
            if state in (home, JOIN):
                nxt[state, symbol], cut[state, symbol] = home, 0
    cut[IN_W, BLANK] = 0
    nxt[C1, LETTER], cut[C1, LETTER] = SHUT, 0
    nxt[C2, LETTER], cut[C2, LETTER] = C1, 0
    return nxt, cut


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ends: where the separators stand that follow each document."""
    kind = class_table()[points]
    out = kind.copy()
    is_end = np.zeros(len(points), bool)
    is_end[ends] = True
    after = np.ones(len(points), bool)
    after[:-1] = (kind[1:] == BLANK) | is_end[1:]
    last = (kind == BLANK) & ~after
    out[last] = LAST
    out[last & (points == 32)] = SPACE
    ticks = np.flatnonzero(points == 39)
    far = np.append(points, [0, 0]).astype(np.int64)
    one, two = far[ticks + 1], far[ticks + 1] << 21 | far[ticks + 2]
    out[ticks[np.isin(one, [ord(c) for c in "stmd"])]] = TICK1
    out[ticks[np.isin(two, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])]] = TICK2
    out[ends] = END
    return out


def starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Indices at which slices begin, separators included."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    nxt, cut = machine()
    flat_next, flat_cut = nxt.ravel().astype(np.intp), cut.ravel().astype(bool)
    length = int(max(64, min(2048, n // 512 + 1)))
    blocks = -(-n // length)
    grid = np.full(blocks * length, END, np.uint8)
    grid[:n] = symbols(points, ends)
    grid = np.ascontiguousarray(grid.reshape(blocks, length).T)
    compose = np.tile(np.arange(STATES), (blocks, 1))
    for t, row in enumerate(grid):
        compose = flat_next[compose * 9 + row[:, None]]
        if t % 8 == 7 and compose.shape[1] > 1 and (compose == compose[:, :1]).all():
            compose = compose[:, :1]  # constant functions: one column says it all
    entry = scan(np.broadcast_to(compose, (blocks, STATES)))[:, SHUT]
    state = np.concatenate([[SHUT], entry[:-1]])
    marks = np.empty(grid.shape, bool)
    for t, row in enumerate(grid):
        at = state * 9 + row
        marks[t] = flat_cut[at]
        state = flat_next[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan of transition functions under composition: row i maps an entry state through blocks 0 to i."""
    out, step = functions.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def slices(documents: list[str]) -> list[list[str]]:
    """The pre-tokens of each document."""
    sizes = np.fromiter((len(d) + 1 for d in documents), np.int64, len(documents))
    text = "\0".join(documents) + "\0" if documents else ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes) - 1
    cuts = starts(points, ends).tolist()
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:] + [len(text)])]
    bounds = np.searchsorted(cuts, np.append(0, ends + 1)).tolist()
    return [parts[a : b - 1] for a, b in zip(bounds, bounds[1:])]


class Codec:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache, self.pairs = ranks, {}, None
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.bytes_to_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> Codec:
        with open(path, "rb") as lines:
            return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merge(self, raw: bytes) -> list[int]:
        """Join the leftmost pair of lowest rank until none is left; a heap keeps long slices near-linear."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        n = len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[raw[i : i + 2]], i, i + 2) for i in range(n - 1) if raw[i : i + 2] in ranks]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            h = before[i]
            if h >= 0 and (rank := ranks.get(raw[h:stop])) is not None:
                heapq.heappush(heap, (rank, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair of ids, len(pieces) where the vocabulary lacks it."""
        if self.pairs is None:
            found = sorted(
                (self.ranks[p[:k]] << 32 | self.ranks[p[k:]], rank)
                for p, rank in self.ranks.items() for k in range(1, len(p)) if p[:k] in self.ranks and p[k:] in self.ranks
            )
            self.pairs = np.array(found or [(0, len(self.pieces))], np.int64).T.copy()
        keys, ranks = self.pairs
        want = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, ranks[at], len(self.pieces))

    def merge_equal(self, raws: list[bytes]) -> list[bytes]:
        """Packed ids of slices that all have the same length; every round merges one pair in each of them."""
        none, out = len(self.pieces), [b""] * len(raws)
        ids = self.bytes_to_ids[np.frombuffer(b"".join(raws), np.uint8).reshape(len(raws), -1)]
        pairs, rows = self.pair_ranks(ids[:, :-1], ids[:, 1:]), np.arange(len(raws))
        while len(rows):
            low = pairs.min(1) if pairs.shape[1] else np.full(len(rows), none)
            for k, packed in zip(rows[low == none].tolist(), ids[low == none].astype("<u4")):
                out[k] = packed.tobytes()
            on = low < none
            ids, pairs, rows, low = ids[on], pairs[on], rows[on], low[on]
            at, each = pairs.argmin(1) if len(rows) else rows, np.arange(len(rows))
            ids[each, at] = low
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            cols = cols[:-1]
            pairs = np.take_along_axis(pairs, cols + (cols >= at[:, None]), 1)
            for k in (np.flatnonzero(at > 0), -1), (np.flatnonzero(at < pairs.shape[1]), 0):
                row, left = k[0], at[k[0]] + k[1]
                pairs[row, left] = self.pair_ranks(ids[row, left], ids[row, left + 1])
        return out

    def learn(self, parts: set[str]) -> None:
        """Put slices into the cache."""
        by_size: dict[int, list[str]] = {}
        for p in parts:
            by_size.setdefault(len(raw := p.encode()), []).append(p)
            if raw in self.ranks:
                self.cache[p] = self.ranks[raw].to_bytes(4, "little")
                by_size[len(raw)].pop()
        for size, own in by_size.items():
            if size > SHORT:
                self.cache.update((p, np.array(self.merge(p.encode()), "<u4").tobytes()) for p in own)
            elif own:
                self.cache.update(zip(own, self.merge_equal([p.encode() for p in own])))

    def ids(self, documents: list[list[str]]) -> list[bytes]:
        """Ids of each document's slices as little-endian 32-bit integers."""
        cache = self.cache
        if len(cache) > CACHE_SLICES:
            cache.clear()
        self.learn({p for parts in documents for p in parts if p not in cache})
        return [b"".join([cache[p] for p in parts]) for parts in documents]

    def decode(self, ids: bytes) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids, and the offset at which each id's bytes begin."""
        parts = list(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return b"".join(parts), np.cumsum(sizes) - sizes


keeps(__name__, Codec.load.cache_clear)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with `ids` (array of int) and `offsets` (first byte of each id's piece) added.

    A null or empty text has no ids. Every row is kept, repeated ones too; existing columns named ids or offsets are
    replaced. The tokenizer's file is read where the tasks run.
    """
    path = path or vocabulary_path()
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "offsets")]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.LongType()))])

    def step(batch):
        codec = Codec.load(path)
        ids = codec.ids(slices([x.decode() for x in texts(batch.column("text"))]))
        return {f.name: batch.column(f.name) for f in kept} | {
            "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids], "offsets": [codec.decode(x)[1] for x in ids],
        }

    return arrow_pass(docs.select(*[F.col(f"`{f.name}`") for f in kept]), step, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs; a null text counts as empty."""
    path = path or vocabulary_path()

    def step(batch):
        codec = Codec.load(path)
        ids = codec.ids(slices([x.decode() for x in texts(batch.column(1))]))
        return {
            "doc_id": batch.column(0),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(codec.decode(x)[0]).hexdigest() for x in ids],
        }

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return arrow_pass(rows, step, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
