"""Substring dedup by suffix automata of reference shards.

The repeated windows of the corpus, as `repeats` finds and routes them, form reference shards: the pieces that share an
anchor with any other place, each distinct piece once, in corpus order. Every shard has a suffix automaton; pieces are
streamed over it for matching statistics before they are added to it, so a match of at least a window's length is one
that stands earlier, in an earlier document or earlier in the same one. The maximal spans of such matches go.

A shard's automaton stays with the pieces of its anchors instead of being broadcast: reference shards grow with the
corpus, so a broadcast of them has no bound, and every document would have to visit all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import Unit, remove

#: Words of a window and of an anchor, and words of a shard.
WORDS = Unit(words=True, window=20, gram=8, shard=20_000)


class Automaton:
    """Suffix automaton over sequences of words, built while they are matched against it."""

    def __init__(self):
        self.next, self.link, self.size = [{}], [-1], [0]

    def _clone(self, p: int, q: int, word) -> int:
        nxt, link, size = self.next, self.link, self.size
        made = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        size.append(size[p] + 1)
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = made
            p = link[p]
        link[q] = made
        return made

    def stream(self, words: list[bytes], window: int) -> list[int]:
        """Starts of the windows of words that the automaton holds, or that stand earlier in words; adds words to it."""
        nxt, link, size = self.next, self.link, self.size
        at, have, last, out = 0, 0, 0, []
        for i, word in enumerate(words):
            while at and word not in nxt[at]:
                at = link[at]
                have = size[at]
            if word in nxt[at]:
                at = nxt[at][word]
                have += 1
            if have >= window:
                out.append(i - window + 1)
            p, q = last, nxt[last].get(word)
            if q is not None:
                if size[q] == size[p] + 1:
                    last = q
                else:
                    last = self._clone(p, q, word)
                    if at == q and have <= size[last]:
                        at = last
                continue
            last = len(nxt)
            nxt.append({})
            link.append(0)
            size.append(size[p] + 1)
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = last
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                if size[q] == size[p] + 1:
                    link[last] = q
                else:
                    link[last] = made = self._clone(p, q, word)
                    if at == q and have <= size[made]:
                        at = made
        return out


def solve(pieces: list[tuple[bytes, bool]], unit: Unit) -> list[list[int]]:
    automaton = Automaton()
    return [automaton.stream(content.split(b" "), unit.window) for content, _ in pieces]


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Each row's words that no earlier window covers; see repeats.remove for nulls, repeated rows and empty texts."""
    return remove(docs.select("doc_id", "text"), WORDS, solve, first_stays=True)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_units", "n_removed", "kept_sha256").withColumnRenamed("n_units", "n_words")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 20)) AS j FROM again)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
