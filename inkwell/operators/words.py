"""Which texts hold which words, as substrings of their lower case: by one automaton of all words, or by equality joins.

Joins work for any number of words. A word without white space that a text holds lies inside one of the text's white-space tokens. So words first meet the
vocabulary, which is far smaller than the texts, by one of a word's three-letter windows; texts then meet the tokens
found by equality. Texts are gone through once for each. Nothing is joined by a condition, collected, or broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.sources.shared import written

#: Letters of the windows that words and tokens are joined on.
GRAM = 3


def tokens(text: Column) -> Column:
    """White-space tokens of a text in lower case, repeats and an empty one at an edge included."""
    return F.split(F.lower(text), r"\s+")


def windows(text: Column) -> Column:
    """Windows of GRAM letters, one from each letter on; two blanks follow the last."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.rpad(F.substring(text, i, F.lit(GRAM)), GRAM, " "))


def vocabulary(texts: DataFrame, text: Column) -> DataFrame:
    """(token, n): every token of the texts and how often it stands there."""
    return texts.select(F.explode(tokens(text)).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def holders(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """(word, token, n): the tokens of vocab (token, n) that hold the longest white-space free part of each word.

    words is (word), distinct and in lower case. A word that no token holds has no row. Words meet tokens by one window,
    a word of less than GRAM letters by itself; the vocabulary is gone through once.
    """
    longest = F.array_max(F.transform(F.split("word", r"\s+"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    asked = words.select("word", longest.alias("part")).filter(F.length("part") > 0)
    whole = F.filter(windows(F.col("part")), lambda g: ~g.endswith(" "))
    asked = asked.withColumn("key", F.when(F.length("part") < GRAM, F.col("part")).otherwise(F.array_max(F.transform(whole, lambda g: F.struct(F.hash(g).alias("h"), g.alias("g"))))["g"]))
    cut = vocab.select("token", "n", F.explode(F.array_distinct(windows(F.col("token")))).alias("gram"))
    cut = cut.select("token", "n", F.explode(F.array(*[F.substring("gram", 1, k) for k in range(1, GRAM + 1)])).alias("key"))
    return cut.join(asked, "key").filter(F.contains("token", F.col("part"))).select("word", "token", "n").distinct()


def holding(texts: DataFrame, keys: list[str], text: Column, words: DataFrame) -> DataFrame:
    """(keys, word): every row of texts with every word (word) that its text holds; each pair once.

    Words count in lower case; null or blank ones take no part.
    """
    asked = words.select(F.lower("word").alias("word")).filter("trim(word) <> ''").distinct()
    found = written(holders(vocabulary(texts, text), asked).select("word", "token"), "words-found")
    each = texts.select(*keys, F.explode(tokens(text)).alias("token"))
    near = written(each.join(found, "token").select(*keys, "word").distinct(), "words-near")
    spaced = near.filter(F.col("word").rlike(r"\s"))
    body = texts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lower(text).alias("_body"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    sure = spaced.join(body, same).filter(F.contains("_body", F.col("word"))).select(*keys, "word").distinct()
    return near.filter(~F.col("word").rlike(r"\s")).unionByName(sure)


#: Bytes of words up to which one automaton of them all is built in every task; a task needs some 40 times as many.
AUTOMATON_BYTES = 1 << 20
#: Rows up to which a table of rules goes to every task as it is, and rows of a block beyond.
RULES = 1_000


def automaton(words: Iterable[str]) -> ahocorasick.Automaton | None:
    """A failure-link automaton whose matches are the words that end at each place; None without words."""
    out = ahocorasick.Automaton()
    for word in words:
        out.add_word(word, word)
    if not len(out):
        return None
    out.make_automaton()
    return out


def held(texts: DataFrame, keys: list[str], text: Column, words: DataFrame) -> DataFrame:
    """What `holding` gives: up to AUTOMATON_BYTES of words, which are counted, are looked for in one pass over the texts,
    by an automaton of them all; more go by equality joins."""
    asked = words.select(F.lower("word").alias("word")).filter("trim(word) <> ''").distinct()
    own = written(asked, "words-asked")
    if (own.agg(F.sum(F.octet_length("word"))).first()[0] or 0) > AUTOMATON_BYTES:
        return holding(texts, keys, text, own)
    shared = texts.sparkSession.sparkContext.broadcast([r[0] for r in own.collect()])  # at most AUTOMATON_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        for batch in batches if machine is not None else ():
            at, hits = [], []
            for i, body in enumerate(batch.column("_low").to_pylist()):
                found = sorted({word for _, word in machine.iter(body)}) if body else []
                at += [i] * len(found)
                hits += found
            rows = batch.select(keys).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hits, pa.string())], names=[*keys, "word"])

    rows = texts.select(*keys, F.lower(text).alias("_low"))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("word", T.StringType())])
    return rows.mapInArrow(run, schema).distinct()


def with_each(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Every row with every rule, for rules that are scored against all rows. Up to RULES of them, which are counted, go
    to every task; more meet the rows in blocks of that size, by an equality of block numbers."""
    n = rules.count()
    if n <= RULES:
        return rows.crossJoin(F.broadcast(rules))
    blocks, deals = -(-n // RULES), 64
    each = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    left = rows.select("*", F.pmod(F.xxhash64(*rows.columns), F.lit(deals)).cast("int").alias("_deal"), each(blocks).alias("_block"))
    right = rules.select("*", F.pmod(F.xxhash64(*rules.columns), F.lit(blocks)).cast("int").alias("_block"), each(deals).alias("_deal"))
    return left.join(right, ["_deal", "_block"]).drop("_deal", "_block")
