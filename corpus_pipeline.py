"""A training-corpus pipeline over documents: toxic texts go, one of each group of near copies stays, personal data is
masked, sources are mixed to their targets, and the result is encoded.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All but the last return the
columns of docs; the last returns the digests of ids and decoded bytes of every row of the mix, so a document that the
mix takes twice has two rows.

In every stage null and empty texts are kept (as clean, as one group of texts without words, as nothing to mask, as rows
that the mix takes once, and as no ids), very long texts are steps of their own, extra columns and clashing names pass
through, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, mixing, pii, simhash, toxicity
from inkwell.llm.common import remove, scope, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the model fitted on docs and labels calls toxic. Repeated rows are judged alike; without
    labels of both kinds nothing goes."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: sets of five-word shingles of similarity 0.8
    or more, and op6's links. Of repeated rows one stays; a null id stays only in a group without another."""
    return simhash.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars, where docs has it, follows the text. All rows stay."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks, in training order; a null source is one of its own, ties
    go by the row."""
    return mixing.resample(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode each row, repeated ones too."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: A learned classifier, a hash order and a tokenizer have no SQL form; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows of documents. What a stage left in the shared folder goes once its result is written; the
    mix, which the returned frame reads, stays there for the cluster's own cleaning."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scope() as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(spark, [*before, *made[:-1]])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
