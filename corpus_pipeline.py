"""A corpus pipeline of five operators, each stage over all that its predecessor kept.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents; n_chars
follows the text. A document whose every line repeats earlier ones leaves with its lines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from linkscope.llm.common import held_out, materialize, table

TOXIC_FROM = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    out = next(c for c in (f"_toxicity{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), out=out)
    return scored.where(F.col(out) < TOXIC_FROM).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat earlier ones, or ones of 25 characters or more that differ by two edits at most."""
    out = line_dedup.dedup_lines(docs)
    gone = (F.col("n_exact") + F.col("n_near") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five words, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, percent=80, n=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
