"""From raw documents to packed training sequences: quality, near duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm import op03_jaccard, op04_packing, op07_quality, op08_decontaminate
from deltaloom.llm.common import drop, stage
from deltaloom.llm.queries import table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorisation machine, trained on the labelled rows of docs, accepts."""
    return op07_quality.keep(docs, op07_quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles are at least 0.8 alike."""
    return op03_jaccard.keep_one(docs, op03_jaccard.Plan())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any ten-word window of a benchmark item."""
    return op08_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return op04_packing.pack(docs, tokenizer())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: A trained model and a tokenizer are no SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each but the last written to the shared folder; a stage's input goes when its output is
    there.  An empty table, or a stage that keeps nothing, gives empty results of the same columns."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        kept = stage(out, f"pipeline-{name}")
        drop(docs)
        docs = kept
    return docs
