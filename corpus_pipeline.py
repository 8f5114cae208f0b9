"""Documents to packed training sequences: rules, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and
reads it back as the next stage's docs, so a lost executor never costs more than one stage. Every stage works on all rows
its predecessor kept; all but the last return the columns of documents, whatever their names, with those names.

Defined results: a document with a null or empty text, or of fewer than 20 words, is rejected by the quality rules. Rows with
a null doc_id are judged like others but are never near-duplicates of anything. Of rows with equal doc_ids, all go or all stay in
near_dedup; exact copies under different ids leave the smallest id. Ties go to the smaller id. A text is worked on whole, however
long, in one task. Empty tables give empty results at every stage, and without benchmark items nothing is a leak.

Every stage writes to spark.checkpoint.dir; lodestone.llm.base.cleanup(spark) deletes what a process has written there, once
the last result is stored elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, minhash, packing, pii, quality_rules
from lodestone.llm.base import materialize, spread, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the posterior of the rules rejects."""
    return quality_rules.filter_stage(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at a similarity of 0.8 on five-word shingles."""
    return minhash.dedup_stage(spark, docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item leaks."""
    return decontaminate.filter_stage(spark, docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the names of their kinds."""
    return pii.mask_stage(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequences and offsets."""
    return packing.digest(packing.pack(spark, docs))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Random fields, signatures and packing are beyond SQL; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return docs
