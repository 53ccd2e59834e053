"""The corpus pipeline: five stages over `documents`, each on all that the one before kept.

quality rules -> line deduplication -> near-duplicate removal -> benchmark decontamination -> packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
reads it again.  All but the last return the columns of documents; the last returns packed pieces.

In every stage an empty table gives no rows, further columns are carried whatever their names, very long texts are
handled whole, and repeated rows are judged by the same rules; what nulls, empty texts and ties give is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, linededup, neardup, packing, quality
from graphloom.llm.common import discard, materialize, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose fail bits meet none of the current policy's mask.  A null or empty text has too few words and goes; a
    measure equal to its limit passes; repeated rows stay or go together."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; a text that loses all its lines goes.  Null and blank texts
    have no window and stay; of equal windows the one of the least id, then place, stays; repeated rows fare alike."""
    return linededup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of the least id.  A null text is alone in its class; equal empty
    texts are copies; of repeated rows one stays; different texts of one id are documents of their own."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.  Null and empty texts hold none and stay, as does everything if the
    benchmark is empty; null items count for nothing."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of one context.  A null or empty text is its end id alone; a long one is
    cut; repeated rows are packed each; pieces of equal length are interchangeable."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: ProbMinHash and tokenization can't be said in SQL; tests/llm/test_pipeline.py holds run() against a
#: plain version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
