"""Corpus pipeline: each stage gets all documents its predecessor kept, and its decisions take effect.

Stages are written as Parquet between each other.  All but the last return the columns of ``documents``;
the last adds ``copy`` and ``position`` and is sorted by training position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm import decontam, hyperminhash, line_dedup, mixing, toxicity
from matchspark.llm.queries import remainder
from matchspark.llm.workdir import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; labels are learnt from as in op1."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), lambda key: remainder(key, 3) != 1)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that recur across them; n_chars follows the text."""
    lines = line_dedup.drop_recurring_lines(docs)
    n_chars = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return lines.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, linked from a Jaccard similarity of 0.8 on."""
    return hyperminhash.one_of_each(docs, threshold=(80, 100)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of the training mix by position."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Near-duplicate groups and the fitted toxicity model have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
