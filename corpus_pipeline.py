"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and
returns a DataFrame; ``run`` applies them in order, each written as Parquet to the shared
folder and read back, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelake.llm import decontaminate, mixing, simhash, suffix, toxicity
from ratelake.llm.common import forget, save, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays, the one with the smallest id."""
    return simhash.near_dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that start earlier are cut from the texts."""
    return suffix.dedup_text(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: documents once per copy, with ``size`` and ``copy``."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", decontaminated),
    ("mix_sources", mix_sources),
]

#: SQL cannot express a fitted classifier or a randomised SVD; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as keep:  # a stage's intermediate tables go when its output is written
            docs, path = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(path)
        if before:
            forget(spark, before)
        before = path
    return docs
