"""A training corpus from raw documents: poor texts go, then exact and near copies, then benchmark leaks;
the rest is packed into sequences.

Every stage takes (spark, docs, sf_dir) and judges the documents that the stage before it kept; all but
the last return the columns of ``documents``. ``run`` writes each stage's result to the shared folder
and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import decontam, exact, near, packing, quality
from pulsegrid.session import configure, settle


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.drop_poor(docs, configure(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id."""
    configure(spark)
    return exact.drop_copies(docs)


def keep_dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies with four fifths of their five-word shingles in common."""
    configure(spark)
    return near.drop_similar(docs, percent=80)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item."""
    return decontam.drop_leaks(docs, configure(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence."""
    configure(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", keep_distinct),
    ("minhash_near_dedup", keep_dissimilar),
    ("benchmark_decontamination", keep_clean),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs


# The classifier, the near-duplicate groups and the tokenizer have no SQL form.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
