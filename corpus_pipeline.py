"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordix.llm import decontaminate, jaccard_join, line_dedup, packing, quality, token_counts
from ordix.llm._dist import Kept


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score low against the trusted target go."""
    return quality.keep(docs, quality.fit(docs, quality.trusted_ids(_table(spark, sf_dir, "labels"))))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of near-equal lines stays."""
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.representatives(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim benchmark window go."""
    return decontaminate.clean(docs, decontaminate.blocks(_table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in a token-budget batch of its length bucket."""
    import public_tokenizers

    return packing.pack(token_counts.counts(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: No SQL expresses the log-likelihood ratio, MinHash bands or the bucket boundaries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's output is written and read again."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        after = Kept(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = after.df, after
    return docs
