"""From raw documents to token ids: five stages, each on all that the one before kept.

1. quality: documents that the importance resampling rejects go.
2. exact_dedup: of equal texts the one of the smallest doc_id stays.
3. jaccard_dedup: of documents linked by five-word shingles at a similarity of
   0.8 or more, one stays.
4. decontaminate: documents that hold a benchmark item go.
5. bpe: the token ids of the rest, with the digests of the round trip.

Stages read their input more than once, so ``run`` writes each result to the
shared folder; a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromaloom.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from chromaloom.llm.common import stage, table

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.selected(spark, docs, quality.fit(spark, docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicated(spark, docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(bpe.round_trip(spark, docs), "ids")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("bpe", encode),
]

#: SQL can't express the resampling, the alignment or BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents`` below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(spark, apply(spark, docs, sf_dir), name)
    return docs
