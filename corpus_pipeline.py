"""The corpus pipeline: quality rules, exact dedup, MinHash near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and
reads again for the next stage. All but the last return the columns of documents.

Defined results: a null or empty text fails the quality rules; without usable labels only the base
rule rejects; of equal texts, null counting as empty, the row with the largest doc_id stays, and of a
near-duplicate group one row with the smallest; rows without a doc_id are compared for equality only
and otherwise stay; rows that share a doc_id and differ in their text are documents of their own;
further columns pass through all stages but the last, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pelago.llm import op1_quality_rules, op4_minhash, op5_pii, op6_packing, op7_exact_dedup
from pelago.llm.common import scratch, shared_dir, table
from pelago.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trained model rejects go."""
    ship(spark)
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return op1_quality_rules.keep_good(docs, labels)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    ship(spark)
    return op7_exact_dedup.drop_duplicates(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 similar sets of five-word shingles, the smallest doc_id stays."""
    ship(spark)
    return op4_minhash.drop_near(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal span is replaced by its kind."""
    ship(spark)
    return op5_pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    ship(spark)
    return op6_packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("PII", personal_data),
    ("packing", packing),
]
#: SQL cannot train the models or run the tokenizer; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pelago-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):  # the stage's own tables go when its result is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
