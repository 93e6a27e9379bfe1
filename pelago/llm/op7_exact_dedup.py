"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

A mergeable frequent-items sketch (Misra-Gries) over the SHA-256 digests names at most `HEAVY`
candidates; one aggregation verifies their counts and winners. Those rows, a table of at most
HEAVY rows, are broadcast and settle every copy of a frequent text where it is read. All other
digests go through one ordinary shuffle, in which no group can hold more than about
1 / HEAVY of the rows.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id
stays (a null doc_id is smaller than any other); of repeated rows with the same doc_id and text
exactly one stays; an empty table gives an empty table; other columns, whatever their names, pass
through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, table, written

#: Most digests that are settled by broadcast, and the counters that a sketch holds for them.
HEAVY, COUNTERS = 1024, 8192
#: Sketches are merged in two steps, so many first.
MERGES = 64
DIGEST = "text_sha256"


def with_digest(documents: DataFrame, name: str = DIGEST) -> DataFrame:
    return documents.withColumn(name, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def winners(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of the frequent digests: exact values, at most HEAVY rows."""
    sketch = (
        digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part"))
        .agg(F.expr(f"approx_top_k_accumulate({DIGEST}, {COUNTERS})").alias("s"))
        .groupBy((F.col("part") >= 0).alias("every"))  # a key: the merge fails on partitions without a sketch
        .agg(F.expr(f"approx_top_k_combine(s, {COUNTERS})").alias("s"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(s, {HEAVY})")).alias("f"))
        .where("f.count > 1")
        .select(F.col("f.item").alias(DIGEST))
        .where(F.col(DIGEST).isNotNull())
    )
    return digests.join(F.broadcast(sketch), DIGEST).groupBy(DIGEST).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def annotate(rows: DataFrame, frequent: DataFrame, digest: str, keep_id: str, group_size: str, kept: str, doc_id: str = "doc_id") -> DataFrame:
    """Every row with keep_id, group_size and kept under these names, which rows must not have.
    digest: a column of rows. frequent: what winners() gave."""
    names = [*rows.columns, keep_id, group_size, kept]
    top, place = fresh(names, "_top", "_place")
    heavy = F.broadcast(frequent.toDF(digest, keep_id, group_size))
    rest = W.partitionBy(digest)
    settled = rows.join(heavy, digest).withColumn(top, F.col(doc_id).eqNullSafe(F.col(keep_id)))
    losers = settled.where(~F.col(top)).withColumn(kept, F.lit(False)).select(*names)
    tops = settled.where(top).withColumn(kept, F.row_number().over(W.partitionBy(digest, top).orderBy(F.lit(1))) == 1).select(*names)
    light = (
        rows.join(heavy, digest, "left_anti")
        .withColumn(place, F.row_number().over(rest.orderBy(F.col(doc_id).desc_nulls_last())))
        .withColumn(keep_id, F.max(doc_id).over(rest))
        .withColumn(group_size, F.count(F.lit(1)).over(rest))
        .withColumn(kept, F.col(place) == 1)
        .select(*names)
    )
    return losers.unionByName(tops).unionByName(light)


def mark_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(with_digest(documents.select("doc_id", "text")).select("doc_id", DIGEST), "digests")
    frequent = written(winners(digests), "frequent")
    out = annotate(digests, frequent, DIGEST, "keep_id", "group_size", "kept")
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", DIGEST)


def drop_duplicates(documents: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    names = documents.columns
    digest, keep_id, group_size, kept, row = fresh(names, "_digest", "_keep_id", "_group_size", "_kept", "_row")
    frequent = written(winners(with_digest(documents.select("doc_id", "text")).select("doc_id", DIGEST)), "frequent")
    # the input row travels as a struct: its names meet no other
    rows = with_digest(documents, digest).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col("doc_id"), digest)
    return annotate(rows, frequent, digest, keep_id, group_size, kept).where(kept).select(f"{row}.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
