"""Joins on keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in HOT of the rows is hot; there are fewer such keys than that.
HOT = 1000


def join_split(rows: DataFrame, table: DataFrame, column: str, key: str, size: str, value: str, spread: Column, hot: int = HOT, total: int | None = None) -> DataFrame:
    """rows with `value` of their key from table (key, size, value): each key once, with how many rows have it.

    Hot keys, fewer than `hot`, and the null key are looked up in a broadcast table. The others are
    joined by key; rows that are settled by then take a null key and a place by `spread` (a hash of
    something that differs among rows), so no task gets more than one in `hot` of the rows for a key.
    Rows whose key the table lacks keep a null. total: the sum of the sizes, if it is known."""
    k, v, slot = "_split_key", "_split_value", "_split_slot"
    sized = table.select(F.col(key).alias(k), F.col(size).alias("_split_n"), F.col(value).alias(v))
    often = (F.col("_split_n") > F.col("_split_all") / hot) | F.col(k).isNull()
    whole = sized.withColumn("_split_all", F.lit(total)) if total is not None else sized.crossJoin(F.broadcast(table.agg(F.sum(size).alias("_split_all"))))  # one row
    marked = whole.withColumn("_split_hot", often)
    few = F.broadcast(marked.where("_split_hot").select(F.col(k).alias("_hot_key"), F.struct(v).alias("_hot_value")))
    # one key of two parts: apart, a salt that is always 0 on this side would be no key for Spark
    place = lambda c, salt: F.struct(c.alias("key"), salt.cast("int").alias("salt"))
    many = marked.where("not _split_hot").select(place(F.col(k), F.lit(0)).alias(slot), v)
    settled = F.col("_hot_value").isNotNull()
    out = rows.join(few, F.col(column).eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key")
    out = out.withColumn("_row_slot", place(F.when(~settled, F.col(column)), F.when(settled, F.pmod(spread, F.lit(1 << 20))).otherwise(0)))
    out = out.join(many, F.col("_row_slot") == F.col(slot), "left")
    return out.withColumn(value, F.when(settled, F.col(f"_hot_value.{v}")).otherwise(F.col(v))).drop("_row_slot", "_hot_value", slot, v)
