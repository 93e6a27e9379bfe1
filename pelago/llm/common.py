"""Shared helpers of the corpus operators: scratch tables, joins on hot keys, Arrow slices, label folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of text that one vectorised step takes at once (a longer text goes alone).
SLICE_BYTES = 1 << 19


#: A key is hot if it holds more than one in HOT_KEYS of the rows (so there are fewer hot keys than
#: that) and more rows than a task handles with ease.
HOT_KEYS, EASY_ROWS = 1000, 10_000
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of our own only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pelago-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/pelago-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path.rpartition("/")[0])
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes the tables that written() makes inside. What leaves the block must not read them:
    it is written before, by the caller or with outlives()."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        for path in made:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def outlives(df: DataFrame, name: str) -> DataFrame:
    """written(), for a table that is read after the innermost scratch() block ends."""
    made = _scopes.pop() if _scopes else None
    try:
        return written(df, name)
    finally:
        if made is not None:
            _scopes.append(made)


def fresh(columns, *names: str) -> list[str]:
    """The names, with underscores put before them until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], size: str, drop: bool = True) -> DataFrame:
    """Inner join of many with one, a stored table that has each key once and, in `size`, how many
    rows of many have it. The hot keys, fewer than HOT_KEYS rows of one, are broadcast; only the
    others are shuffled, so that no task gets more than one in HOT_KEYS of the rows by one key."""
    if one.where(F.col(size) > EASY_ROWS).isEmpty():
        out = many.join(one, keys)
    else:
        least = max(EASY_ROWS, many.count() / HOT_KEYS)
        hot = F.broadcast(one.where(F.col(size) > least))
        rest = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one.where(F.col(size) <= least), keys)
        out = many.join(hot, keys).unionByName(rest)
    return out.drop(size) if drop else out


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def slices(batches, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches in parts of about `most` bytes of text, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        column = pc.fill_null(column.cast(pa.large_string()), "")
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(column).to_pylist()):
            if size and size + n > most:
                yield batch.slice(start, i - start), column.slice(start, i - start).cast(pa.large_binary()).to_pylist()
                start, size = i, 0
            size += n + 1
        if len(batch) > start:
            yield batch.slice(start), column.slice(start).cast(pa.large_binary()).to_pylist()


def held_out(doc_id: str | Column) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


def hash_share(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About four times `rows` rows by a hash of the key, or all of a smaller table. What a top-k
    then gathers from each task stays small, however many tasks there are."""
    share = min(1.0, 4 * rows / max(1, df.count()))
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(F.lit(3), key), F.lit(1 << 30)) < int(share * (1 << 30)))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y, slot) of at most `rows` labelled documents outside the held-out fold.

    The ids are the smallest by a hash, so the choice is repeatable; `rows` bounds what is
    broadcast and, since of rows that share a doc_id only the least text stays, what any trainer
    sees. A doc_id with several labels has the smallest. slot counts from 0 in hash order.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    picked = (
        hash_share(usable, "doc_id", rows)
        .groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    slot = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(1 << 20)).alias("slot")
    one = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return one.select("doc_id", "text", "y", slot)
