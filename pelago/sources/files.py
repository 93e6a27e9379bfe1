"""Scans and sinks (S01-S20). Paths are given by the caller; schemas are declared, never inferred."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = ("train", "test")


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the session names; our own only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pelago-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/pelago-{uuid.uuid4().hex}"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Quoted fields may hold separators, quotes and line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def scan_listings(spark: SparkSession, root: str, split: str, schema: T.StructType | str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    return scan_csv(spark, f"{root}/{split}", schema)


def scan_reference(spark: SparkSession, root: str, name: str, schemas: dict[str, str]) -> DataFrame:
    if name not in schemas:
        raise ValueError(f"unknown reference table {name!r}")
    return scan_csv(spark, f"{root}/{name}", schemas[name])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


#: The stem of a file's name; with FOLDER the value in a path like `.../key=value/part-0.json`.
STEM, FOLDER = r"([^/]*?)(?:\.[A-Za-z]+)?$", r"/key=([^/]+)/[^/]*$"


def scan_keyed_json(spark: SparkSession, path: str, schema: str, pattern: str = STEM) -> DataFrame:
    """One JSON document per file: key from the file's path; files that do not parse are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    keyed = rows.withColumn("key", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    return keyed.where("_corrupt_record is null").drop("_corrupt_record")


def scan_keyed_indexed_json(spark: SparkSession, path: str, schema: str, pattern: str = STEM) -> DataFrame:
    """scan_keyed_json with keys `name-3`, split into key and image_index."""
    return split_index(scan_keyed_json(spark, path, schema, pattern))


def split_index(df: DataFrame, key: str = "key") -> DataFrame:
    """A key `name-3` becomes (name, 3) at its last hyphen; the index is 1 if there is none."""
    m = F.regexp_extract(key, r"^(.*)-(\d+)$", 1)
    return df.withColumns({"image_index": F.when(m != "", F.regexp_extract(key, r"^(.*)-(\d+)$", 2).cast("int")).otherwise(1), key: F.when(m != "", m).otherwise(F.col(key))})


def lookup(documents: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The documents of the given keys, and the keys that have none."""
    return documents.join(keys.select(key).distinct(), key, "left_semi"), keys.select(key).distinct().join(documents, key, "left_anti")


#: `key-n.ext` at the end of a path.
NUMBERED = r"([^/]*)-\d+\.[A-Za-z]+$"


def files_by_key(spark: SparkSession, path: str, pattern: str = NUMBERED) -> DataFrame:
    """(key, sorted file names, n) of the files whose path has the pattern; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    keyed = files.select(F.regexp_extract("path", pattern, 1).alias("key"), F.element_at(F.split("path", "/"), -1).alias("file")).where("key <> ''")
    return keyed.groupBy("key").agg(F.array_sort(F.collect_list("file")).alias("files"), F.count(F.lit(1)).alias("n"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(folder, extension, n_files, size_mb) under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    parts = F.split("path", "/")
    return (
        files.select(F.element_at(parts, -2).alias("folder"), F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).alias("extension"), "length")
        .groupBy("folder", "extension").agg(F.count(F.lit(1)).alias("n_files"), F.round(F.sum("length") / 1048576, 2).alias("size_mb"))
    )


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_feature_set(df: DataFrame, root: str, modality: str, version: str, split: str, seed: int = 42) -> None:
    """Features partitioned by modality, version and split, with a sidecar of their columns."""
    out = df.withColumns({"modality": F.lit(modality), "version": F.lit(version), "split": F.lit(split)})
    out.write.mode("append").partitionBy("modality", "version", "split").parquet(f"{root}/features")
    sidecar(df, modality, version, seed).write.mode("append").json(f"{root}/schema")


def sidecar(df: DataFrame, modality: str, version: str, seed: int = 42) -> DataFrame:
    """One row per column: what a reader needs to check a feature set against."""
    rows = [(modality, version, i, f.name, f.dataType.simpleString(), len(df.columns), seed) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "modality string, version string, place int, column string, dtype string, n_columns int, seed int")


SIDECAR = "modality string, version string, place int, column string, dtype string, n_columns int, seed int"


def scan_feature_set(spark: SparkSession, root: str, modality: str, version: str, split: str) -> tuple[DataFrame, DataFrame]:
    """The features, and the column differences against the sidecar (empty if they agree)."""
    rows = spark.read.parquet(f"{root}/features").where((F.col("modality") == modality) & (F.col("version") == version) & (F.col("split") == split))
    declared = spark.read.schema(SIDECAR).json(f"{root}/schema").where((F.col("modality") == modality) & (F.col("version") == version)).dropDuplicates(["column"])
    names = [r["column"] for r in declared.select("column", "place").orderBy("place").collect()]
    data = [c for c in rows.columns if c not in ("modality", "version", "split")]
    gaps = [(c, "not in data") for c in names if c not in data] + [(c, "not in sidecar") for c in data if c not in names and not rows.where(F.col(c).isNotNull()).isEmpty()]
    return rows.select(*[c for c in names if c in data]), spark.createDataFrame(gaps, "column string, problem string")


def sidecar_check(stored: DataFrame, df: DataFrame, required: Sequence[str]) -> DataFrame:
    """(column, status, dtype, n_rows, n_null): the columns that a stored sidecar names with what df holds of them
    ("present", or "absent" if df lacks one), and the required ones that the sidecar lacks ("missing")."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in df.columns])
    held = df.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")
    named = stored.select("column", "dtype").join(held, "column", "left").select("column", F.when(F.col("n_rows").isNull(), "absent").otherwise("present").alias("status"), "dtype", "n_rows", "n_null")
    wanted = df.sparkSession.createDataFrame([(c,) for c in required], "column string").join(stored.select("column"), "column", "left_anti")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("dtype", "string"), ("n_rows", "bigint"), ("n_null", "bigint"))]
    return named.unionByName(wanted.select("column", F.lit("missing").alias("status"), *none))


def missing_keys(record: dict, required: Sequence[str]) -> list[str]:
    return [k for k in required if k not in record]


def write_submission(df: DataFrame, key: str, label: str, path: str, classes: Sequence[int] = range(5)) -> None:
    """Reject classes outside the list and repeated keys, then write CSV."""
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.coalesce(F.col(label).isin(list(classes)), F.lit(False))).alias("_bad"))
    bad, more = by.agg(F.coalesce(F.sum("_bad"), F.lit(0)), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()
    if bad or more:
        raise ValueError(f"{bad} classes outside {list(classes)}, {more} repeated keys")
    write_csv(df.select(key, label), path)


def append_jsonl(df: DataFrame, path: str, day: str) -> None:
    """One JSON line per row, in a folder per day."""
    df.withColumn("date", F.date_format(day, "yyyy-MM-dd")).write.mode("append").partitionBy("date").json(path)


def audit_row(predictions: DataFrame, run: dict) -> DataFrame:
    """One nested row that records a run: its facts and a summary of what it predicted."""
    h = F.xxhash64(*predictions.columns)
    summary = F.struct(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("rows_hash"), *[F.count_if(F.col("predicted") == c).alias(f"n_{c}") for c in range(5)])
    facts = F.create_map(*[F.lit(x) for k, v in sorted(run.items()) for x in (k, json.dumps(v, sort_keys=True))])
    return predictions.agg(summary.alias("predictions")).withColumn("run", facts)


def validation_report(checks: DataFrame) -> DataFrame:
    """Totals over check rows (check, passed)."""
    return checks.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if("passed").alias("n_passed"), F.bool_and("passed").alias("overall_passed"))


def markdown(checks: DataFrame) -> DataFrame:
    """Rows of a Markdown table, to be written as text."""
    return checks.select(F.concat(F.lit("| "), F.col("check"), F.lit(" | "), F.when(F.col("passed"), "pass").otherwise("fail"), F.lit(" |")).alias("value"))


def append_experiment(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def experiments(spark: SparkSession, path: str, metric: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc_nulls_last(metric), "trial")


def load_matrix(df: DataFrame, key: str, target: str | None) -> tuple[DataFrame, DataFrame | None]:
    """Features by key, and the target apart; a table without labels must not carry the target."""
    if target is None:
        return df, None
    if target not in df.columns:
        raise ValueError(f"no target {target!r}")
    return df.drop(target), df.select(key, target)
