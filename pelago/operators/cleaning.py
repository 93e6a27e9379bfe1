"""Cleaning: names, texts, codes, types."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a placeholder name, and texts that mean a missing value.
PLACEHOLDERS = [r"^no\s*name\b.*$", r"^unnamed\b.*$", r"^none$", r"^n/?a$", r"^unknown$", r"^-+$", r"^\.+$", r"^\?+$"]
MISSING_TEXTS = ["nan", "<NA>", "None", ""]


def strip(c: str | Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s++|(?<!\s)\s++$", "")


def clean_name(name: str | Column) -> Column:
    """Trimmed name; null if blank, a placeholder, digits only or without a letter or digit."""
    t = strip(name)
    bad = t.rlike("(?is)" + "|".join(f"(?:{p})" for p in PLACEHOLDERS)) | t.rlike(r"^\d+$") | ~t.rlike(r"[A-Za-z0-9]")
    return F.when((t != "") & ~bad, t)


def name_rule(name: str) -> Column:
    """Which rule voids a name: null, empty, placeholder, numeric, symbol, or kept."""
    t = strip(name)
    return (
        F.when(t.isNull(), "null").when(t == "", "empty")
        .when(t.rlike("(?is)" + "|".join(f"(?:{p})" for p in PLACEHOLDERS)), "placeholder")
        .when(t.rlike(r"^\d+$"), "numeric").when(~t.rlike(r"[A-Za-z0-9]"), "symbol").otherwise("kept")
    )


def clean_names(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("_n", clean_name(name)).withColumn("has_name", F.col("_n").isNotNull().cast("int")).withColumn(name, F.col("_n")).drop("_n")


#: Texts of a batch that are Python strings at one time.
AT_ONCE = 64


def _normal_form(form: str, texts: pa.Array) -> pa.Array:
    """A batch stays an Arrow array, input and result; only AT_ONCE of its texts are Python strings at a time."""
    made = (
        pa.array([x if x is None or x.isascii() else unicodedata.normalize(form, x) for x in texts.slice(i, AT_ONCE).to_pylist()], pa.string())
        for i in range(0, len(texts), AT_ONCE)
    )
    return pa.concat_arrays([pa.array([], pa.string()), *made])


@F.arrow_udf(T.StringType())
def nfc(s: pa.Array) -> pa.Array:
    return _normal_form("NFC", s)


@F.arrow_udf(T.StringType())
def nfkd(s: pa.Array) -> pa.Array:
    return _normal_form("NFKD", s)


def normalize_text(df: DataFrame, *columns: str) -> DataFrame:
    """Trim, NFC, and null for texts that mean a missing value."""
    out = {}
    for c in columns:
        t = nfc(strip(F.col(c).cast("string")))
        out[c] = F.when(~t.isin(MISSING_TEXTS), t)
    return df.withColumns(out)


def fix_codes(df: DataFrame, rules: Mapping[str, tuple[Iterable, object]]) -> DataFrame:
    """Codes outside their valid set, nulls too, become the fallback."""
    return df.withColumns({c: F.when(F.coalesce(F.col(c).isin(list(valid)), F.lit(False)), F.col(c)).otherwise(F.lit(fallback).cast(df.schema[c].dataType)) for c, (valid, fallback) in rules.items()})


def invalid_codes(df: DataFrame, rules: Mapping[str, tuple[Iterable, object]]) -> DataFrame:
    """(column, n_invalid, bad_values) for each rule, in one pass."""
    bad = {c: ~F.coalesce(F.col(c).isin(list(valid)), F.lit(False)) for c, (valid, _) in rules.items()}
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.sum(b.cast("long")).alias("n_invalid"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(b, F.col(c).cast("string"))))).alias("bad_values")).alias(f"r{i}") for i, (c, b) in enumerate(bad.items())])
    return one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")


def move_if_empty(df: DataFrame, first: str, second: str) -> DataFrame:
    """Where the first is 0 and the second is not, the second moves to the first."""
    move = F.coalesce((F.col(first) == 0) & (F.col(second) != 0), F.lit(False))
    zero = F.lit(0).cast(df.schema[second].dataType)
    return df.withColumns({first: F.when(move, F.col(second)).otherwise(F.col(first)), second: F.when(move, zero).otherwise(F.col(second))})


def enforce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Whole-number columns turn null into 0 first; a value that cannot be cast becomes null."""
    out = {}
    for c, kind in types.items():
        cast = F.col(c).try_cast(kind)
        out[c] = F.coalesce(cast, F.lit(0).cast(kind)) if kind in ("int", "long", "bigint") else cast
    return df.withColumns(out)


def mode(df: DataFrame, column: str) -> DataFrame:
    """One row with the most frequent value, the smallest of equals."""
    return df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(1).select(column)


def recode(column: str, values: Mapping, default=None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out if default is None else out.otherwise(default)


def format_value(column: str) -> Column:
    """A number as short text; other texts unchanged."""
    raw, x = F.col(column), F.expr(f"try_cast({column} AS double)")
    return (
        F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "")
        .when(x.isNull(), raw)
        .when((x == F.floor(x)) & (F.abs(x) < 1_000_000), x.cast("long").cast("string"))
        .when(F.abs(x) < 0.01, F.format_string("%.4f", x))
        .otherwise(F.format_string("%.2f", x))
    )
