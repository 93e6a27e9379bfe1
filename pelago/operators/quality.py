"""Quality checks (Q01-Q14): each gives one row per check or per column, in one pass over the data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAMILIES = {"int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "float": "float", "double": "float", "string": "string", "boolean": "bool"}


@dataclass(frozen=True)
class ColumnSpec:
    """A declared column: its type, whether it may be null, and its domain."""

    name: str
    dtype: str
    nullable: bool = False
    valid: tuple = ()
    least: float | None = None
    foreign: str | None = None
    allow_zero: bool = False


@dataclass(frozen=True)
class Contract:
    columns: tuple[ColumnSpec, ...] = field(default_factory=tuple)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(c.dtype), c.nullable, {"least": c.least} if c.least is not None else {}) for c in self.columns])

    def required(self) -> list[str]:
        return [c.name for c in self.columns if not c.nullable]

    def __getitem__(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)


def _rows(one: DataFrame) -> DataFrame:
    """The columns of a one-row frame, all structs of one shape, as rows."""
    return one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")


def check_schema(df: DataFrame, contract: Contract) -> DataFrame:
    """ok, missing, extra or type for each column; a type passes if it is of the same family."""
    have = dict(df.dtypes)
    rows = []
    for c in contract.columns:
        kind = have.get(c.name)
        rows.append((c.name, "missing" if kind is None else "ok" if FAMILIES.get(kind, kind) == FAMILIES.get(c.dtype, c.dtype) else "type"))
    rows += [(c, "extra") for c in have if c not in {x.name for x in contract.columns}]
    return df.sparkSession.createDataFrame(rows, "column string, status string")


def domain_violation(c: ColumnSpec) -> Column | None:
    """True where a value breaks its domain: nulls break a set, and pass a range."""
    if c.valid:
        return ~F.coalesce(F.col(c.name).isin(list(c.valid)), F.lit(False))
    if c.least is not None:
        return F.coalesce(F.col(c.name) < c.least, F.lit(False))
    return None


def check_domains(df: DataFrame, contract: Contract, examples: int = 20) -> DataFrame:
    rules = [(c, v) for c in contract.columns if c.foreign is None and (v := domain_violation(c)) is not None]
    cells = [
        F.struct(F.lit(c.name).alias("column"), F.count_if(v).alias("n_bad"), F.concat_ws(",", F.slice(F.array_sort(F.collect_set(F.when(v, F.coalesce(F.col(c.name).cast("string"), F.lit("null"))))), 1, examples)).alias("examples"))
        for c, v in rules
    ]
    return _rows(df.agg(*[x.alias(f"c{i}") for i, x in enumerate(cells)]))


def check_nulls(df: DataFrame, contract: Contract) -> DataFrame:
    n = F.count(F.lit(1))
    cells = []
    for c in contract.columns:
        bad = F.count_if(F.col(c.name).isNull())
        severity = F.when(bad == 0, "ok").otherwise(F.lit("expected" if c.nullable else "critical"))
        cells.append(F.struct(F.lit(c.name).alias("column"), bad.alias("n_null"), F.round(F.coalesce(bad / n, F.lit(0.0)), 4).alias("fraction"), severity.alias("severity")))
    return _rows(df.agg(*[x.alias(f"c{i}") for i, x in enumerate(cells)]))


def check_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys (nulls are none), and what is more; counted by groups, not by one distinct set."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(key).alias("n_distinct"), F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("n_repeated"))
    return out.withColumn("n_duplicates", F.col("total") - F.col("n_distinct"))


def duplicate_keys(df: DataFrame, key: str, most: int = 50) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), key).limit(most)


def check_implications(df: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Rows where the first condition holds and the second does not."""
    cells = [F.struct(F.lit(name).alias("rule"), F.count_if(F.coalesce(a & ~b, F.lit(False))).alias("n_bad"), (F.count_if(F.coalesce(a & ~b, F.lit(False))) == 0).alias("passed")).alias(f"c{i}") for i, (name, (a, b)) in enumerate(rules.items())]
    return _rows(df.agg(*cells))


def check_counts(declared: DataFrame, found: DataFrame, key: str, want: str) -> DataFrame:
    """Declared counts against counted rows of another table."""
    counts = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    j = declared.join(counts, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return j.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col(want) == F.col("_n")).alias("n_equal"), F.count_if(F.col(want) != F.col("_n")).alias("n_different"))


def check_class_balance(df: DataFrame, target: str, least: float = 0.05) -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    out = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all"))))
    share = F.col("n") / F.col("_all")
    return out.select(target, "n", F.round(share, 6).alias("share"), (share < least).alias("flagged"))


def column_profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    n, kinds = F.count(F.lit(1)), dict(df.dtypes)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.count(c).alias("n_not_null"), (n - F.count(c)).alias("n_null"), F.round(100.0 * (n - F.count(c)) / n, 4).alias("null_pct"), distinct(c).alias("n_distinct")).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    return _rows(df.agg(*cells))


def non_finite(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, n_nan, n_inf, n_null) for number columns."""
    inf = float("inf")
    cells = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(F.abs(x) == inf).alias("n_inf"), F.count_if(x.isNull()).alias("n_null")).alias(f"c{i}"))
    return _rows(df.agg(*cells))


def audit_matrix(df: DataFrame, key: str) -> DataFrame:
    """Rows, features, values that are null or not finite, and duplicate keys."""
    columns = [c for c in df.columns if c != key]
    inf = float("inf")
    nan = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0) for c in columns])
    infs = reduce(lambda a, b: a + b, [F.when(F.abs(F.col(c).cast("double")) == inf, 1).otherwise(0) for c in columns])
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(nan).alias("nan"), F.sum(infs).alias("inf"))
    return by.agg(F.sum("n").alias("n_rows"), F.lit(len(columns)).alias("n_features"), F.sum("nan").alias("n_nan"), F.sum("inf").alias("n_inf"), (F.sum("n") - F.count(key)).alias("n_duplicate_keys"))


def check_model_inputs(df: DataFrame, key: str, features: Sequence[str], target: str, classes: Sequence[int]) -> DataFrame:
    """One row per check: no target among the features, keys unique, classes complete, values finite."""
    inf = float("inf")
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == inf) for c in features])
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.collect_set(target).alias("y"))
    one = by.agg(F.sum(F.col("n") - 1).alias("d"), F.sum("bad").alias("b"), F.size(F.array_except(F.array(*map(F.lit, classes)), F.array_distinct(F.flatten(F.collect_set("y"))))).alias("m"))
    checks = {"target_absent": F.lit(int(target in features)).cast("long"), "keys_unique": F.col("d"), "values_finite": F.col("b"), "classes_complete": F.col("m").cast("long")}
    cells = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("n_bad"), (v == 0).alias("passed")) for k, v in checks.items()])
    return one.select(F.explode(cells).alias("r")).select("r.*")


def check_probabilities(df: DataFrame, p: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    total = reduce(lambda a, b: a + b, map(F.col, p))
    outside = reduce(lambda a, b: a | b, [~F.col(c).between(0, 1) | F.col(c).isNull() for c in p])
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("n_outside"), F.count_if(F.abs(total - 1) > tolerance).alias("n_bad_sum"))
    return out.withColumn("passed", (F.col("n_outside") == 0) & (F.col("n_bad_sum") == 0))


def check_vectors(df: DataFrame, vector: str) -> DataFrame:
    """All-zero vectors, and the range and mean over all their values."""
    v = F.transform(vector, lambda x: x.cast("double"))
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.forall(vector, lambda x: x == 0)).alias("n_zero"), F.round(F.min(F.array_min(v)), 6).alias("lowest"),
        F.round(F.max(F.array_max(v)), 6).alias("highest"), F.round(F.sum(total) / F.sum(F.size(vector)), 6).alias("mean"),
    )


def check_response(df: DataFrame, shares: Mapping[str, str], confidence: str, probability: str, n_recommendations: str, text: str, tolerance: float = 0.05) -> DataFrame:
    """Invariants of scored responses. shares: share column -> column that says whether the part is present."""
    present = reduce(lambda a, b: a + b, [F.when(F.col(p), F.col(s)).otherwise(0.0) for s, p in shares.items()])
    absent = reduce(lambda a, b: a | b, [~F.col(p) & (F.col(s) >= 0.01) for s, p in shares.items()])
    rules = {
        "shares_sum_to_one": F.abs(present - 1) > tolerance, "absent_parts_below_one_percent": absent, "confidence_of_predicted_class": F.abs(F.col(confidence) - F.col(probability)) > 1e-6,
        "at_most_five_recommendations": F.col(n_recommendations) > 5, "no_raw_names": F.coalesce(F.col(text), F.lit("")).rlike(r"(img_emb_|text_emb_)\d+"),
    }
    return _rows(df.agg(*[F.struct(F.lit(k).alias("check"), F.count_if(F.coalesce(v, F.lit(True))).alias("n_bad")).alias(f"c{i}") for i, (k, v) in enumerate(rules.items())]))
