"""Feature columns and key joins (P07-P26, K01-K15). Fitted state is a table or a small object."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cleaning

#: Right-closed edges of the age bins; the lowest edge is included.
AGE_EDGES = (0, 1, 3, 6, 12, 24, 60, 255)


def equals(column: str, value) -> Column:
    return (F.col(column) == value).cast("int")


def count_equal(columns: Sequence[str], value) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(equals(c, value), F.lit(0)) for c in columns])


def count_nonzero(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce((F.col(c) != 0).cast("int"), F.lit(0)) for c in columns])


def care(column: str, serving: bool = False) -> Column:
    """1 yes, 0 no, -1 not sure; other codes are null in training and 0 when serving."""
    out = cleaning.recode(column, {1: 1, 2: 0, 3: -1})
    return F.coalesce(out, F.lit(0)) if serving else out


def right_closed_bin(column: str, edges: Sequence[float] = AGE_EDGES) -> Column:
    """The bin number; what lies outside goes to the last bin."""
    c, out = F.col(column), None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = ((c >= lo) if i == 0 else (c > lo)) & (c <= hi)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out.otherwise(len(edges) - 2)


def per_unit(amount: str, units: str) -> Column:
    return F.col(amount) / F.greatest(F.col(units), F.lit(1))


def name_features(df: DataFrame, name: str, flag: str) -> DataFrame:
    has = F.col(flag) == 1
    return df.withColumns({"name_length": F.when(has, F.length(name)).otherwise(0), "name_word_count": F.when(has, F.size(F.split(F.trim(name), r"\s+"))).otherwise(0)})


def select_features(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """The declared columns in order; a missing one is null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()])


def decode(df: DataFrame, code: str, dimension: DataFrame, out: str, default: str = "Unknown") -> DataFrame:
    """Code to name by a dimension of (code, name); its size is left to the join planner."""
    k, v = dimension.columns
    d = dimension.select(F.col(k).alias("_code"), F.col(v).alias("_name"))
    return df.join(d, F.col(code) == F.col("_code"), "left").withColumn(out, F.coalesce("_name", F.lit(default))).drop("_code", "_name")


def encode_request(df: DataFrame) -> DataFrame:
    """Form values to codes, with a flag for rows that break a domain."""
    kind = cleaning.recode("pet_type", {"Dog": 1, "Cat": 2})
    vacc = cleaning.recode("vaccinated", {"Yes": 1, "No": 2, "Not Sure": 3})
    valid = kind.isNotNull() & vacc.isNotNull() & F.col("age").between(0, 255) & (F.col("fee") >= 0) & (F.col("quantity") >= 1)
    return df.select(
        "listing_id", kind.alias("type"), vacc.alias("vaccinated"), F.expr("nullif(breed2, 0)").alias("breed2"),
        F.when(F.trim("name") != "", F.col("name")).alias("name"), F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def assemble(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """An ordered vector by the feature list; missing features are 0 and counted."""
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in order]
    return df.withColumns({"vector": F.array(*cells), "n_missing": F.lit(sum(c not in df.columns for c in order))})


def degrade(df: DataFrame, modality: Mapping[str, str], lost: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lit(0).cast(df.schema[c].dataType) for c, m in modality.items() if m in lost and c in df.columns})


def in_top(df: DataFrame, counted: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key is among the n most frequent ones."""
    top = counted.groupBy(key).count().orderBy(F.desc("count"), key).limit(n).select(key)
    return df.join(F.broadcast(top), key, "left_semi")  # n rows


@dataclass
class GroupStats:
    """Per-key counts and means of train rows; unseen keys get the mean over the keys."""

    key: str
    table: DataFrame
    defaults: DataFrame
    columns: list[str]

    @classmethod
    def fit(cls, train: DataFrame, key: str, means: Mapping[str, str], count: str) -> GroupStats:
        table = train.groupBy(key).agg(F.count(F.lit(1)).alias(count), *[F.avg(c).alias(a) for c, a in means.items()])
        columns = [count, *means.values()]
        return cls(key, table, table.agg(*[F.avg(c).alias(f"_{c}") for c in columns]), columns)

    def apply(self, df: DataFrame) -> DataFrame:
        out = df.join(self.table, self.key, "left").crossJoin(F.broadcast(self.defaults))  # one row
        return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in self.columns}).drop(*[f"_{c}" for c in self.columns])


@dataclass
class Frequencies:
    """Shares of values among the train rows that have one; unseen values get the smallest share."""

    column: str
    table: DataFrame
    least: DataFrame

    @classmethod
    def fit(cls, train: DataFrame, column: str) -> Frequencies:
        rows = train.where(F.col(column).isNotNull())
        counts = rows.groupBy(column).count()
        table = counts.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("_n")))).select(column, (F.col("count") / F.col("_n")).alias("_share"))
        return cls(column, table, table.agg(F.min("_share").alias("_least")))

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        return df.join(self.table, self.column, "left").crossJoin(F.broadcast(self.least)).withColumn(out, F.coalesce("_share", "_least")).drop("_share", "_least")


def left_fill(left: DataFrame, right: DataFrame, key: str, value: float = 0.0) -> DataFrame:
    return left.join(right, key, "left").na.fill(value, [c for c in right.columns if c != key])


def fuse(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join on the key; every frame stays partitioned by it."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def _orphan(df: DataFrame, fk: str, dimension: DataFrame, pk: str, allow_zero: bool) -> DataFrame:
    d = dimension.select(F.col(pk).alias("_pk")).distinct().withColumn("_hit", F.lit(True))
    ok = F.coalesce(F.col("_hit"), F.lit(False))
    if allow_zero:
        ok = ok | F.coalesce(F.col(fk) == 0, F.lit(False))
    return df.join(d, F.col(fk) == F.col("_pk"), "left").select(F.col(fk).alias("value"), ok.alias("ok"))


def integrity(df: DataFrame, fk: str, dimension: DataFrame, pk: str, allow_zero: bool = False) -> DataFrame:
    rows = _orphan(df, fk, dimension, pk, allow_zero)
    out = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("orphans"))
    return out.withColumn("coverage_pct", F.round(F.when(F.col("total") == 0, 100.0).otherwise(100.0 * F.col("valid") / F.col("total")), 2))


def orphans(df: DataFrame, fk: str, dimension: DataFrame, pk: str, allow_zero: bool = False, most: int = 50) -> DataFrame:
    bad = _orphan(df, fk, dimension, pk, allow_zero).where(~F.col("ok"))
    return bad.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy("value").limit(most)


def key_coverage(keys: DataFrame, found: DataFrame, key: str, least_pct: float) -> DataFrame:
    hit = found.select(key).distinct().withColumn("_hit", F.lit(1))
    out = keys.select(key).distinct().join(hit, key, "left").agg(F.count(F.lit(1)).alias("n_keys"), F.count("_hit").alias("n_matched"))
    pct = 100.0 * F.col("n_matched") / F.col("n_keys")
    return out.withColumns({"coverage_pct": F.round(pct, 2), "passed": pct >= least_pct})


def key_alignment(first: DataFrame, others: Mapping[str, DataFrame]) -> DataFrame:
    """Keys that only the first frame has, and only the other, for each other frame."""
    key = first.columns[0]
    rows = []
    for name, other in others.items():
        both = first.distinct().withColumn("_a", F.lit(1)).join(other.distinct().withColumn("_b", F.lit(1)), key, "full")
        rows.append(both.agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_other")).select(F.lit(name).alias("other"), "only_first", "only_other"))
    return reduce(DataFrame.unionByName, rows)


def scenarios(df: DataFrame, grid: Mapping[str, Sequence[float]], key: str) -> DataFrame:
    """Each row with each candidate change that differs from its value; a grid of a few rows, exploded in place."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("candidate"), F.col(f).cast("double").alias("current")) for f, values in grid.items() for v in values])
    return df.withColumn("_c", F.explode(cells)).select("*", "_c.*").drop("_c").where("candidate <> current")


def subset_check(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    out = part.select(key).distinct().join(whole.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_outside"))
    return out.withColumn("passed", F.col("n_outside") == 0)


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, that only one side has; one shuffle of both sides."""
    both = left.withColumn("_d", F.lit(1)).unionByName(right.withColumn("_d", F.lit(-1)))
    d = both.groupBy(*left.columns).agg(F.sum("_d").alias("_d"))
    return d.agg(F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("only_right"))


def field_check(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """present, missing or extra for each column name, and whether its place is the wanted one."""
    have = df.columns
    rows = [(c, "present" if c in wanted and c in have else "missing" if c in wanted else "extra", c in wanted and c in have and list(wanted).index(c) == have.index(c)) for c in sorted({*have, *wanted})]
    return df.sparkSession.createDataFrame(rows, "column string, status string, same_place boolean")
