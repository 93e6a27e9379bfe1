"""Exploratory statistics (A01-A22): grouped counts, moments, association, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import join_split


def _with_total(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts with the total, overall (one broadcast row) or within the given keys."""
    if not by:
        return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return counts.withColumn("total", F.sum("n").over(W.partitionBy(*by)))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return _with_total(counts).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and percent of each class, with the largest, the smallest and their ratio."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.max("n").alias("hi"), F.min("n").alias("lo"), F.min_by(target, F.struct(-F.col("n"), F.col(target))).alias("majority"), F.min_by(target, F.struct("n", target)).alias("minority"))
    out = counts.crossJoin(F.broadcast(whole))
    return out.select(target, "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"), F.round(F.col("hi") / F.col("lo"), 4).alias("imbalance_ratio"), "majority", "minority")


def skewness(c: str) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments in one pass; medians from running counts over the values of all columns."""
    cells = []
    for i, c in enumerate(columns):
        parts = {"n": F.count(c), "mean": F.avg(c), "std": F.stddev(c), "min": F.min(c).cast("double"), "max": F.max(c).cast("double"), "skew": skewness(c), "kurt": kurtosis(c)}
        cells.append(F.struct(F.lit(c).alias("column"), *[(v if k == "n" else F.round(v, 4)).alias(k) for k, v in parts.items()]).alias(f"c{i}"))
    one = df.agg(*cells)
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    medians = quantiles(df.select(F.explode(values).alias("v")).select("v.*"), "value", [0.5], ["column"])
    out = one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*").join(medians, "column", "left")
    return out.select("column", "n", "mean", F.round("q0", 4).alias("median"), "std", "min", "max", "skew", "kurt")


def grouped_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    means = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 2).alias("mean"), F.round(F.stddev(value), 2).alias("std"))
    return means.join(quantiles(df, value, [0.5], [by]), by, "left").select(by, "n", "mean", F.round("q0", 2).alias("median"), "std")


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    q = quantiles(df, column, [0.25, 0.75]).select(F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    bounds = q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({"low": F.col("q1") - 1.5 * F.col("iqr"), "high": F.col("q3") + 1.5 * F.col("iqr")})
    out = df.crossJoin(F.broadcast(bounds))  # one row
    bad = F.count_if((F.col(column) < F.col("low")) | (F.col(column) > F.col("high")))
    return out.groupBy("q1", "q3", "iqr", "low", "high").agg(bad.alias("n_outside"), F.round(100.0 * bad / F.count(F.lit(1)), 4).alias("pct_outside"))


def percentiles(df: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    one = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")).crossJoin(quantiles(df, column, points))  # one row each
    return one.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")], *[F.round(f"q{i}", 4).alias(f"p{round(100 * x)}") for i, x in enumerate(points)])


def crosstab_pct(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Percent of each column value within a row value; the values are given, so one pass is enough."""
    n = F.count(F.lit(1))
    return df.groupBy(row).agg(*[F.round(100.0 * F.count_if(F.col(column) == v) / n, 4).alias(f"pct_{v}") for v in values])


def contingency(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def running_counts(counts: DataFrame, value: str, n: str, by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """counts with `_below`: the sum of n over smaller values, within the given keys.

    Values are dealt into buckets at approximate quantiles; a bucket starts where the sums of the
    buckets before it end, so no task orders all values. Exact whatever the quantiles are."""
    by, v = list(by), F.col(value).cast("double")
    # n is named here too, so that all readers of counts want the same columns and share its shuffle
    edges = counts.groupBy(*by).agg(F.percentile_approx(F.when(F.col(n) > 0, v), [i / buckets for i in range(1, buckets)], 1000).alias("_edges"))
    rows = counts.join(edges, by) if by else counts.crossJoin(F.broadcast(edges))  # one row
    rows = rows.withColumn("_bucket", F.coalesce(F.size(F.filter("_edges", lambda e: e < v)), F.lit(-1))).drop("_edges")
    sums = rows.groupBy(*by, "_bucket").agg(F.sum(n).alias("_in"))
    before = lambda key, order: W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_in").over(before(by, "_bucket")), F.lit(0))).drop("_in")
    out = rows.join(starts, [*by, "_bucket"])
    return out.withColumn("_below", F.col("_start") + F.coalesce(F.sum(n).over(before([*by, "_bucket"], value)), F.lit(0))).drop("_bucket", "_start")


def quantiles(df: DataFrame, column: str, points: Sequence[float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, as columns q0, q1, ..., overall or by keys; weight: how often a row counts.

    Unlike a percentile aggregate, no task holds all values: positions come from running counts."""
    one = neighbours(df, column, points, by, weight)
    return one.select(*by, *[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}") for i in range(len(points))])


def neighbours(df: DataFrame, column: str, points: Sequence[float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """The values beside each quantile, _lo0, _hi0, ..., its place between them, _f0, ..., and the smallest value, _least."""
    by = list(by)
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    rows = running_counts(counts, "_v", "_n", by)
    rows = rows.join(totals, by) if by else rows.crossJoin(F.broadcast(totals))  # one row
    value_at = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_n")), F.col("_v")))
    cells = []
    for i, p in enumerate(points):
        h = F.lit(float(p)) * (F.col("_all") - 1)
        cells += [value_at(F.floor(h)).alias(f"_lo{i}"), value_at(F.ceil(h)).alias(f"_hi{i}"), F.max(h - F.floor(h)).alias(f"_f{i}")]
    return rows.groupBy(*by).agg(F.min("_v").alias("_least"), *cells)


def average_ranks(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Average ranks of each column by key, from running counts over its distinct values; a value that
    many rows share does not gather them in one task."""
    out, total = df.select(key, *columns), df.count()
    for c in columns:
        counts = running_counts(df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), c, "_n")
        ranks = counts.withColumn(f"rank_{c}", F.col("_below") + (F.col("_n") + 1) / 2)
        out = join_split(out, ranks, c, c, "_n", f"rank_{c}", F.xxhash64(key), total=total)
    return out


def spearman(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    whole = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    ranked = average_ranks(whole, key, columns)
    return pearson(ranked.select(*[F.col(f"rank_{c}").alias(c) for c in columns]), columns)


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """V of each pair of categories, with Yates' correction on 2 x 2 tables."""
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs])
    o = df.select(F.explode(cells).alias("c")).select("c.*").where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    rows, cols = o.groupBy("a", "b", "x").agg(F.sum("n").alias("nx")), o.groupBy("a", "b", "y").agg(F.sum("n").alias("ny"))
    dims = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("r"), F.sum("nx").alias("total")).join(cols.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")), ["a", "b"])
    grid = rows.join(cols, ["a", "b"]).join(o, ["a", "b", "x", "y"], "left").join(dims, ["a", "b"])
    e = F.col("nx") * F.col("ny") / F.col("total")
    d = F.abs(F.coalesce("n", F.lit(0)) - e)
    small = (F.col("r") == 2) & (F.col("k") == 2)
    d = F.when(small, d - F.least(F.lit(0.5), d)).otherwise(d)
    chi = grid.groupBy("a", "b", "r", "k", "total").agg(F.sum(d * d / e).alias("chi2"))
    least = F.least("r", "k") - 1
    return chi.select("a", "b", F.round("chi2", 4).alias("chi2"), F.round(F.when(least > 0, F.sqrt(F.col("chi2") / (F.col("total") * least))).otherwise(0.0), 6).alias("v"))


def histogram(df: DataFrame, column: str, by: str, bins: int, cap: float = 0.99) -> DataFrame:
    """Counts in equal bins of what is not above the capped percentile; the last bin is closed.

    Rows are counted by value once; the cap, the edges and the bins all come from these counts."""
    v = F.col("_x")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_x"), by).agg(F.count(F.lit(1)).alias("_n"))
    edge = neighbours(counts, "_x", [cap], weight="_n").select("_least", F.col("_lo0").alias("_most"))  # no value lies between _most and the cap
    rows = counts.crossJoin(F.broadcast(edge)).where(v <= F.col("_most"))  # one row
    b = F.least(F.floor((v - F.col("_least")) / ((F.col("_most") - F.col("_least")) / bins)), F.lit(bins - 1))
    return rows.groupBy(F.coalesce(b, F.lit(0)).cast("int").alias("bin"), by).agg(F.sum("_n").alias("n"))


def zero_filled(counts: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return keys.join(counts, list(on), "left").na.fill(0, ["n"])


def category_by_class(df: DataFrame, category: str, target: str, classes: Sequence[int]) -> DataFrame:
    """Counts of each category and class, with the zeros; one row per category is exploded over the classes."""
    wide = df.groupBy(category).agg(*[F.count_if(F.col(target) == c).alias(f"n{c}") for c in classes])
    return wide.select(category, F.explode(F.array(*[F.struct(F.lit(c).alias(target), F.col(f"n{c}").alias("n")) for c in classes])).alias("x")).select(category, "x.*")


def pareto_count(df: DataFrame, column: str, share: float = 0.8) -> DataFrame:
    """Categories, largest first, that reach the share; found from the counts of counts."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy((-F.col("n")).alias("order")).agg(F.count(F.lit(1)).alias("times"), F.sum("n").alias("mass"))
    total = sizes.agg(F.sum("mass").alias("all"), F.sum("times").alias("n_categories"))
    above = running_counts(sizes, "order", "mass").crossJoin(F.broadcast(total))  # one row
    within = F.least("times", F.greatest(F.lit(0), F.floor((share * F.col("all") - F.col("_below")) / -F.col("order") + 1e-9)))
    return above.agg(F.max("n_categories").alias("n_categories"), (F.sum(within) + 1).alias("n_needed"))


def top_groups(df: DataFrame, segment: str, group: str, value: str, k: int) -> DataFrame:
    agg = df.groupBy(segment, group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"))
    return agg.withColumn("rank", F.row_number().over(W.partitionBy(segment).orderBy(F.desc("n"), group))).where(F.col("rank") <= k)


def key_activity(df: DataFrame, key: str, target: str, amount: str, count: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(target), 4).alias("mean_target"), F.round(F.percentile(amount, F.lit(0.5)), 4).alias("median_amount"), F.round(F.avg(count), 4).alias("mean_count"))


def frequency_of_frequency(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("times"))
    return counts.groupBy("times").agg(F.count(F.lit(1)).alias("n_values"))


def pivot_mean(df: DataFrame, row: str, column: str, values: Sequence, value: str) -> DataFrame:
    return df.groupBy(row).agg(*[F.round(F.avg(F.when(F.col(column) == v, F.col(value))), 4).alias(f"mean_{v}") for v in values])


def presence_comparison(df: DataFrame, flag: Column, target: str) -> DataFrame:
    counts = df.groupBy(flag.alias("present"), target).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("present")
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(w), 4)).withColumn("mean_target", F.round(F.sum(F.col("n") * F.col(target)).over(w) / F.sum("n").over(w), 6))
