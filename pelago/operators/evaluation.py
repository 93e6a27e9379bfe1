"""Evaluation of ordinal classifiers over prediction tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import quantiles, running_counts

CLASSES = (0, 1, 2, 3, 4)
#: Readable names of the classes.
LABELS = {0: "Same day", 1: "1-7 days", 2: "8-30 days", 3: "31-90 days", 4: "Not adopted (100+ days)"}


def stratified_folds(df: DataFrame, key: str, target: str, k: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """(key, fold): within each class, rows in the order of a seeded hash are dealt in turn.

    A class can hold most rows, so no class is numbered as a whole: rows are numbered inside hash
    buckets, and each bucket starts where the counts of the buckets before it end. The buckets'
    starts, 1,024 rows for each class, are broadcast if Spark finds them small enough.
    order: a 64-bit number to deal by, if not the seeded hash.
    """
    h = F.xxhash64(F.lit(seed), F.col(key)) if order is None else order
    rows = df.select(key, target, h.alias("_h")).withColumn("_b", F.shiftrightunsigned("_h", 54))
    counts = rows.groupBy(target, "_b").agg(F.count(F.lit(1)).alias("_n"))
    start = counts.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy(target).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy(target, "_b").orderBy("_h", key)) - 1
    return rows.withColumn("_r", place).join(start, [target, "_b"]).select(key, target, F.pmod(F.col("_start") + F.col("_r"), F.lit(k)).cast("int").alias("fold"))


def fold_balance(folds: DataFrame, target: str, tolerance: float = 0.02) -> DataFrame:
    by = folds.groupBy("fold", target).agg(F.count(F.lit(1)).alias("n"))
    share = by.withColumn("s", F.col("n") / F.sum("n").over(W.partitionBy("fold"))).withColumn("t", F.sum("n").over(W.partitionBy(target)))
    whole = by.agg(F.sum("n").alias("all"))
    d = F.abs(F.col("s") - F.col("t") / F.col("all"))
    return share.crossJoin(F.broadcast(whole)).groupBy("fold").agg(F.sum("n").alias("n"), F.round(F.max(d), 4).alias("max_difference"), (F.max(d) <= tolerance).alias("balanced"))


def expected_value(p: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * i for i, c in enumerate(p)])


def by_thresholds(ev: Column, cuts: Sequence[float]) -> Column:
    """The number of cuts that the value reaches."""
    return reduce(lambda a, b: a + b, [(ev >= c).cast("int") for c in sorted(cuts)])


def argmax(p: Sequence[str]) -> Column:
    """The first class of the largest probability."""
    top = F.greatest(*p)
    return F.coalesce(*[F.when(F.col(c) == top, i) for i, c in enumerate(p)])


def scored(df: DataFrame, p: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    """Expected value, thresholded and largest class, P(thresholded class), largest probability."""
    ev = expected_value(p)
    out = df.withColumn("expected_value", ev).withColumns({"predicted": by_thresholds(F.col("expected_value"), cuts), "argmax": argmax(p), "max_probability": F.greatest(*p)})
    return out.withColumn("confidence", F.get(F.array(*p), F.col("predicted")))


def confusion(df: DataFrame, y: str, yhat: str, classes: Sequence[int] = CLASSES, weight: str | None = None) -> DataFrame:
    """(y, yhat, n) for all pairs, with the zeros. weight: how many rows a row stands for."""
    count = lambda hit: F.count_if(hit) if weight is None else F.coalesce(F.sum(F.when(hit, F.col(weight))), F.lit(0))
    cells = F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("yhat"), count((F.col(y) == a) & (F.col(yhat) == b)).alias("n")) for a in classes for b in classes])
    return df.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def per_class(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class from (y, yhat, n)."""
    cls = F.explode(F.array(F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).alias("guessed")), F.struct(F.col("yhat").alias("cls"), F.lit(0).alias("support"), F.col("n").alias("guessed"))))
    sums = matrix.select(cls.alias("c"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hit")).select("c.*", "hit").groupBy("cls").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), (F.sum("hit") / 2).alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.withColumns({"precision": ratio(F.col("hit"), F.col("guessed")), "recall": ratio(F.col("hit"), F.col("support"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("hit", "guessed")


def summary(matrix: DataFrame) -> DataFrame:
    f = per_class(matrix)
    acc = matrix.agg((F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return f.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1")).crossJoin(acc).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


def quadratic_kappa(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """1 - sum(w O) / sum(w E) with w = (y - yhat)^2, from sums alone: no matrix is built. weight: how many
    rows a row stands for."""
    a, b = F.col(y).cast("double"), F.col(yhat).cast("double")
    n, total = (F.count(F.lit(1)), F.sum) if weight is None else (F.sum(weight), lambda c: F.sum(c * F.col(weight)))
    sums = df.groupBy(*by).agg(n.alias("n"), total((a - b) * (a - b)).alias("o"), total(a).alias("sa"), total(b).alias("sb"), total(a * a).alias("saa"), total(b * b).alias("sbb"))
    e = F.col("saa") + F.col("sbb") - 2 * F.col("sa") * F.col("sb") / F.col("n")
    return sums.select(*by, "n", F.round(F.when(e > 0, 1 - F.col("o") / e), 6).alias("kappa"))


def diagnostics(df: DataFrame, classes: Sequence[int] = CLASSES, low: float = 0.30) -> DataFrame:
    """Confidence summary of a scored table, with its empty and its dominating classes."""
    n = F.count(F.lit(1))
    counts = F.array(*[F.struct(F.lit(c).alias("c"), F.count_if(F.col("predicted") == c).alias("n")) for c in classes])
    one = df.agg(
        n.alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.min("confidence"), 6).alias("min"), F.round(F.max("confidence"), 6).alias("max"),
        F.round(F.stddev_pop("confidence"), 6).alias("std"), F.count_if(F.col("confidence") < low).alias("n_low"), F.round(100.0 * F.count_if(F.col("confidence") < low) / n, 4).alias("pct_low"), counts.alias("counts"),
    )
    one = one.crossJoin(quantiles(df, "confidence", [0.5]).select(F.round("q0", 6).alias("median")))  # one row each
    listed = lambda keep: F.array_join(F.transform(F.filter("counts", keep), lambda x: x["c"].cast("string")), ",")
    return one.withColumns({"empty_classes": listed(lambda x: x["n"] == 0), "above_half": listed(lambda x: x["n"] > F.col("n") / 2)}).drop("counts")


def calibration(df: DataFrame, y: str, p: Sequence[str], bins: int = 10) -> DataFrame:
    """For each class and bin: observed share, mean predicted probability and count, rounded to 4."""
    cells = F.array(*[F.struct(F.lit(i).alias("cls"), F.col(c).alias("p"), (F.col(y) == i).cast("int").alias("hit")) for i, c in enumerate(p)])
    rows = df.select(F.explode(cells).alias("c")).select("c.*").withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    return rows.groupBy("cls", "bin").agg(F.round(F.avg("hit"), 4).alias("observed"), F.round(F.avg("p"), 4).alias("predicted"), F.count(F.lit(1)).alias("n"))


def calibration_error(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cls").agg(F.round(F.sum(F.abs(F.col("observed") - F.col("predicted")) * F.col("n")) / F.sum("n"), 4).alias("ece"))


def error_profile(df: DataFrame, y: str, yhat: str, confidence: str) -> DataFrame:
    wrong, n = F.col(y) != F.col(yhat), F.count(F.lit(1))
    return df.agg(
        n.alias("n"), F.round(F.count_if(wrong) / n, 6).alias("error_rate"), F.count_if(F.col(yhat) > F.col(y)).alias("n_over"), F.count_if(F.col(yhat) < F.col(y)).alias("n_under"), F.round(F.avg(F.abs(F.col(yhat) - F.col(y))), 6).alias("mean_abs_error"),
        F.round(F.avg(F.when(wrong, F.col(confidence))), 6).alias("confidence_wrong"), F.round(F.avg(F.when(~wrong, F.col(confidence))), 6).alias("confidence_right"),
    ).crossJoin(quantiles(df.where(wrong), confidence, [0.5]).select(F.round("q0", 6).alias("median_wrong")))  # one row each


def class_shares(df: DataFrame, yhat: str, train: DataFrame, y: str, classes: Sequence[int] = CLASSES) -> DataFrame:
    """For each class of the list: predictions and training rows with it, as counts and percent; zeros where there are none."""
    count = lambda d, c, name: d.agg(F.array(*[F.count_if(F.col(c) == k) for k in classes]).alias(name), F.count(F.lit(1)).alias(f"{name}_all"))
    one = count(df, yhat, "n").crossJoin(count(train, y, "m"))  # one row each
    pct = lambda c: F.round(F.when(F.col(f"{c}_all") > 0, 100.0 * F.col("x")[c] / F.col(f"{c}_all")).otherwise(0.0), 4)
    cells = F.arrays_zip(F.array(*[F.lit(k) for k in classes]).alias("cls"), "n", "m")
    return one.select(F.explode(cells).alias("x"), "n_all", "m_all").select("x.cls", F.col("x.n").alias("n_predicted"), pct("n").alias("pct_predicted"), F.col("x.m").alias("n_training"), pct("m").alias("pct_training"))


def error_by_class(df: DataFrame, y: str, yhat: str) -> DataFrame:
    wrong = F.count_if(F.col(y) != F.col(yhat))
    return df.groupBy(y).agg(F.count(F.lit(1)).alias("n"), wrong.alias("n_wrong"), F.round(wrong / F.count(F.lit(1)), 6).alias("error_rate"))


def error_pairs(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.where(F.col(y) != F.col(yhat)).groupBy(y, yhat).agg(F.count(F.lit(1)).alias("n"))


def worst_errors(df: DataFrame, key: str, y: str, yhat: str, confidence: str, n: int) -> DataFrame:
    """The n rows with the largest gap, then confidence, then key."""
    gap = F.abs(F.col(yhat) - F.col(y))
    return df.select(key, y, yhat, gap.alias("gap"), confidence).orderBy(F.desc("gap"), F.desc(confidence), F.desc(key)).limit(n).where("gap > 0")


def worst_with_contributions(worst: DataFrame, key: str, yhat: str, long: DataFrame, k: int = 5) -> DataFrame:
    """Each worst row with the k largest contributions to its predicted class, by size, then name.

    worst has a stated number of rows; it is broadcast into the long table (row_id, cls, feature,
    value, contribution) before anything is ranked, so only its rows are sorted."""
    few = F.broadcast(worst)
    hit = long.join(few, (F.col("row_id") == F.col(key)) & (F.col("cls") == F.col(yhat)))
    place = F.row_number().over(W.partitionBy("row_id").orderBy(F.desc(F.abs("contribution")), "feature"))
    return hit.withColumn("place", place).where(F.col("place") <= k).select(*worst.columns, "place", "feature", "value", "contribution")


def soft_vote(models: Sequence[tuple[DataFrame, float]], key: str, p: Sequence[str]) -> DataFrame:
    """Weighted mean of the class probabilities of several models; weights are normalised."""
    total = sum(w for _, w in models)
    rows = reduce(DataFrame.unionByName, [m.select(key, *[(F.col(c) * (w / total)).alias(c) for c in p]) for m, w in models])
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in p])


#: Cells of the coarse grid of cuts, and cells of the fine one in each of them.
COARSE, FINER = 40, 5


def ev_bin(ev: str, classes: int = 5, fine: int = COARSE * FINER) -> Column:
    """The cell of the fine grid in which an expected value lies."""
    return F.least(F.greatest(F.floor(F.col(ev) * (fine / (classes - 1))), F.lit(0)), F.lit(fine - 1)).cast("int")


def cuts_reached(ev: str, classes: int = 5, fine: int = COARSE * FINER) -> Column:
    """How many of the fine grid's cuts above 0 the value reaches, as by_thresholds() compares them (not a
    number: all)."""
    edge = lambda c: c * (classes - 1) / F.lit(float(fine))
    near = F.least(F.greatest(F.floor(F.col(ev) * (fine / (classes - 1))), F.lit(0)), F.lit(fine))
    exact = near - (F.col(ev) < edge(near)).cast("int") + (F.col(ev) >= edge(near + 1)).cast("int")
    return F.when(F.isnan(ev), F.lit(fine)).otherwise(F.greatest(F.lit(0), F.least(exact, F.lit(fine)))).cast("int")


def threshold_search(df: DataFrame, y: str, ev: str, classes: int = 5, coarse: int = COARSE, finer: int = FINER) -> DataFrame:
    """One row (cuts, kappa): the cuts that maximise quadratic kappa, from one pass that counts the rows by
    bin of the expected value, coarse * finer bins."""
    t = F.col(y).cast("long")
    counts = df.groupBy(ev_bin(ev, classes, coarse * finer).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("y"), F.sum(t * t).alias("yy"))
    return search_cuts(counts, (), classes, coarse, finer).select("cuts", "kappa")


def search_cuts(counts: DataFrame, by: Sequence[str] = (), classes: int = 5, coarse: int = COARSE, finer: int = FINER) -> DataFrame:
    """(by, cuts, places, kappa) from (by, b, n, y, yy): rows, sum of true classes and of their squares in each
    bin. places are the cuts as numbers of the fine grid.

    All that kappa needs of a cut is how many rows, and which sum of true classes, lie above it, and both
    are cumulative counts; so every rising choice of cuts on the coarse grid is a row, crossed with those
    counts, and so is every choice on the fine grid within one coarse step of the best. The number of
    choices depends on the grids alone, and the tasks share them. Among equal kappas the smallest cuts win."""
    spark, top, fine, by = counts.sparkSession, classes - 1, coarse * finer, list(by)
    above = lambda name: F.transform(F.sequence(F.lit(0), F.lit(fine)), lambda c: F.aggregate("bins", F.lit(0).cast("long"), lambda s, x: s + F.when(x["b"] >= c, x[name]).otherwise(0)))
    one = counts.groupBy(*by).agg(F.collect_list(F.struct("b", "n", "y", "yy")).alias("bins")).select(*by, above("n").alias("n"), above("y").alias("y"), above("yy")[0].alias("syy"))  # one row of arrays with fine + 1 numbers for each group
    names = [f"c{i}" for i in range(1, top + 1)]
    rising = lambda: reduce(lambda a, b: a & b, [F.col(a) <= F.col(b) for a, b in zip(names, names[1:])], F.lit(True))  # noqa: E731, B905

    def choices(size: int) -> DataFrame:
        """All (c1, c2, ...) of numbers below size."""
        return spark.range(size**top).select(*[F.expr(f"cast(id div {size ** (top - 1 - i)} % {size} as int)").alias(c) for i, c in enumerate(names)])

    def best(rows: DataFrame) -> DataFrame:
        """The best of the choices of each group, a column for each cut."""
        total = lambda part: reduce(lambda a, b: a + b, [part(i, F.col(c)) for i, c in enumerate(names)])
        p, q, r = total(lambda i, c: F.get("n", c)), total(lambda i, c: F.get("y", c)), total(lambda i, c: (2 * i + 1) * F.get("n", c))
        e = F.col("syy") + r - 2.0 * F.get("y", F.lit(0)) * p / F.nullif(F.get("n", F.lit(0)), F.lit(0))
        kappa = F.when(e > 0, 1 - (F.col("syy") - 2 * q + r) / e).otherwise(0.0)
        return rows.groupBy(*by).agg(F.max(F.struct(kappa.alias("kappa"), *[(-F.col(c)).alias(c) for c in names])).alias("best"))

    first = best(choices(coarse + 1).where(rising()).select(*[(F.col(c) * finer).alias(c) for c in names]).crossJoin(F.broadcast(one)))
    both = one.join(first, by) if by else one.crossJoin(F.broadcast(first))  # one row for each group
    near = choices(2 * finer + 1).crossJoin(F.broadcast(both)).withColumns({c: F.col(c) - finer - F.col(f"best.{c}") for c in names})
    second = best(near.drop("best").where((F.col(names[0]) >= 0) & (F.col(names[-1]) <= fine) & rising()))
    return second.select(*by, F.array(*[-F.col(f"best.{c}") * top / F.lit(fine) for c in names]).alias("cuts"), F.array(*[-F.col(f"best.{c}") for c in names]).alias("places"), "best.kappa")


def optimize_thresholds(df: DataFrame, y: str, ev: str, classes: int = 5) -> tuple[list[float], float]:
    """The cuts of threshold_search() and their kappa, as numbers."""
    r = threshold_search(df, y, ev, classes).collect()[0]
    return [float(c) for c in r["cuts"]], float(r["kappa"])


def class_share_draw(train: DataFrame, y: str, df: DataFrame, key: str) -> DataFrame:
    """(key, drawn): a class for every row of df, drawn by the shares that the classes have in train.

    The draw is a number of 52 bits from the key's md5, laid on the cumulative counts: it is the same
    on every run and machine. One row with an entry for each class is broadcast."""
    counts = train.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    edges = counts.agg(F.array_sort(F.collect_list(F.struct(F.col(y).alias("c"), F.col("_n").alias("n")))).alias("_e"), F.sum("_n").alias("_all"))
    u = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    rows = df.select(key).crossJoin(F.broadcast(edges)).withColumn("_u", u * F.col("_all"))
    step = lambda s, e: F.struct((s["sum"] + e["n"]).alias("sum"), F.coalesce(s["c"], F.when(F.col("_u") < s["sum"] + e["n"], e["c"])).alias("c"))
    kind = train.schema[y].dataType
    return rows.select(key, F.aggregate("_e", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast(kind).alias("c")), step)["c"].alias("drawn"))


def gap_status(train: Column, valid: Column) -> Column:
    gap = train - valid
    return F.when(gap > 0.10, "CRITICAL").when(gap > 0.05, "WARNING").otherwise("OK")


def paired_t(df: DataFrame, pair: str, a: str, b: str) -> DataFrame:
    """Mean difference and t statistic of paired values, by pair of models."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(pair).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("difference"), F.stddev(d).alias("_s"))
    return out.withColumn("t", F.when(F.col("_s") > 0, F.col("difference") / (F.col("_s") / F.sqrt("n")))).drop("_s")


def t_probability(t: float, freedom: int) -> float:
    """Two-sided: the incomplete beta function at freedom / (freedom + t^2), by its continued fraction."""
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front / b * _beta_fraction(b, a, 1 - x)
    return front / a * _beta_fraction(a, b, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def signed_rank_probability(w: float, n: int, ties: float) -> float:
    """Two-sided, of the smaller rank sum: exact up to 25 values without ties, else the normal limit."""
    if n == 0:
        return 1.0
    if n <= 25 and ties == 0:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread > 0 else 1.0


def signed_ranks(df: DataFrame, pair: str, a: str, b: str) -> DataFrame:
    """Wilcoxon's rank sums of paired values by pair: n without zeros, and the smaller sum. Ranks come
    from running counts over the distinct differences, so no task orders a pair's rows."""
    d = df.select(pair, F.round(F.col(a) - F.col(b), 12).alias("_d")).where("_d <> 0").withColumn("_v", F.abs("_d"))
    counts = d.groupBy(pair, "_v").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") > 0).alias("_up"))
    rank = F.col("_below") + (F.col("_n") + 1) / 2
    sums = running_counts(counts, "_v", "_n", [pair]).groupBy(pair).agg(
        F.sum("_n").alias("n"), F.sum(rank * F.col("_up")).alias("_plus"), F.sum(rank * (F.col("_n") - F.col("_up"))).alias("_minus"), F.sum((F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")).cast("double")).alias("ties")
    )
    return sums.select(pair, "n", F.least("_plus", "_minus").alias("w"), "ties")


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_probability(x, int(m) - 1) if x == x and x is not None and m > 1 else None for x, m in zip(t, n, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _w_p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_probability(x, int(m), k) for x, m, k in zip(w, n, ties, strict=True)], dtype="float64")


def paired_tests(df: DataFrame, pair: str, a: str, b: str) -> DataFrame:
    """paired_t with its two-sided probability, and Wilcoxon's rank sum with its own, one row per pair."""
    ranks = signed_ranks(df, pair, a, b).select(pair, "w", _w_p("w", "n", "ties").alias("p_w"))
    return paired_t(df, pair, a, b).withColumn("p_t", _t_p("t", "n")).join(ranks, pair, "left").withColumn("p_w", F.coalesce("p_w", F.lit(1.0)))


def rank_candidates(df: DataFrame, family: str, metric: str) -> DataFrame:
    """Rank by the metric, and the best of each family; a few rows per trial."""
    out = df.withColumn("rank", F.rank().over(W.orderBy(F.desc(metric))))
    return out.withColumn("best_of_family", F.row_number().over(W.partitionBy(family).orderBy(F.desc(metric), "trial")) == 1)


def select_model(df: DataFrame, gap: str, metric: str, most: float = 0.10) -> DataFrame:
    return df.where(F.col(gap).isNull() | (F.col(gap) < most)).orderBy(F.desc(metric), "trial").limit(1)


def prediction_detail(df: DataFrame, key: str, p: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    rows = scored(df, p, cuts)
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("predicted")]
    return rows.select(
        key, F.col("predicted").alias("predicted_class"), label.alias("predicted_label"), F.round("max_probability", 6).alias("confidence"), F.round("expected_value", 6).alias("expected_value"),
        *[F.round(c, 6).alias(f"prob_class_{i}") for i, c in enumerate(p)], F.col("argmax").alias("argmax_class"), F.lit("threshold").alias("prediction_method"),
    )
