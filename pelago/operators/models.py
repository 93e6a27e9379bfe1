"""Learners on Spark ML (M04-M05, M16-M19, M22, M26, E01, E13-E14, S20), deterministic by seed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import work_dir
from . import evaluation as E
from . import features as X

P = [f"p{i}" for i in range(5)]
CUTS = (1.8, 1.95, 2.05, 2.2)
#: Candidate changes per feature, for the grid of alternatives.
GRID = {"photos": [1, 3, 5, 7, 10], "vaccinated": [1], "dewormed": [1], "fee": [0, 10, 25, 50], "quantity": [1]}


class BoostedOneVsRest:
    """Boosted trees for several classes: one binary booster for each class against the rest, its margin
    calibrated by a logistic curve on one in five training rows that no tree has seen (by a hash of the
    key), and the calibrated probabilities normalised. A class with one kind of training row only keeps
    its share as its probability."""

    def __init__(self, seed: int = 42, classes: int = len(P), key: str = "listing_id"):
        self.settings = {"maxIter": 6, "maxDepth": 3, "stepSize": 0.3, "seed": seed}
        self.classes, self.key, self.seed = classes, key, seed
        self.features, self.label = "features", "label"

    def setFeaturesCol(self, name: str) -> BoostedOneVsRest:
        self.features = name
        return self

    def setLabelCol(self, name: str) -> BoostedOneVsRest:
        self.label = name
        return self

    def setParams(self, **settings) -> BoostedOneVsRest:
        self.settings |= settings
        return self

    def fit(self, rows: DataFrame) -> BoostedModel:
        aside = F.pmod(F.xxhash64(F.lit(self.seed), F.col(self.key)), F.lit(5)) == 0
        data = rows.select(self.features, F.col(self.label).cast("int").alias("_y"), aside.alias("_aside")).persist()
        counts = {(r["_y"], r["_aside"]): r["count"] for r in data.groupBy("_y", "_aside").count().collect()}  # two rows for each class
        n = {side: sum(v for (_, s), v in counts.items() if s == side) for side in (False, True)}

        def member(k: int) -> tuple:
            one = data.withColumn("_one", (F.col("_y") == k).cast("double"))
            inside, outside = counts.get((k, False), 0), counts.get((k, True), 0)
            if not 0 < inside < n[False]:
                return None, 0.0, float((inside + outside) / max(1, n[False] + n[True]))
            booster = GBTClassifier(featuresCol=self.features, labelCol="_one", predictionCol="_g", **self.settings).setRawPredictionCol("_m").setProbabilityCol("_q").fit(one.where("not _aside"))
            slope, offset = 2.0, 0.0  # the logistic loss of the booster itself
            if 0 < outside < n[True]:
                # a few trees give few different margins: the curve is fitted on them and their numbers of rows
                margins = booster.transform(one.where("_aside")).groupBy("_one", vector_to_array("_m")[1].alias("_x")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
                curve = LogisticRegression(featuresCol="_v", labelCol="_one", weightCol="_n", maxIter=50).fit(margins.withColumn("_v", array_to_vector(F.array("_x"))))
                slope, offset = float(curve.coefficients[0]), float(curve.intercept)
            return booster, slope, offset

        members = _each(data, member, self.classes)
        data.unpersist()
        return BoostedModel(members, self.features)


@dataclass(frozen=True)
class BoostedModel:
    """(booster, slope, offset) for each class; without a booster the offset is the class's probability."""

    members: Sequence[tuple]
    features: str

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with p0, p1, ..."""
        out, names = rows, [f"_b{k}" for k in range(len(self.members))]
        for name, (booster, slope, offset) in zip(names, self.members, strict=True):
            if booster is None:
                out = out.withColumn(name, F.lit(offset))
            else:
                margin = vector_to_array("_m")[1]
                out = booster.transform(out).withColumn(name, 1 / (1 + F.exp(-(margin * slope + offset)))).drop("_m", "_q", "_g")
        total = reduce(lambda a, b: a + b, [F.col(c) for c in names])
        share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(1.0 / len(names))
        return out.withColumns({f"p{k}": share(c) for k, c in enumerate(names)}).drop(*names)


def learner(family: str, seed: int = 42, **settings):
    made = {
        "linear": lambda: LogisticRegression(family="multinomial", maxIter=15, regParam=0.01),
        "tree": lambda: DecisionTreeClassifier(maxDepth=4, seed=seed),
        "forest": lambda: RandomForestClassifier(numTrees=8, maxDepth=4, seed=seed),
        "boosted": lambda: BoostedOneVsRest(seed=seed),
    }
    if family not in made:
        raise ValueError(f"unknown family {family!r}")
    out = made[family]().setFeaturesCol("vector").setLabelCol("y")
    return out.setParams(**settings) if settings else out


def model_rows(listings: DataFrame) -> DataFrame:
    """The numeric features that the learners use, with key and target."""
    return listings.select(
        "listing_id", F.col("speed").alias("y"), X.equals("type", 1).cast("double").alias("is_dog"), F.col("age").cast("double").alias("age"), F.log1p("fee").alias("log_fee"), F.col("photos").cast("double").alias("photos"),
        F.col("quantity").cast("double").alias("quantity"), X.care("vaccinated").cast("double").alias("vaccinated"), X.care("dewormed").cast("double").alias("dewormed"), (F.col("age") * X.equals("type", 1)).cast("double").alias("age_x_type"),
    )


FEATURES = ["is_dog", "age", "log_fee", "photos", "quantity", "vaccinated", "dewormed", "age_x_type"]


def assembled(rows: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="vector", handleInvalid="keep").transform(rows)


@dataclass(frozen=True)
class Linear:
    """A multinomial model with given weights, by class and feature, and intercepts by class."""

    weights: Sequence[Sequence[float]]
    intercepts: Sequence[float]
    columns: Sequence[str] = tuple(FEATURES)

    def powers(self) -> list[Column]:
        """The exponentials of the margins by class."""
        margin = lambda w, b: reduce(lambda x, y: x + y, [F.lit(float(v)) * F.col(c) for v, c in zip(w, self.columns, strict=True)], F.lit(float(b)))
        return [F.exp(margin(w, b)) for w, b in zip(self.weights, self.intercepts, strict=True)]

    def expected_value(self) -> Column:
        """The mean class, in one expression that stays small where filters on it are moved about."""
        e = self.powers()
        return reduce(lambda x, y: x + y, [k * x for k, x in enumerate(e) if k]) / reduce(lambda x, y: x + y, e)

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with p0, p1, ...: the softmax of the margins."""
        e = rows.withColumns({f"_e{k}": x for k, x in enumerate(self.powers())})
        names = [f"_e{k}" for k in range(len(self.weights))]
        total = reduce(lambda x, y: x + y, [F.col(c) for c in names])
        return e.withColumns({f"p{k}": F.col(c) / total for k, c in enumerate(names)}).drop(*names)


def probabilities(model, rows: DataFrame) -> DataFrame:
    if isinstance(model, Linear | BoostedModel):
        return model.transform(rows)
    out = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    return out.withColumns({p: F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)) for i, p in enumerate(P)}).drop("_p", "rawPrediction", "probability", "prediction")


#: Models fitted, and learners validated, at the same time over up to so many rows and over more: each fit
#: holds its own rows in the executors.
FITS, LEARNERS, FEW_ROWS = (5, 2), (3, 1), 2_000_000
#: A partition that a fit reads has at least about so many rows: a fit is many small stages.
PART_ROWS = 50_000


def _each(data: DataFrame, make: Callable[[int], object], n: int, most: tuple[int, int] = FITS) -> list:
    """make(0), make(1), ..., several at a time, so that the small stages of one leave no core idle. data: a kept table."""
    together = most[data.count() > FEW_ROWS]
    with ThreadPool(max(1, min(n, together))) as pool:
        return pool.map(inheritable_thread_target(data.sparkSession)(make), range(n), 1)


def _fit_rows(kept: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """A kept table with its vectors, in no more partitions than its rows fill."""
    return assembled(kept, columns).coalesce(max(1, -(-kept.count() // PART_ROWS)))


def with_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """rows with their fold, which they may carry already."""
    return rows if "fold" in rows.columns else rows.join(folds.select("listing_id", "fold"), "listing_id")


def _kappas(models: Sequence, data: DataFrame, parts: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """For each model and its parts of the data ("train" and others): (model, part, y, predicted, argmax, n), the
    counts of its scored rows at the cuts that are best on its part "train", and (model, cuts).

    One pass scores the rows by all models and counts them by cell of the grid of cuts; cuts and classes
    come from these counts, whose number depends on the grid alone."""
    rows = data
    for i, (model, part) in enumerate(zip(models, parts, strict=True)):
        own = probabilities(model, rows).withColumn(f"_s{i}", F.struct(F.lit(i).alias("model"), part.alias("part"), E.expected_value(P).alias("ev"), E.argmax(P).alias("argmax")))
        rows = own.drop(*P)
    long = rows.select("y", F.explode(F.array(*[f"_s{i}" for i in range(len(models))])).alias("s")).select("y", "s.*").where("part is not null")
    counts = long.groupBy("model", "part", "y", "argmax", E.ev_bin("ev").alias("b"), E.cuts_reached("ev").alias("reached")).agg(F.count(F.lit(1)).alias("n"))
    counts = data.sparkSession.createDataFrame(counts.toArrow(), counts.schema)  # for each model at most 2 parts, 5 x 5 classes and 201 cells
    t, n = F.col("y").cast("long"), F.col("n")
    bins = counts.where("part = 'train'").groupBy("model", "b").agg(F.sum(n).alias("n"), F.sum(t * n).alias("y"), F.sum(t * t * n).alias("yy"))
    found = E.search_cuts(bins, ["model"]).select("model", "cuts", "places").collect()  # one row for each model
    cuts = data.sparkSession.createDataFrame([tuple(r) for r in found], "model int, cuts array<double>, places array<int>")
    predicted = F.size(F.filter("places", lambda c: c <= F.col("reached")))
    return counts.join(F.broadcast(cuts), "model").select("model", "part", "y", predicted.alias("predicted"), "argmax", "n"), cuts.select("model", "cuts")


def _part(fold: int, train: Column | None = None) -> Column:
    return F.when(F.col("fold") == fold, "valid").when(F.col("fold") != fold if train is None else train, "train")


def cross_validate(rows: DataFrame, folds: DataFrame, family: str, columns: Sequence[str] = FEATURES, k: int = 5, keep: bool = True, **settings) -> tuple[DataFrame | None, DataFrame]:
    """Out-of-fold probabilities, and kappa of training and validation rows by fold, at cuts found on
    the training rows of that fold.

    The former are written to a folder of the session's shared one, so that no model is fitted twice;
    without keep they are not made. Rows that carry their fold already are read as they are, so a caller
    that validates several learners keeps one table for all; others are kept while this runs."""
    spark, own = rows.sparkSession, "fold" not in rows.columns
    base = with_folds(rows, folds)
    if own:
        base = base.persist()
    data, root = _fit_rows(base, columns), work_dir(spark)
    models = _each(base, lambda f: learner(family, **settings).fit(data.where(F.col("fold") != f)), k)
    scores = _kappas(models, data, [_part(f) for f in range(k)])[0]
    metrics = [(r["model"], r["part"], r["n"], r["kappa"]) for r in E.quadratic_kappa(scores, "y", "predicted", ["model", "part"], "n").collect()]  # two rows for each fold
    valid = [probabilities(model, data.where(F.col("fold") == f)).select("listing_id", "fold", "y", *P) for f, model in enumerate(models)] if keep else []
    _each(base, lambda f: valid[f].write.parquet(f"{root}/{f}"), len(valid))
    if own:
        base.unpersist()
    oof = spark.read.schema(valid[0].schema).parquet(*[f"{root}/{f}" for f in range(k)]) if keep else None
    return oof, spark.createDataFrame(metrics, "fold int, part string, n long, kappa double")


def fold_metrics(rows: DataFrame, folds: DataFrame, family: str, columns: Sequence[str] = FEATURES, k: int = 5, **settings) -> DataFrame:
    """For each fold: cuts found on its training rows, and what they score on its validation rows."""
    spark, base = rows.sparkSession, with_folds(rows, folds).persist()
    data = _fit_rows(base, columns)
    models = _each(base, lambda f: learner(family, **settings).fit(data.where(F.col("fold") != f)), k)
    scores, cuts = _kappas(models, data, [_part(f) for f in range(k)])
    at = {r["model"]: r["cuts"] for r in cuts.collect()}  # one row for each fold
    base.unpersist()
    out = []
    for f in range(k):
        valid = scores.where((F.col("model") == f) & (F.col("part") == "valid"))
        both = E.quadratic_kappa(valid, "y", "predicted", weight="n").crossJoin(E.quadratic_kappa(valid, "y", "argmax", weight="n").select(F.col("kappa").alias("kappa_argmax"))).crossJoin(E.summary(E.confusion(valid, "y", "predicted", weight="n")))  # one row each
        out.append(both.select(F.lit(f).alias("fold"), "n", F.array(*[F.lit(float(c)) for c in at[f]]).alias("cuts"), "kappa", "kappa_argmax", "accuracy", "macro_f1", "weighted_f1").collect()[0])
    return spark.createDataFrame(out, "fold int, n long, cuts array<double>, kappa double, kappa_argmax double, accuracy double, macro_f1 double, weighted_f1 double")


def fold_summary(metrics: DataFrame, names: Sequence[str] = ("kappa", "kappa_argmax", "accuracy", "macro_f1", "weighted_f1")) -> DataFrame:
    """Mean and standard deviation of each metric over the folds."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])
    return metrics.select(F.explode(cells).alias("c")).groupBy("c.metric").agg(F.round(F.avg("c.value"), 6).alias("mean"), F.round(F.stddev("c.value"), 6).alias("std"))


def gaps(metrics: DataFrame) -> DataFrame:
    by = metrics.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("kappa"))).alias("train"), F.max(F.when(F.col("part") == "valid", F.col("kappa"))).alias("valid"))
    return by.select("fold", "train", "valid", F.round(F.col("train") - F.col("valid"), 6).alias("gap"), E.gap_status(F.col("train"), F.col("valid")).alias("status"))


def ablation(rows: DataFrame, folds: DataFrame, subsets: Mapping[str, Sequence[str]], family: str, k: int = 5) -> DataFrame:
    data, names = with_folds(rows, folds).persist(), list(subsets)  # one table for all subsets

    def subset(i: int) -> DataFrame:
        score = cross_validate(data, data, family, subsets[names[i]], k, keep=False)[1].where("part = 'valid'").agg(F.round(F.avg("kappa"), 6).alias("kappa"))
        return score.select(F.lit(names[i]).alias("subset"), "kappa")

    out = _each(data, subset, len(names), LEARNERS)
    data.unpersist()
    return reduce(DataFrame.unionByName, out)


def stack(oofs: Sequence[DataFrame], truth: DataFrame):
    """A meta learner on the out-of-fold probabilities of several models."""
    wide = reduce(lambda a, b: a.join(b, "listing_id"), [o.select("listing_id", *[F.col(p).alias(f"m{i}_{p}") for p in P]) for i, o in enumerate(oofs)]).join(truth, "listing_id")
    columns = [c for c in wide.columns if c.startswith("m")]
    rows = assembled(wide, columns)
    return probabilities(learner("linear").fit(rows), rows).select("listing_id", "y", *P)


#: What search() draws from: for each family the values of each setting.
SPACES = {
    "linear": {"regParam": [0.0, 0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
    "tree": {"maxDepth": [2, 3, 4, 5, 6], "minInstancesPerNode": [1, 5, 20]},
    "forest": {"numTrees": [4, 8, 16], "maxDepth": [2, 4, 6], "subsamplingRate": [0.6, 0.8, 1.0]},
    "boosted": {"maxIter": [2, 4, 8], "maxDepth": [2, 3, 4], "stepSize": [0.1, 0.3]},
}


def search(rows: DataFrame, folds: DataFrame, trials: int, seed: int = 42, k: int = 5, families: Sequence[str] = ("tree",)) -> DataFrame:
    """Seeded random settings of each family, scored by cross-validation, best first: `trials` different
    ones for each, or all that its space has."""
    import itertools
    import json
    import random

    data, drawn = with_folds(rows, folds).persist(), []  # one table for all trials
    for family in families:
        grid = list(itertools.product(*SPACES[family].values()))
        drawn += [(family, dict(zip(SPACES[family], values, strict=True))) for values in random.Random(f"{seed} {family}").sample(grid, min(trials, len(grid)))]

    def trial(i: int) -> DataFrame:
        family, s = drawn[i]
        score = cross_validate(data, data, family, FEATURES, k, keep=False, **s)[1].where("part = 'valid'").agg(F.round(F.avg("kappa"), 6).alias("score"))
        return score.select(F.lit(i).alias("trial"), F.lit(family).alias("family"), F.lit(json.dumps(s)).alias("settings"), "score")

    out = _each(data, trial, len(drawn), LEARNERS)
    data.unpersist()
    return reduce(DataFrame.unionByName, out).orderBy(F.desc("score"), "trial")


def learning_curve(rows: DataFrame, folds: DataFrame, family: str, shares: Sequence[float] = (0.2, 0.6, 1.0), k: int = 5) -> DataFrame:
    """For each share of the training rows, taken by hash: mean and deviation over the folds of kappa on them and on the validation rows."""
    spark, base = rows.sparkSession, with_folds(rows, folds).withColumn("_h", F.pmod(F.xxhash64("listing_id"), F.lit(1000))).persist()
    data, out = _fit_rows(base), []
    for s in shares:
        train = [(F.col("fold") != f) & (F.col("_h") < 1000 * s) for f in range(k)]
        models = _each(base, lambda f, train=train: learner(family).fit(data.where(train[f])), k)
        scores = _kappas(models, data, [_part(f, train[f]) for f in range(k)])[0]
        out += [(float(s), r["model"], r["part"], r["n"], r["kappa"]) for r in E.quadratic_kappa(scores, "y", "predicted", ["model", "part"], "n").collect()]  # two rows for each fold
    base.unpersist()
    long = rows.sparkSession.createDataFrame(out, "share double, fold int, part string, n long, kappa double")
    of = lambda part, c: F.when(F.col("part") == part, F.col(c))
    cells = [f(of(part, c)).alias(f"{name}_{part}") for part in ("train", "valid") for name, f, c in (("n", F.sum, "n"), ("mean", F.avg, "kappa"), ("std", F.stddev, "kappa"))]
    return long.groupBy("share").agg(F.count_if(F.col("part") == "valid").alias("n_folds"), *cells)


def degradation(model, rows: DataFrame, lost: Sequence[str]) -> DataFrame:
    """How often the class changes, and how far, if some features are zero."""
    before = E.scored(probabilities(model, assembled(rows)), P, CUTS).select("listing_id", F.col("predicted").alias("a"))
    after = E.scored(probabilities(model, assembled(X.degrade(rows, dict.fromkeys(lost, "lost"), ["lost"]))), P, CUTS).select("listing_id", F.col("predicted").alias("b"))
    return before.join(after, "listing_id").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.col("a") != F.col("b")) / F.count(F.lit(1)), 4).alias("changed_pct"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mean_shift"))


def linear_attributions(model, rows: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Exact contributions coefficient * (x - mean) of a multinomial model, as a long table."""
    import numpy as np

    w = np.array(model.weights if isinstance(model, Linear) else model.coefficientMatrix.toArray())
    means = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(k).alias("cls"), F.lit(c).alias("feature"), F.col(c).alias("value"), (F.lit(float(w[k, j])) * (F.col(c) - F.col(f"_m_{c}"))).alias("contribution")) for k in range(w.shape[0]) for j, c in enumerate(columns)])
    return rows.crossJoin(F.broadcast(means)).select(F.col("listing_id").alias("row_id"), F.explode(cells).alias("x")).select("row_id", "x.*")


def counterfactuals(model, listings: DataFrame, grid: Mapping[str, Sequence[float]] = GRID, keep: str = "ev") -> DataFrame:
    """Single changes of each listing; kept if the expected value (or the class) becomes smaller."""
    base = E.scored(probabilities(model, assembled(model_rows(listings))), P, CUTS).select("listing_id", F.col("expected_value").alias("ev0"), F.col("predicted").alias("class0"))
    changed = X.scenarios(listings, grid, "listing_id")
    moved = changed.withColumns({f: F.when(F.col("feature") == f, F.col("candidate")).otherwise(F.col(f).cast("double")) for f in grid})
    moved = moved.withColumn("change_key", F.struct("listing_id", "feature", "candidate"))
    rows = model_rows(moved.withColumn("listing_id", F.col("change_key")))
    after = E.scored(probabilities(model, assembled(rows)), P, CUTS).select("listing_id.*", F.col("expected_value").alias("ev1"), F.col("predicted").alias("class1"))
    out = after.join(base, "listing_id").withColumns({"ev_gain": F.col("ev0") - F.col("ev1"), "class_gain": F.col("class0") - F.col("class1")})
    return out.where((F.col("ev_gain") > 0) | (F.col("class_gain") > 0)) if keep == "ev" else out.where("class_gain > 0")


def save_bundle(model, path: str, facts: Mapping) -> None:
    """The model, and beside it one row of its facts."""
    import json

    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(facts.items())], "name string, value string").write.mode("overwrite").json(f"{path}/facts")


def load_bundle(spark, path: str):
    import json

    from pyspark.ml.classification import LogisticRegressionModel

    facts = {r["name"]: json.loads(r["value"]) for r in spark.read.schema("name string, value string").json(f"{path}/facts").collect()}
    return LogisticRegressionModel.load(f"{path}/model"), facts
