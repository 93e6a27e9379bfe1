"""Queries that train models or work on vectors and pixels: M04-M26, E01, E13-E14, S20, A23-A27."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import images as I
from ..operators import evaluation as E
from ..operators import models as M
from ..sources.files import work_dir
from .base import query

rows = lambda t: M.model_rows(t.listings_v)
folds = lambda t: E.stratified_folds(t.listings_v, "listing_id", "speed", 5)
fitted = lambda t: M.learner("linear").fit(M.assembled(rows(t)))


@query("M04_fit_classifier")
def _(t):
    model = M.learner("forest").fit(M.assembled(rows(t)))
    return E.scored(M.probabilities(model, M.assembled(rows(t))), M.P, M.CUTS).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))


@query("M04_fit_boosted")
def _(t):
    model = M.learner("boosted", maxIter=3).fit(M.assembled(rows(t)))
    return E.scored(M.probabilities(model, M.assembled(rows(t))), M.P, M.CUTS).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))


query("M05_cross_validate_boosted")(lambda t: M.gaps(M.cross_validate(rows(t), E.stratified_folds(t.listings_v, "listing_id", "speed", 3), "boosted", k=3, keep=False, maxIter=2, maxDepth=2)[1]))
query("M05_fold_metrics")(lambda t: M.fold_summary(M.fold_metrics(rows(t), folds(t), "tree")))
query("M05_cross_validate")(lambda t: M.gaps(M.cross_validate(rows(t), folds(t), "tree")[1]))
query("M16_modality_ablation")(lambda t: M.ablation(rows(t), folds(t), {"all": M.FEATURES, "no_age": [c for c in M.FEATURES if "age" not in c], "care": ["vaccinated", "dewormed"]}, "tree"))


@query("M18_stack_oof")
def _(t):
    data = M.with_folds(rows(t), folds(t)).persist()
    oofs = [M.cross_validate(data, data, family, k=5)[0] for family in ("tree", "linear")]
    data.unpersist()
    return E.quadratic_kappa(E.scored(M.stack(oofs, data.select("listing_id", "y")), M.P, M.CUTS), "y", "predicted")


query("M19_search_parameters")(lambda t: M.search(rows(t), folds(t), 1, families=("tree", "linear", "forest")))
query("M22_learning_curve")(lambda t: M.learning_curve(rows(t), folds(t), "tree"))
query("M26_degradation_test")(lambda t: M.degradation(fitted(t), rows(t), ["age", "age_x_type"]))
query("E01_compute_attributions")(lambda t: M.linear_attributions(fitted(t), rows(t)).select("row_id", "cls", "feature", F.round("value", 6).alias("value"), F.round("contribution", 8).alias("contribution")))
query("E13_counterfactual_ev")(lambda t: M.counterfactuals(fitted(t), t.listings_v).select("listing_id", "feature", "candidate", F.round("ev_gain", 6).alias("ev_gain"), "class_gain"))
query("E14_counterfactual_grid")(lambda t: M.counterfactuals(fitted(t), t.listings_v, keep="class").select("listing_id", "feature", "candidate", F.round("ev_gain", 6).alias("ev_gain"), "class_gain"))


# ---- a model with given weights: what follows from it can be checked by SQL -----------------------
WEIGHTS = [[((3 * k + 5 * j) % 11 - 5) / 40 * (0.02 if c in ("age", "age_x_type") else 0.5) for j, c in enumerate(M.FEATURES)] for k in range(5)]
INTERCEPTS = [0.1, 0.3, 0.2, -0.1, 0.0]
given = M.Linear(WEIGHTS, INTERCEPTS)
_CARE = "CAST(CASE {0} WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN -1 END AS DOUBLE)"
_X = {"is_dog": "CAST(type = 1 AS DOUBLE)", "age": "CAST(age AS DOUBLE)", "log_fee": "ln(1 + fee)", "photos": "CAST(photos AS DOUBLE)", "quantity": "CAST(quantity AS DOUBLE)", "vaccinated": _CARE.format("vaccinated"), "dewormed": _CARE.format("dewormed"), "age_x_type": "CAST(age * CAST(type = 1 AS INT) AS DOUBLE)"}


def _scored_sql(source: str, lost=()) -> str:
    """The source's rows with ev and predicted under the given weights."""
    z = ", ".join(f"exp({b} + " + " + ".join(f"({w}) * x_{c}" for w, c in zip(ws, M.FEATURES, strict=True)) + f") AS e{k}" for k, (ws, b) in enumerate(zip(WEIGHTS, INTERCEPTS, strict=True)))
    x = ", ".join(f"{'CAST(0 AS DOUBLE)' if c in lost else e} AS x_{c}" for c, e in _X.items())
    cuts = " + ".join(f"CAST(ev >= {c} AS INT)" for c in M.CUTS)
    return f"(SELECT *, {cuts} AS predicted FROM (SELECT *, (e1 + 2 * e2 + 3 * e3 + 4 * e4) / (e0 + e1 + e2 + e3 + e4) AS ev FROM (SELECT *, {z} FROM (SELECT *, {x} FROM {source} src) fx) fz) fe)"


_CELLS = ", ".join(f"({k}, '{c}', {w})" for k, ws in enumerate(WEIGHTS) for c, w in zip(M.FEATURES, ws, strict=True))
_VALUE = "CASE feature " + " ".join(f"WHEN '{c}' THEN {e}" for c, e in _X.items()) + " END"
query("E01_attributions_given", f"WITH v AS (SELECT listing_id AS row_id, cls, feature, w, {_VALUE} AS value FROM listings_v CROSS JOIN (VALUES {_CELLS}) c(cls, feature, w)) SELECT row_id, CAST(cls AS INT) AS cls, feature, round(value, 6) AS value, round(w * (value - avg(value) OVER (PARTITION BY feature)), 6) AS contribution FROM v")(
    lambda t: M.linear_attributions(given, rows(t)).select("row_id", "cls", "feature", F.round("value", 6).alias("value"), F.round("contribution", 6).alias("contribution"))
)
_WORST = f"""w AS (SELECT listing_id, speed AS y, predicted, abs(predicted - speed) AS gap, [e0, e1, e2, e3, e4][predicted + 1] / (e0 + e1 + e2 + e3 + e4) AS confidence FROM {_scored_sql('listings_v')} s WHERE predicted <> speed ORDER BY gap DESC, confidence DESC, listing_id DESC LIMIT 20)"""
query(
    "M29_worst_with_contributions",
    f"""WITH {_WORST}, v AS (SELECT listing_id AS row_id, cls, feature, w, {_VALUE} AS value FROM listings_v CROSS JOIN (VALUES {_CELLS}) c(cls, feature, w)), k AS (SELECT *, w * (value - avg(value) OVER (PARTITION BY cls, feature)) AS contribution FROM v),
 r AS (SELECT w.*, feature, value, contribution, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature) AS place FROM k JOIN w ON w.listing_id = k.row_id AND w.predicted = k.cls)
 SELECT listing_id, y, predicted, gap, round(confidence, 6) AS confidence, CAST(place AS INT) AS place, feature, round(value, 6) AS value, round(contribution, 6) AS contribution FROM r WHERE place <= 5""",
)(
    lambda t: E.worst_with_contributions(
        E.worst_errors(E.scored(M.probabilities(given, rows(t)), M.P, M.CUTS), "listing_id", "y", "predicted", "confidence", 20), "listing_id", "predicted", M.linear_attributions(given, rows(t))
    ).withColumns({c: F.round(c, 6) for c in ("confidence", "value", "contribution")})
)
query("M26_degradation_given", f"SELECT count(*) AS n, round(100.0 * count(*) FILTER (WHERE a.predicted <> b.predicted) / count(*), 4) AS changed_pct, round(avg(abs(a.predicted - b.predicted)), 6) AS mean_shift FROM {_scored_sql('listings_v')} a JOIN {_scored_sql('listings_v', ('age', 'age_x_type'))} b ON a.listing_id = b.listing_id")(
    lambda t: M.degradation(given, rows(t), ["age", "age_x_type"])
)
_GRID = ", ".join(f"('{f}', CAST({float(v)} AS DOUBLE))" for f, values in M.GRID.items() for v in values)
_MOVED = "SELECT listing_id, feature, candidate, type, age, " + ", ".join(f"CASE WHEN feature = '{f}' THEN candidate ELSE CAST({f} AS DOUBLE) END AS {f}" for f in M.GRID) + f" FROM listings_v CROSS JOIN (VALUES {_GRID}) g(feature, candidate) WHERE candidate <> CASE feature " + " ".join(f"WHEN '{f}' THEN CAST({f} AS DOUBLE)" for f in M.GRID) + " END"
_CF = f"SELECT m.listing_id, m.feature, m.candidate, o.ev - m.ev AS gain, o.predicted - m.predicted AS class_gain FROM {_scored_sql(f'({_MOVED})')} m JOIN {_scored_sql('listings_v')} o ON o.listing_id = m.listing_id"
for _name, _keep, _where in (("E13_counterfactual_ev_given", "ev", "gain > 1e-9 OR class_gain > 0"), ("E14_counterfactual_grid_given", "class", "class_gain > 0")):
    query(_name, f"SELECT listing_id, feature, candidate, round(gain, 6) AS ev_gain, CAST(class_gain AS INT) AS class_gain FROM ({_CF}) c WHERE {_where}")(
        lambda t, keep=_keep: M.counterfactuals(given, t.listings_v, keep=keep).where("ev_gain > 1e-9 or class_gain > 0").select("listing_id", "feature", "candidate", F.round("ev_gain", 6).alias("ev_gain"), "class_gain")
    )


@query("S20_model_bundle")
def _(t):
    path = work_dir(t.spark) + "/bundle"
    M.save_bundle(fitted(t), path, {"features": M.FEATURES, "cuts": list(M.CUTS)})
    model, facts = M.load_bundle(t.spark, path)
    return E.scored(M.probabilities(model, M.assembled(rows(t), facts["features"])), M.P, facts["cuts"]).select("listing_id", "predicted")


# ---- vectors and pixels from the embeddings table -------------------------------------------------
query("A23_pool_vectors", "SELECT label, round(avg(e) FILTER (WHERE i = 1), 6) AS first_mean, round(avg(e) FILTER (WHERE i = 64), 6) AS last_mean, count(*) FILTER (WHERE i = 1) AS n_vectors FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS e, unnest(range(1, 65)) AS i FROM embeddings) s GROUP BY label")(
    lambda t: I.pool_vectors(t.embeddings, "label", "embedding").select("label", F.round(F.get("pooled", F.lit(0)), 6).alias("first_mean"), F.round(F.get("pooled", F.lit(63)), 6).alias("last_mean"), "n_vectors")
)
query("A23_pool_vectors_max", "SELECT c.label, coalesce(max(e), 0) AS first_max, count(e) AS n_vectors, CAST(count(e) > 0 AS INT) AS has_vector FROM (SELECT CAST(unnest(range(12)) AS INT) AS label) c LEFT JOIN (SELECT label, CAST(embedding[1] AS DOUBLE) AS e FROM embeddings) v USING (label) GROUP BY c.label")(
    lambda t: I.pool_vectors(t.embeddings, "label", "embedding", t.embeddings.select(F.explode(F.sequence(F.lit(0), F.lit(11))).alias("label")), "max").select("label", F.coalesce(F.get("pooled", F.lit(0)), F.lit(0.0)).alias("first_max"), "n_vectors", "has_vector")
)


#: Vectors with the same id // SPAN and label are the rows of one picture.
SPAN = 320


@F.pandas_udf(T.BinaryType())
def _picture(vectors: pd.Series) -> pd.Series:
    """A grey PNG, stored without compression, whose rows are the vectors."""
    grey = lambda rows: np.clip(np.round((np.array([list(r["embedding"]) for r in rows], float) + 1) * 127.5), 0, 255)
    return vectors.map(lambda rows: I.png(len(rows), len(rows[0]["embedding"]), grey(rows), level=0))


def picture_files(t) -> str:
    """PNG files made of the embeddings, one for each label and stretch of ids, named label-number.png; of
    some only the head was written. Gives their folder."""
    block = F.expr(f"vec_id div {SPAN}")
    name = F.concat(F.col("label"), F.lit("-"), F.col("block"), F.lit(".png"))
    rows = t.embeddings.withColumn("block", block).groupBy("label", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("vectors"))  # at most SPAN vectors
    data = _picture("vectors")
    cut = F.when((F.col("label") + F.col("block")) % 7 == 3, F.expr("substring(data, 1, 30)")).otherwise(F.col("data"))
    path = work_dir(t.spark) + "/pictures"
    I.write_files(rows.select(name.alias("name"), data.alias("data"), "label", "block").select("name", cut.alias("data")), path)
    return path


_PIX = f"""px AS (SELECT label, b, y, unnest(range(64)) AS x, least(greatest(round_even((CAST(unnest(embedding) AS DOUBLE) + 1) * 127.5, 0), 0), 255) AS v FROM (SELECT label, vec_id // {SPAN} AS b, row_number() OVER (PARTITION BY label, vec_id // {SPAN} ORDER BY vec_id) AS y, embedding FROM embeddings) p),
 lp AS (SELECT *, coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v) + coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) - 4 * v AS lap FROM px WINDOW c AS (PARTITION BY label, b, x ORDER BY y), r AS (PARTITION BY label, b, y ORDER BY x)),
 im AS (SELECT label, b, CAST(max(y) AS INT) AS height, avg(v) AS brightness, (count(*) * sum(lap * lap) - sum(lap) * sum(lap)) / (count(*) * count(*)) AS blur FROM lp GROUP BY label, b),
 ok AS (SELECT label || '-' || b || '.png' AS file, label, 64 AS width, height, round(64.0 / height, 4) AS aspect_ratio, round((69 + 65 * height) / 1024.0, 2) AS kb, round(brightness, 2) AS brightness, round(blur, 2) AS blur FROM im WHERE (label + b) % 7 <> 3)"""
query("A25_image_stats", f"WITH {_PIX} SELECT file, width, height, aspect_ratio, kb, brightness, blur FROM ok")(lambda t: I.file_stats(t.spark, picture_files(t)))
query("A24_image_quality_by_key", f"WITH {_PIX} SELECT CAST(label AS VARCHAR) AS key, count(*) AS n, round(avg(brightness), 4) AS mean_brightness, round(avg(blur), 4) AS mean_blur, round(stddev_pop(64 * height), 4) AS area_std FROM ok GROUP BY label")(
    lambda t: I.quality_by_key(I.file_stats(t.spark, picture_files(t)))
)
query("S06_scan_image_files", f"SELECT CAST(label AS VARCHAR) AS key, count(*) AS n, list(name ORDER BY name) AS files FROM (SELECT DISTINCT label, label || '-' || vec_id // {SPAN} || '.png' AS name FROM embeddings) s GROUP BY label")(
    lambda t: I.files_by_key(t.spark, picture_files(t))
)


@query("A26_fit_apply_pca")
def _(t):
    out, variance = I.pca(t.embeddings, t.embeddings, "embedding", 8)
    return out.select("vec_id", F.round(F.abs(F.get("scores", F.lit(0))), 4).alias("first_score"), F.lit(round(sum(variance), 6)).alias("explained"))


_STEPS = 25


def _power_sql(c: str, out: str) -> str:
    """The vector after so many multiplications with the matrix in table c, and its share of the variance."""
    start = f"{out}_r AS MATERIALIZED (SELECT i, list(c ORDER BY j) AS r FROM {c} GROUP BY i), {out}_0 AS (SELECT list(0.125) AS v FROM range(64))"
    step = "{out}_{t} AS MATERIALIZED (SELECT list(y / n ORDER BY i) AS v FROM (SELECT i, y, sqrt(sum(y * y) OVER ()) AS n FROM (SELECT i, list_dot_product(r, v) AS y FROM {out}_r, {out}_{b}) a) b)"
    steps = ", ".join(step.format(out=out, t=t, b=t - 1) for t in range(1, _STEPS + 1))
    return f"{start}, {steps}, {out} AS MATERIALIZED (SELECT v, (SELECT sum(v[i + 1] * list_dot_product(r, v)) FROM {out}_r) AS l FROM {out}_{_STEPS})"


_PCA = f"""WITH u AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings), m AS MATERIALIZED (SELECT i, avg(e) AS m FROM u GROUP BY i),
 d AS MATERIALIZED (SELECT vec_id, u.i, e - m AS e FROM u JOIN m ON m.i = u.i), c AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.e * b.e) / (count(*) - 1) AS c FROM d a JOIN d b ON b.vec_id = a.vec_id GROUP BY a.i, b.i),
 {_power_sql('c', 'p')}, c2 AS MATERIALIZED (SELECT i, j, c - l * v[i + 1] * v[j + 1] AS c FROM c, p), {_power_sql('c2', 'q')}
 SELECT vec_id, round(list_dot_product(e, p.v), 6) AS first_score, round(list_dot_product(e, q.v), 6) AS second_score, round(list_dot_product(e, e) - list_dot_product(e, p.v) ** 2 - list_dot_product(e, q.v) ** 2, 6) AS residual,
 (SELECT round((p.l + q.l) / sum(c), 6) FROM c WHERE i = j) AS explained FROM (SELECT vec_id, list(e ORDER BY i) AS e FROM d GROUP BY vec_id) x, p, q"""


@query("A26_pca_by_covariance", _PCA)
def _(t):
    out = I.covariance_pca(t.embeddings, t.embeddings, "embedding", 2, _STEPS)
    return out.select("vec_id", F.round(F.get("scores", F.lit(0)), 6).alias("first_score"), F.round(F.get("scores", F.lit(1)), 6).alias("second_score"), F.round("residual", 6).alias("residual"), F.round("explained", 6).alias("explained"))


_SC = "WITH m AS (SELECT avg(age) AS ma, stddev_pop(age) AS sa, avg(fee) AS mf, stddev_pop(fee) AS sf FROM listings_v WHERE type = 1)"
query("A27_fit_apply_scaler", f"{_SC} SELECT listing_id, round((age - ma) / sa, 6) AS age, round((fee - mf) / sf, 6) AS fee FROM listings_v, m")(
    lambda t: I.scale(t.listings_v.where("type = 1"), t.listings_v.select("listing_id", F.col("age").cast("double").alias("age"), "fee"), ["age", "fee"]).select("listing_id", F.round("age", 6).alias("age"), F.round("fee", 6).alias("fee"))
)
query("A27_robust_scaler", "WITH m AS (SELECT median(age) AS ma, quantile_cont(age, 0.75) - quantile_cont(age, 0.25) AS sa FROM listings_v WHERE type = 1) SELECT listing_id, round((age - ma) / sa, 6) AS age FROM listings_v, m")(
    lambda t: I.scale(t.listings_v.where("type = 1"), t.listings_v.select("listing_id", F.col("age").cast("double").alias("age")), ["age"], "robust").select("listing_id", F.round("age", 6).alias("age"))
)
