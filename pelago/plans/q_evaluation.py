"""Queries M01-M29 on given probabilities, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from .base import query
from .q_clean import clean_listings

P = [f"p{i}" for i in range(5)]
CUTS = (1.8, 2.1, 2.4, 2.7)
_EV = "(p1 + 2*p2 + 3*p3 + 4*p4)"
_CUT = " + ".join(f"CAST(ev >= {c} AS INT)" for c in CUTS)
_ARG = "CASE " + " ".join(f"WHEN p{i} = greatest(p0,p1,p2,p3,p4) THEN {i}" for i in range(5)) + " END"
_S = f"""scored AS (SELECT *, greatest(p0,p1,p2,p3,p4) AS max_probability, [p0,p1,p2,p3,p4][predicted + 1] AS confidence, {_ARG} AS argmax FROM (SELECT *, {_CUT} AS predicted FROM (SELECT *, p0*0 + p1*1 + p2*2 + p3*3 + p4*4 AS ev FROM proba_v) a) b)"""
scored = lambda t: E.scored(t.proba_v, P, CUTS)

query("M01_stratified_folds", "SELECT speed, CAST(fold AS INT) AS fold, (c + 4 - fold) // 5 AS n FROM (SELECT speed, count(*) AS c FROM listings_v GROUP BY 1) s CROSS JOIN range(5) r(fold)")(
    lambda t: E.stratified_folds(t.listings_v, "listing_id", "speed", 5).groupBy("speed", "fold").agg(F.count(F.lit(1)).alias("n"))
)
query("M02_persist_folds")(lambda t: E.stratified_folds(t.listings_v, "listing_id", "speed", 5).select("listing_id", "fold"))
_MD5 = "CAST(concat('0x', substr(md5(CAST(listing_id AS VARCHAR)), 1, 15)) AS BIGINT)"
_BY_MD5 = f"SELECT listing_id, speed, CAST((row_number() OVER (PARTITION BY speed ORDER BY {_MD5} * 8, listing_id) - 1) % 5 AS INT) AS fold FROM listings_v"
by_md5 = lambda t: E.stratified_folds(t.listings_v, "listing_id", "speed", 5, order=F.conv(F.substring(F.md5(F.col("listing_id").cast("string")), 1, 15), 16, 10).cast("long") * 8)
query("M02_persist_folds_by_md5", f"SELECT listing_id, fold FROM ({_BY_MD5}) s")(lambda t: by_md5(t).select("listing_id", "fold"))
query("M03_fold_balance_by_md5", f"WITH f AS (SELECT fold, speed, count(*) AS n FROM ({_BY_MD5}) s GROUP BY 1, 2), s AS (SELECT *, abs(n * 1.0 / sum(n) OVER (PARTITION BY fold) - sum(n) OVER (PARTITION BY speed) * 1.0 / sum(n) OVER ()) AS d FROM f) SELECT fold, CAST(sum(n) AS BIGINT) AS n, round(max(d), 4) AS max_difference, max(d) <= 0.02 AS balanced FROM s GROUP BY fold")(
    lambda t: E.fold_balance(by_md5(t), "speed")
)
query("M03_fold_balance")(lambda t: E.fold_balance(E.stratified_folds(t.listings_v, "listing_id", "speed", 5), "speed"))
query("M03_fold_balance_by_id", """WITH f AS (SELECT CAST(listing_id % 5 AS INT) AS fold, speed, count(*) AS n FROM listings_v GROUP BY 1, 2), s AS (SELECT *, abs(n * 1.0 / sum(n) OVER (PARTITION BY fold) - sum(n) OVER (PARTITION BY speed) * 1.0 / sum(n) OVER ()) AS d FROM f) SELECT fold, CAST(sum(n) AS BIGINT) AS n, round(max(d), 4) AS max_difference, max(d) <= 0.02 AS balanced FROM s GROUP BY fold""")(
    lambda t: E.fold_balance(t.listings_v.select("speed", (F.col("listing_id") % 5).cast("int").alias("fold")), "speed")
)
query("M06_dummy_baseline", "WITH m AS (SELECT speed FROM listings_v GROUP BY speed ORDER BY count(*) DESC, speed LIMIT 1) SELECT m.speed AS constant_class, round(avg(CAST(l.speed = m.speed AS INT)), 6) AS accuracy FROM listings_v l, m GROUP BY m.speed")(
    lambda t: (lambda m: t.listings_v.crossJoin(F.broadcast(m)).groupBy("constant_class").agg(F.round(F.avg((F.col("speed") == F.col("constant_class")).cast("int")), 6).alias("accuracy")))(
        t.listings_v.groupBy("speed").count().orderBy(F.desc("count"), "speed").limit(1).select(F.col("speed").alias("constant_class"))
    )
)
_U = "CAST(concat('0x', substr(md5(CAST(listing_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0"
_DRAW = f"s AS (SELECT speed, sum(count(*)) OVER (ORDER BY speed) - count(*) AS lo, sum(count(*)) OVER (ORDER BY speed) AS hi, sum(count(*)) OVER () AS n FROM listings_v WHERE type = 1 GROUP BY speed), d AS (SELECT v.listing_id, v.speed AS y, s.speed AS drawn FROM listings_v v JOIN s ON {_U} * s.n >= s.lo AND {_U} * s.n < s.hi)"
drawn = lambda t: E.class_share_draw(t.listings_v.where("type = 1"), "speed", t.listings_v, "listing_id")  # noqa: E731  shares of one pet type, drawn for every listing
query("M06_class_share_draw", f"WITH {_DRAW} SELECT listing_id, drawn FROM d")(drawn)
query("M06_class_share_baseline", f"WITH {_DRAW} SELECT round(avg(CAST(y = drawn AS INT)), 6) AS accuracy, round(1 - sum((y - drawn) * (y - drawn)) / (sum(y * y) + sum(drawn * drawn) - 2.0 * sum(y) * sum(drawn) / count(*)), 6) AS kappa FROM d")(
    lambda t: (lambda d: d.agg(F.round(F.avg((F.col("speed") == F.col("drawn")).cast("int")), 6).alias("accuracy")).crossJoin(E.quadratic_kappa(d, "speed", "drawn").select("kappa")))(drawn(t).join(t.listings_v.select("listing_id", "speed"), "listing_id"))  # one row each
)
_CONF = f"WITH {_S}, cls AS (SELECT CAST(unnest(range(5)) AS INT) AS c), m AS (SELECT a.c AS y, b.c AS yhat, count(s.y) AS n FROM cls a CROSS JOIN cls b LEFT JOIN scored s ON s.y = a.c AND s.predicted = b.c GROUP BY 1, 2)"
matrix = lambda t: E.confusion(scored(t), "y", "predicted")
query("M07_confusion_matrix", f"{_CONF} SELECT * FROM m")(matrix)
_PC = """pc AS (SELECT c AS cls, s AS support, CASE WHEN g > 0 THEN h * 1.0 / g ELSE 0 END AS pr, CASE WHEN s > 0 THEN h * 1.0 / s ELSE 0 END AS re FROM (SELECT c, CAST(sum(n) FILTER (WHERE y = c) AS BIGINT) AS s, sum(n) FILTER (WHERE yhat = c) AS g, sum(n) FILTER (WHERE y = c AND yhat = c) AS h FROM cls, m GROUP BY c) x), pf AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM pc)"""
query("M08_per_class_metrics", f"{_CONF}, {_PC} SELECT cls, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1 FROM pf")(lambda t: E.per_class(matrix(t)).select("cls", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]))
query("M09_summary_metrics", f"{_CONF}, {_PC} SELECT round((SELECT sum(n) FILTER (WHERE y = yhat) * 1.0 / sum(n) FROM m), 6) AS accuracy, round(avg(f), 6) AS macro_f1, round(sum(f * support) / sum(support), 6) AS weighted_f1 FROM pf")(lambda t: E.summary(matrix(t)))
_K = "count(*) AS n, round(1 - sum((y - yh) * (y - yh)) / (sum(y * y) + sum(yh * yh) - 2.0 * sum(y) * sum(yh) / count(*)), 6) AS kappa"
query("M10_quadratic_kappa", f"WITH {_S} SELECT {_K} FROM (SELECT y, predicted AS yh FROM scored) s")(lambda t: E.quadratic_kappa(scored(t), "y", "predicted"))
query("M11_expected_value", f"SELECT listing_id, round({_EV}, 6) AS expected_value FROM proba_v")(lambda t: t.proba_v.select("listing_id", F.round(E.expected_value(P), 6).alias("expected_value")))
query("M12_apply_thresholds", f"WITH {_S} SELECT listing_id, predicted FROM scored")(lambda t: scored(t).select("listing_id", "predicted"))


def _search_sql(place: str) -> str:
    """The best of all rising choices of four cuts, of which cut i may stand where place holds for {i}."""
    n, y, r = (" + ".join(f"{f}t{i}.{c}" for i, f in zip(range(1, 5), m, strict=True)) for c, m in (("n", [""] * 4), ("y", [""] * 4), ("n", ["", "3 * ", "5 * ", "7 * "])))
    tables = "st t1 JOIN st t2 ON t2.b >= t1.b JOIN st t3 ON t3.b >= t2.b JOIN st t4 ON t4.b >= t3.b CROSS JOIN wh"
    where = " AND ".join(place.format(i=i) for i in range(1, 5))
    kappa = f"CASE WHEN syy + ({r}) - 2.0 * sy * ({n}) / wh.n > 0 THEN 1 - (syy - 2 * ({y}) + ({r})) / (syy + ({r}) - 2.0 * sy * ({n}) / wh.n) ELSE 0 END"
    return f"SELECT t1.b AS c1, t2.b AS c2, t3.b AS c3, t4.b AS c4, {kappa} AS kappa FROM {tables}{{more}} WHERE {where} ORDER BY kappa DESC, c1, c2, c3, c4 LIMIT 1"


_STEPS = """h AS (SELECT CAST(least(greatest(floor(ev * 50.0), 0), 199) AS INT) AS b, count(*) AS n, sum(y) AS y, sum(y * y) AS yy FROM (SELECT y, p0*0 + p1*1 + p2*2 + p3*3 + p4*4 AS ev FROM proba_v) e GROUP BY 1),
 st AS MATERIALIZED (SELECT CAST(g.b AS INT) AS b, CAST(sum(coalesce(h.n, 0)) OVER w AS DOUBLE) AS n, CAST(sum(coalesce(h.y, 0)) OVER w AS DOUBLE) AS y, CAST(sum(coalesce(h.yy, 0)) OVER w AS DOUBLE) AS yy FROM range(201) g(b) LEFT JOIN h ON h.b = g.b WINDOW w AS (ORDER BY g.b DESC)),
 wh AS (SELECT n, y AS sy, yy AS syy FROM st WHERE b = 0)"""
_GRID = f"{_STEPS}, best AS MATERIALIZED ({_search_sql('t{i}.b % 5 = 0').format(more='')}), fine AS ({_search_sql('abs(t{i}.b - best.c{i}) <= 5').format(more=', best')})"


@query("M13_optimize_thresholds", f"WITH {_GRID}, d AS (SELECT y, CAST(ev >= 0.5 AS INT) + CAST(ev >= 1.5 AS INT) + CAST(ev >= 2.5 AS INT) + CAST(ev >= 3.5 AS INT) AS yh FROM (SELECT y, p0*0 + p1*1 + p2*2 + p3*3 + p4*4 AS ev FROM proba_v) e) SELECT [c1 * 4 / 200.0, c2 * 4 / 200.0, c3 * 4 / 200.0, c4 * 4 / 200.0] AS cuts, round(kappa, 6) AS kappa, (SELECT round(1 - sum((y - yh) * (y - yh)) / (sum(y * y) + sum(yh * yh) - 2.0 * sum(y) * sum(yh) / count(*)), 6) FROM d) AS kappa_default FROM fine")
def _(t):
    rows = t.proba_v.withColumn("ev", E.expected_value(P))
    start = rows.withColumn("yhat", E.by_thresholds(F.col("ev"), (0.5, 1.5, 2.5, 3.5)))
    base = E.quadratic_kappa(start, "y", "yhat").select(F.col("kappa").alias("kappa_default"))
    return E.threshold_search(rows, "y", "ev").crossJoin(base).select("cuts", F.round("kappa", 6).alias("kappa"), "kappa_default")  # one row each


query("M14_overfitting_gap", "SELECT state, round(avg(CASE WHEN listing_id % 2 = 0 THEN speed END) - avg(CASE WHEN listing_id % 2 = 1 THEN speed END), 6) AS gap, CASE WHEN avg(CASE WHEN listing_id % 2 = 0 THEN speed END) - avg(CASE WHEN listing_id % 2 = 1 THEN speed END) > 0.1 THEN 'CRITICAL' WHEN avg(CASE WHEN listing_id % 2 = 0 THEN speed END) - avg(CASE WHEN listing_id % 2 = 1 THEN speed END) > 0.05 THEN 'WARNING' ELSE 'OK' END AS status FROM listings_v GROUP BY state")(
    lambda t: t.listings_v.groupBy("state").agg(F.avg(F.when(F.col("listing_id") % 2 == 0, F.col("speed"))).alias("a"), F.avg(F.when(F.col("listing_id") % 2 == 1, F.col("speed"))).alias("b")).select("state", F.round(F.col("a") - F.col("b"), 6).alias("gap"), E.gap_status(F.col("a"), F.col("b")).alias("status"))
)
query("M15_paired_test", "SELECT state, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS difference, round(avg(a - b) / (stddev(a - b) / sqrt(count(*))), 4) AS t FROM (SELECT state, owner_id, avg(speed) AS a, avg(photos) AS b FROM listings_v GROUP BY 1, 2) s GROUP BY state")(
    lambda t: E.paired_t(t.listings_v.groupBy("state", "owner_id").agg(F.avg("speed").alias("a"), F.avg("photos").alias("b")), "state", "a", "b").select("state", "n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "difference")], F.round("t", 4).alias("t"))
)
_PAIRED = "SELECT state, owner_id, avg(speed) AS a, avg(photos) AS b FROM listings_v GROUP BY 1, 2"
paired = lambda t: t.listings_v.groupBy("state", "owner_id").agg(F.avg("speed").alias("a"), F.avg("photos").alias("b"))
query("M15_signed_ranks", f"WITH d AS (SELECT state, round(a - b, 12) AS d FROM ({_PAIRED}) s WHERE round(a - b, 12) <> 0), r AS (SELECT state, d, rank() OVER (PARTITION BY state ORDER BY abs(d)) + (count(*) OVER (PARTITION BY state, abs(d)) - 1) / 2.0 AS r FROM d) SELECT state, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r GROUP BY state")(
    lambda t: E.signed_ranks(paired(t), "state", "a", "b").select("state", "n", "w")
)
query("M15_paired_probabilities")(lambda t: E.paired_tests(paired(t), "state", "a", "b").select("state", "n", *[F.round(c, 6).alias(c) for c in ("t", "p_t", "w", "p_w")]))
query("M17_soft_vote", "SELECT listing_id, " + ", ".join(f"round(0.75 * p{i} + 0.25 * p{4 - i}, 6) AS p{i}" for i in range(5)) + " FROM proba_v")(
    lambda t: E.soft_vote([(t.proba_v, 3), (t.proba_v.select("listing_id", *[F.col(f"p{4 - i}").alias(f"p{i}") for i in range(5)]), 1)], "listing_id", P).select("listing_id", *[F.round(c, 6).alias(c) for c in P])
)
_TRIALS = "SELECT state * 10 + type AS trial, CASE type WHEN 1 THEN 'tree' ELSE 'linear' END AS family, round(avg(speed), 4) AS score, round(avg(photos) / 10, 4) AS gap FROM listings_v GROUP BY state, type"
trials = lambda t: t.spark.sql(_TRIALS.replace("listings_v", "{v}"), v=t.listings_v)
query("M20_rank_candidates", f"SELECT *, CAST(rank() OVER (ORDER BY score DESC) AS INT) AS rank, row_number() OVER (PARTITION BY family ORDER BY score DESC, trial) = 1 AS best_of_family FROM ({_TRIALS}) s")(lambda t: E.rank_candidates(trials(t), "family", "score"))
query("M21_select_model", f"SELECT * FROM ({_TRIALS}) s WHERE gap IS NULL OR gap < 0.15 ORDER BY score DESC, trial LIMIT 1")(lambda t: E.select_model(trials(t), "gap", "score", 0.15))
query("M23_predict_batch", f"WITH {_S} SELECT listing_id, predicted, argmax, round(ev, 6) AS expected_value, round(confidence, 6) AS confidence, round(max_probability, 6) AS max_probability FROM scored")(
    lambda t: scored(t).select("listing_id", "predicted", "argmax", *[F.round(c, 6).alias(c) for c in ("expected_value", "confidence", "max_probability")])
)
query("M24_prediction_diagnostics", f"WITH {_S} SELECT count(*) AS n, round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS median, round(min(confidence), 6) AS min, round(max(confidence), 6) AS max, round(stddev_pop(confidence), 6) AS std, count(*) FILTER (WHERE confidence < 0.3) AS n_low, round(100.0 * count(*) FILTER (WHERE confidence < 0.3) / count(*), 4) AS pct_low, array_to_string(list_filter([CASE WHEN count(*) FILTER (WHERE predicted = 0) = 0 THEN '0' END, CASE WHEN count(*) FILTER (WHERE predicted = 4) = 0 THEN '4' END], lambda x: x IS NOT NULL), ',') AS empty_classes, '' AS above_half FROM scored")(
    lambda t: E.diagnostics(scored(t))
)
query("M25_rule_disagreement", f"WITH {_S} SELECT predicted, argmax, count(*) AS n, round(100.0 * sum(count(*) * CAST(predicted <> argmax AS INT)) OVER () / sum(count(*)) OVER (), 4) AS disagreement_pct FROM scored GROUP BY 1, 2")(
    lambda t: (lambda c: c.crossJoin(F.broadcast(c.agg(F.round(100.0 * F.sum(F.when(F.col("predicted") != F.col("argmax"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("disagreement_pct")))))(scored(t).groupBy("predicted", "argmax").agg(F.count(F.lit(1)).alias("n")))
)
_CAL = "cal AS (SELECT cls, CAST(least(floor(p * 10), 9) AS INT) AS bin, round(avg(CAST(y = cls AS INT)), 4) AS observed, round(avg(p), 4) AS predicted, count(*) AS n FROM (SELECT y, unnest([p0,p1,p2,p3,p4]) AS p, CAST(unnest(range(5)) AS INT) AS cls FROM proba_v) s GROUP BY 1, 2)"
query("M27_calibration", f"WITH {_CAL} SELECT * FROM cal")(lambda t: E.calibration(t.proba_v, "y", P))
query("M27_calibration_error", f"WITH {_CAL} SELECT cls, round(sum(abs(observed - predicted) * n) / sum(n), 4) AS ece FROM cal GROUP BY cls")(lambda t: E.calibration_error(E.calibration(t.proba_v, "y", P)))
query("M28_error_profile", f"WITH {_S} SELECT count(*) AS n, round(count(*) FILTER (WHERE y <> predicted) * 1.0 / count(*), 6) AS error_rate, count(*) FILTER (WHERE predicted > y) AS n_over, count(*) FILTER (WHERE predicted < y) AS n_under, round(avg(abs(predicted - y)), 6) AS mean_abs_error, round(avg(confidence) FILTER (WHERE y <> predicted), 6) AS confidence_wrong, round(avg(confidence) FILTER (WHERE y = predicted), 6) AS confidence_right, round(median(confidence) FILTER (WHERE y <> predicted), 6) AS median_wrong FROM scored")(
    lambda t: E.error_profile(scored(t), "y", "predicted", "confidence")
)
query("M28_error_by_class", f"WITH {_S} SELECT y, count(*) AS n, count(*) FILTER (WHERE y <> predicted) AS n_wrong, round(count(*) FILTER (WHERE y <> predicted) * 1.0 / count(*), 6) AS error_rate FROM scored GROUP BY y")(lambda t: E.error_by_class(scored(t), "y", "predicted"))
query("M24_class_shares", f"WITH {_S}, a AS (SELECT predicted AS c, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM scored) AS p FROM scored GROUP BY 1), b AS (SELECT speed AS c, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM listings_v WHERE type = 1) AS p FROM listings_v WHERE type = 1 GROUP BY 1) SELECT CAST(r.c AS INT) AS cls, coalesce(a.n, 0) AS n_predicted, round(coalesce(a.p, 0), 4) AS pct_predicted, coalesce(b.n, 0) AS n_training, round(coalesce(b.p, 0), 4) AS pct_training FROM range(5) r(c) LEFT JOIN a ON a.c = r.c LEFT JOIN b ON b.c = r.c")(
    lambda t: E.class_shares(scored(t), "predicted", t.listings_v.where("type = 1"), "speed")
)
query("M28_error_pairs", f"WITH {_S} SELECT y, predicted, count(*) AS n FROM scored WHERE y <> predicted GROUP BY 1, 2")(lambda t: E.error_pairs(scored(t), "y", "predicted"))
query("M29_worst_errors", f"WITH {_S} SELECT listing_id, y, predicted, abs(predicted - y) AS gap, round(confidence, 6) AS confidence FROM scored WHERE y <> predicted ORDER BY gap DESC, scored.confidence DESC, listing_id DESC LIMIT 20")(
    lambda t: E.worst_errors(scored(t), "listing_id", "y", "predicted", "confidence", 20).withColumn("confidence", F.round("confidence", 6))
)
_LAB = "CASE predicted " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in E.LABELS.items()) + " END"
query("S13_prediction_detail", f"WITH {_S} SELECT listing_id, predicted AS predicted_class, {_LAB} AS predicted_label, round(max_probability, 6) AS confidence, round(ev, 6) AS expected_value, " + ", ".join(f"round(p{i}, 6) AS prob_class_{i}" for i in range(5)) + ", argmax AS argmax_class, 'threshold' AS prediction_method FROM scored")(
    lambda t: E.prediction_detail(t.proba_v, "listing_id", P, CUTS)
)
query("S12_sink_submission_checks", f"WITH {_S} SELECT count(*) AS n, count(*) FILTER (WHERE predicted NOT BETWEEN 0 AND 4) AS n_bad_class, count(*) - count(DISTINCT listing_id) AS n_duplicate_keys FROM scored")(
    lambda t: scored(t).groupBy("listing_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(~F.col("predicted").between(0, 4)).alias("b")).agg(F.sum("k").alias("n"), F.sum("b").alias("n_bad_class"), (F.sum("k") - F.count(F.lit(1))).alias("n_duplicate_keys"))
)


@query("flagship_kappa_by_segment", f"WITH {_S} SELECT CASE WHEN l.breed2 = 0 OR (l.breed1 = 0 AND l.breed2 <> 0) OR l.breed2 NOT IN (1,2,3) THEN 'Purebred' ELSE 'Mixed' END AS segment, {_K} FROM (SELECT s.listing_id, y, predicted AS yh, breed1, breed2 FROM scored s JOIN listings_v v ON s.listing_id = v.listing_id) l GROUP BY 1")
def flagship(t) -> DataFrame:
    """Cleaned listings, thresholded classes, kappa by segment."""
    rows = clean_listings(t).select("listing_id", F.when(F.col("breed2") == 0, "Purebred").otherwise("Mixed").alias("segment"))
    return E.quadratic_kappa(rows.join(scored(t), "listing_id"), "y", "predicted", ["segment"])

