"""Queries Q01-Q14 and A01-A22 on the listing, document and probability views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import stats as S
from .base import query

CONTRACT = Q.Contract(
    (
        Q.ColumnSpec("listing_id", "bigint"), Q.ColumnSpec("state", "int", foreign="nation"), Q.ColumnSpec("type", "int", valid=(1,)), Q.ColumnSpec("age", "int", least=12),
        Q.ColumnSpec("vaccinated", "bigint", valid=(1, 2)), Q.ColumnSpec("fee", "double", least=0), Q.ColumnSpec("name", "string", nullable=True), Q.ColumnSpec("video", "int"), Q.ColumnSpec("breed1", "string"),
    )
)
_HAVE = [c for c in CONTRACT.columns if c.name != "video"]
_cast = lambda t: t.listings_v.select("listing_id", "state", "type", "age", "vaccinated", "fee", "name", "breed1")
query("Q01_check_schema", "SELECT * FROM (VALUES ('listing_id','ok'),('state','ok'),('type','ok'),('age','ok'),('vaccinated','ok'),('fee','ok'),('name','ok'),('video','missing'),('breed1','type'),('owner_id','extra')) v(\"column\", status)")(
    lambda t: Q.check_schema(t.listings_v.select("listing_id", "state", "type", "age", "vaccinated", "fee", "name", "breed1", "owner_id"), CONTRACT)
)
query(
    "Q02_check_domain",
    """SELECT 'type' AS "column", count(*) FILTER (WHERE type <> 1) AS n_bad, '2' AS examples FROM listings_v UNION ALL
 SELECT 'age', count(*) FILTER (WHERE age < 12), string_agg(DISTINCT CAST(age AS VARCHAR), ',' ORDER BY CAST(age AS VARCHAR)) FILTER (WHERE age < 12) FROM listings_v UNION ALL
 SELECT 'vaccinated', count(*) FILTER (WHERE vaccinated NOT IN (1, 2)), '3' FROM listings_v UNION ALL SELECT 'fee', count(*) FILTER (WHERE fee < 0), '' FROM listings_v""",
)(lambda t: Q.check_domains(t.listings_v, Q.Contract(tuple(_HAVE))))
query(
    "Q03_check_nulls",
    "SELECT 'name' AS \"column\", count(*) FILTER (WHERE name IS NULL) AS n_null, round(count(*) FILTER (WHERE name IS NULL) * 1.0 / count(*), 4) AS fraction, 'expected' AS severity FROM listings_v UNION ALL SELECT 'fee', count(*) FILTER (WHERE fee IS NULL), 0.0, 'ok' FROM listings_v UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL), round(count(*) FILTER (WHERE quality IS NULL) * 1.0 / count(*), 4), 'critical' FROM docs_v",
)(
    lambda t: Q.check_nulls(t.listings_v, Q.Contract((Q.ColumnSpec("name", "string", nullable=True), Q.ColumnSpec("fee", "double")))).unionByName(Q.check_nulls(t.docs_v, Q.Contract((Q.ColumnSpec("quality", "int"),))))
)
query("Q04_check_duplicates", "SELECT count(*) AS total, count(DISTINCT name) AS n_distinct, (SELECT count(*) FROM (SELECT name FROM listings_v WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1)) AS n_repeated, count(*) - count(DISTINCT name) AS n_duplicates FROM listings_v")(lambda t: Q.check_duplicates(t.listings_v, "name"))
query("Q04_duplicate_keys", "SELECT owner_id, count(*) AS n FROM listings_v GROUP BY owner_id HAVING count(*) > 1 ORDER BY n DESC, owner_id LIMIT 50")(lambda t: Q.duplicate_keys(t.listings_v, "owner_id"))
query("Q05_check_cross_column", "SELECT 'breed2_needs_breed1' AS rule, count(*) FILTER (WHERE breed2 <> 0 AND NOT breed1 <> 0) AS n_bad, count(*) FILTER (WHERE breed2 <> 0 AND NOT breed1 <> 0) = 0 AS passed FROM listings_v UNION ALL SELECT 'fee_is_positive', count(*) FILTER (WHERE fee < 0), count(*) FILTER (WHERE fee < 0) = 0 FROM listings_v")(
    lambda t: Q.check_implications(t.listings_v, {"breed2_needs_breed1": (F.col("breed2") != 0, F.col("breed1") != 0), "fee_is_positive": (F.lit(True), F.col("fee") >= 0)})
)
query("Q06_check_count_matches_files", "SELECT count(*) AS n_keys, count(*) FILTER (WHERE photos = coalesce(n, 0)) AS n_equal, count(*) FILTER (WHERE photos <> coalesce(n, 0)) AS n_different FROM listings_v LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON listing_id = l_orderkey")(
    lambda t: Q.check_counts(t.listings_v.select("listing_id", "photos"), t.lineitem.select(F.col("l_orderkey").alias("listing_id")), "listing_id", "photos")
)
query("Q07_check_class_balance", "SELECT event_type, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share, count(*) * 1.0 / sum(count(*)) OVER () < 0.05 AS flagged FROM events GROUP BY event_type")(lambda t: Q.check_class_balance(t.events, "event_type"))
query(
    "Q08_column_profile",
    "SELECT 'name' AS \"column\", 'string' AS dtype, count(name) AS n_not_null, count(*) - count(name) AS n_null, round(100.0 * (count(*) - count(name)) / count(*), 4) AS null_pct, count(DISTINCT name) AS n_distinct FROM listings_v UNION ALL SELECT 'age', 'int', count(age), 0, 0.0, count(DISTINCT age) FROM listings_v",
)(lambda t: Q.column_profile(t.listings_v, ["name", "age"]))
query("Q09_audit_matrix", "SELECT CAST(count(*) AS BIGINT) AS n_rows, 2 AS n_features, CAST(count(*) FILTER (WHERE quality IS NULL) + count(*) FILTER (WHERE toxic IS NULL) AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, count(*) - count(DISTINCT doc_id) AS n_duplicate_keys FROM docs_v")(lambda t: Q.audit_matrix(t.docs_v.select("doc_id", "quality", "toxic"), "doc_id"))
query("Q10_check_finite", "SELECT 'x' AS \"column\", count(*) FILTER (WHERE age = 0) AS n_nan, count(*) FILTER (WHERE age = 1) AS n_inf, count(*) FILTER (WHERE age = 2) AS n_null FROM listings_v UNION ALL SELECT 'fee', 0, 0, 0")(
    lambda t: Q.non_finite(t.listings_v.withColumn("x", F.when(F.col("age") == 0, float("nan")).when(F.col("age") == 1, float("-inf")).when(F.col("age") != 2, 1.0)), ["x", "fee"])
)
query("Q11_check_model_inputs", "SELECT * FROM (VALUES ('target_absent', CAST(0 AS BIGINT), TRUE), ('keys_unique', 0, TRUE), ('values_finite', 0, TRUE), ('classes_complete', 1, FALSE)) v(\"check\", n_bad, passed)")(
    lambda t: Q.check_model_inputs(t.listings_v, "listing_id", ["age", "fee"], "speed", [0, 1, 2, 3, 4, 5])
)
query("Q12_check_probabilities", "SELECT count(*) AS n, count(*) FILTER (WHERE least(p0,p1,p2,p3,p4) < 0 OR greatest(p0,p1,p2,p3,p4) > 1) AS n_outside, count(*) FILTER (WHERE abs(p0+p1+p2+p3+p4-1) > 1e-6) AS n_bad_sum, TRUE AS passed FROM proba_v")(lambda t: Q.check_probabilities(t.proba_v, ["p0", "p1", "p2", "p3", "p4"]))
query("Q13_check_degenerate_vectors", "SELECT count(*) AS n, count(*) FILTER (WHERE list_max(embedding) = 0 AND list_min(embedding) = 0) AS n_zero, round(CAST(min(list_min(embedding)) AS DOUBLE), 6) AS lowest, round(CAST(max(list_max(embedding)) AS DOUBLE), 6) AS highest, round(sum(list_sum(CAST(embedding AS DOUBLE[]))) / sum(len(embedding)), 6) AS mean FROM embeddings")(lambda t: Q.check_vectors(t.embeddings, "embedding"))
query("Q14_check_text_contract", "SELECT * FROM (SELECT 'shares_sum_to_one' AS \"check\", count(*) FILTER (WHERE abs(p0 + p1 + p2 + p3 + p4 - 1) > 0.05) AS n_bad FROM proba_v UNION ALL SELECT 'absent_parts_below_one_percent', 0 UNION ALL SELECT 'confidence_of_predicted_class', count(*) FILTER (WHERE abs(greatest(p0,p1,p2,p3,p4) - p0) > 1e-6) FROM proba_v UNION ALL SELECT 'at_most_five_recommendations', count(*) FILTER (WHERE y + 2 > 5) FROM proba_v UNION ALL SELECT 'no_raw_names', count(*) FILTER (WHERE y = 1) FROM proba_v) s")(
    lambda t: Q.check_response(
        t.proba_v.withColumns({"on": F.lit(True), "conf": F.greatest("p0", "p1", "p2", "p3", "p4"), "recs": F.col("y") + 2, "text": F.when(F.col("y") == 1, "see img_emb_3").otherwise("fine")}), {f"p{i}": "on" for i in range(5)}, "conf", "p0", "recs", "text"
    )
)

# ---- A01-A22 ----------------------------------------------------------------------------------------
query("A01_fit_group_stats", "SELECT owner_id, count(*) AS n, round(avg(photos), 6) AS mean_photos, round(avg(fee), 6) AS mean_fee FROM listings_v GROUP BY owner_id")(
    lambda t: t.listings_v.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("photos"), 6).alias("mean_photos"), F.round(F.avg("fee"), 6).alias("mean_fee"))
)
query("A01_group_stat_defaults", "SELECT round(avg(n), 6) AS mean_n, round(avg(p), 6) AS mean_photos FROM (SELECT count(*) AS n, avg(photos) AS p FROM listings_v GROUP BY owner_id) s")(
    lambda t: t.listings_v.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), F.avg("photos").alias("p")).agg(F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.avg("p"), 6).alias("mean_photos"))
)
query("A02_fit_frequency_map", "SELECT name, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 8) AS share FROM listings_v WHERE name IS NOT NULL GROUP BY name")(lambda t: S.value_shares(t.listings_v, "name").withColumn("share", F.round("share", 8)))
query(
    "A03_class_distribution",
    """WITH c AS (SELECT speed, count(*) AS n FROM listings_v GROUP BY speed) SELECT speed, n, round(100.0 * n / (SELECT sum(n) FROM c), 2) AS pct, round((SELECT max(n) FROM c) * 1.0 / (SELECT min(n) FROM c), 4) AS imbalance_ratio,
 (SELECT speed FROM c ORDER BY n DESC, speed LIMIT 1) AS majority, (SELECT speed FROM c ORDER BY n, speed LIMIT 1) AS minority FROM c""",
)(lambda t: S.class_distribution(t.listings_v, "speed"))
_D = "SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurt FROM listings_v"
query("A04_descriptive_stats", " UNION ALL ".join(_D.format(c=c) for c in ("age", "fee", "photos")))(lambda t: S.describe(t.listings_v, ["age", "fee", "photos"]))
query("A05_grouped_stats", "SELECT speed, count(*) AS n, round(avg(age), 2) AS mean, round(median(age), 2) AS median, round(stddev(age), 2) AS std FROM listings_v GROUP BY speed")(lambda t: S.grouped_stats(t.listings_v, "speed", "age"))
query(
    "A06_iqr_outliers",
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high, count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS n_outside, round(100.0 * count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) / count(*), 4) AS pct_outside FROM orders, q GROUP BY q1, q3",
)(lambda t: S.iqr_outliers(t.orders, "o_totalprice").select(*[F.round(c, 4).alias(c) for c in ("q1", "q3", "iqr", "low", "high")], "n_outside", "pct_outside"))
query("A07_percentile_report", "SELECT count(fee) AS n, round(avg(fee), 4) AS mean, round(stddev(fee), 4) AS std, round(min(fee), 4) AS min, round(max(fee), 4) AS max, round(quantile_cont(fee, 0.25), 4) AS p25, round(quantile_cont(fee, 0.5), 4) AS p50, round(quantile_cont(fee, 0.9), 4) AS p90 FROM listings_v WHERE fee > 0")(
    lambda t: S.percentiles(t.listings_v.where("fee > 0"), "fee", [0.25, 0.5, 0.9])
)
_PCT = ", ".join(f"round(100.0 * count(*) FILTER (WHERE speed = {i}) / count(*), 4) AS pct_{i}" for i in range(5))
query("A08_row_normalized_crosstab", f"SELECT state, {_PCT} FROM listings_v GROUP BY state")(lambda t: S.crosstab_pct(t.listings_v, "state", "speed", range(5)))
query("A09_contingency_table", "SELECT breed1, " + ", ".join(f"count(*) FILTER (WHERE speed = {i}) AS n_{i}" for i in range(5)) + " FROM listings_v GROUP BY breed1")(lambda t: S.contingency(t.listings_v, "breed1", "speed", range(5)))
_PAIRS = [("age", "fee"), ("age", "photos"), ("age", "speed"), ("fee", "photos"), ("fee", "speed"), ("photos", "speed")]
query("A10_pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM listings_v" for a, b in _PAIRS))(lambda t: S.pearson(t.listings_v, ["age", "fee", "photos", "speed"]))
_RANK = "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("age", "fee", "photos")) + " FROM listings_v) "
query("A11_spearman_matrix", _RANK + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM r" for a, b in [("age", "fee"), ("age", "photos"), ("fee", "photos")]))(lambda t: S.spearman(t.listings_v, "listing_id", ["age", "fee", "photos"]))
_V = """SELECT '{a}' AS a, '{b}' AS b, round(sum(d * d / e), 4) AS chi2, round(CASE WHEN least(r, k) > 1 THEN sqrt(sum(d * d / e) / (max(t) * (least(r, k) - 1))) ELSE 0 END, 6) AS v FROM (
 SELECT *, CASE WHEN r = 2 AND k = 2 THEN abs(n - e) - least(0.5, abs(n - e)) ELSE abs(n - e) END AS d FROM (
 SELECT x.{a}, y.{b}, coalesce(n, 0) AS n, nx * ny * 1.0 / t AS e, t, r, k FROM (SELECT {a}, count(*) AS nx FROM listings_v GROUP BY 1) x CROSS JOIN (SELECT {b}, count(*) AS ny FROM listings_v GROUP BY 1) y
 LEFT JOIN (SELECT {a}, {b}, count(*) AS n FROM listings_v GROUP BY 1, 2) o ON o.{a} = x.{a} AND o.{b} = y.{b} CROSS JOIN (SELECT count(*) AS t, count(DISTINCT {a}) AS r, count(DISTINCT {b}) AS k FROM listings_v) m) s) u GROUP BY r, k"""
query("A12_cramers_v", " UNION ALL ".join(_V.format(a=a, b=b) for a, b in [("type", "speed"), ("breed1", "speed"), ("type", "is_free")]).replace("FROM listings_v", "FROM (SELECT *, CAST(fee = 0 AS INT) AS is_free FROM listings_v)"))(
    lambda t: S.cramers_v(t.listings_v.withColumn("is_free", (F.col("fee") == 0).cast("int")), [("type", "speed"), ("breed1", "speed"), ("type", "is_free")])
)
query(
    "A13_histogram_capped",
    "WITH k AS (SELECT o_totalprice AS x, o_orderstatus AS s FROM orders WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)), e AS (SELECT min(x) AS lo, max(x) AS hi FROM k) SELECT CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, s AS o_orderstatus, count(*) AS n FROM k, e GROUP BY 1, 2",
)(lambda t: S.histogram(t.orders, "o_totalprice", "o_orderstatus", 20))
query("A14_categorical_distribution", "SELECT n.n_name AS state_name, c.speed, count(l.listing_id) AS n FROM (SELECT DISTINCT state FROM listings_v) s JOIN nation n ON s.state = n.n_nationkey CROSS JOIN (SELECT unnest(range(5))::INT AS speed) c LEFT JOIN listings_v l ON l.state = s.state AND l.speed = c.speed GROUP BY 1, 2")(
    lambda t: S.category_by_class(t.listings_v, "state", "speed", range(5)).join(t.nation, F.col("state") == F.col("n_nationkey")).select(F.col("n_name").alias("state_name"), "speed", "n")
)
query("A15_class_patterns", "SELECT type, speed, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY type), 1) AS pct FROM listings_v GROUP BY type, speed")(
    lambda t: S._with_total(S.category_by_class(t.listings_v, "type", "speed", range(5)), ["type"]).select("type", "speed", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))
)
query("A16_pareto_coverage", "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), s AS (SELECT sum(n) OVER (ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) * 1.0 / sum(n) OVER () AS cum FROM c) SELECT count(*) AS n_categories, count(*) FILTER (WHERE cum <= 0.8) + 1 AS n_needed FROM s")(lambda t: S.pareto_count(t.part, "p_brand"))
query("A17_top_groups_per_segment", "SELECT * FROM (SELECT type, owner_id, count(*) AS n, round(avg(speed), 4) AS mean, CAST(row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, owner_id) AS INT) AS rank FROM listings_v GROUP BY type, owner_id) s WHERE rank <= 15")(lambda t: S.top_groups(t.listings_v, "type", "owner_id", "speed", 15))
query("A18_group_mean_and_volume", "SELECT state, count(*) AS n, round(avg(speed), 6) AS mean_speed FROM listings_v GROUP BY state ORDER BY mean_speed, state")(lambda t: t.listings_v.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("speed"), 6).alias("mean_speed")).orderBy("mean_speed", "state"))
query("A19_key_activity", "SELECT owner_id, count(*) AS n, round(avg(speed), 4) AS mean_target, round(median(age), 4) AS median_amount, round(avg(photos), 4) AS mean_count FROM listings_v GROUP BY owner_id ORDER BY n DESC, owner_id LIMIT 10")(
    lambda t: S.key_activity(t.listings_v, "owner_id", "speed", "age", "photos").orderBy(F.desc("n"), "owner_id").limit(10)
)
query("A19_key_activity_summary", "SELECT count(*) AS n_keys, round(avg(n), 6) AS mean_n, round(median(n), 4) AS median_n, max(n) AS max_n FROM (SELECT owner_id, count(*) AS n FROM listings_v GROUP BY 1) s")(
    lambda t: t.listings_v.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_keys"), F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.percentile("n", F.lit(0.5)), 4).alias("median_n"), F.max("n").alias("max_n"))
)
query("A20_frequency_of_frequency", "SELECT times, count(*) AS n_values FROM (SELECT name, count(*) AS times FROM listings_v WHERE name IS NOT NULL GROUP BY 1) s GROUP BY times")(lambda t: S.frequency_of_frequency(t.listings_v, "name"))
query("A21_pivot_mean", "SELECT state, " + ", ".join(f"round(avg(CASE WHEN type = {v} THEN speed END), 4) AS mean_{v}" for v in (1, 2)) + " FROM listings_v GROUP BY state")(lambda t: S.pivot_mean(t.listings_v, "state", "type", [1, 2], "speed"))
query("A22_presence_comparison", "SELECT name IS NOT NULL AS present, speed, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY name IS NOT NULL), 4) AS pct, round(sum(count(*) * speed) OVER (PARTITION BY name IS NOT NULL) * 1.0 / sum(count(*)) OVER (PARTITION BY name IS NOT NULL), 6) AS mean_target FROM listings_v GROUP BY 1, 2")(
    lambda t: S.presence_comparison(t.listings_v, F.col("name").isNotNull(), "speed")
)
