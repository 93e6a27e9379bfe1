"""Queries A28-A33, E02-E12 and E15-E17 on the long contribution view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators.evaluation import LABELS
from .base import query
from .q_evaluation import _LAB, _S, scored

features = lambda t: t.attrib_v.select("feature").distinct()
reg = lambda t: A.registry(features(t))
dim = lambda t: features(t).select("feature", A.classify(F.col("feature")).alias("modality"))
_REG = """reg AS (SELECT feature, CASE WHEN regexp_matches(feature, '^img_emb_[0-9]+$') THEN 'image_embedding' WHEN regexp_matches(feature, '^text_emb_[0-9]+$') THEN 'text_embedding' WHEN feature LIKE 'rescuer_%' THEN 'rescuer_statistics' WHEN feature LIKE 'log_%' THEN 'log_transforms' WHEN feature LIKE 'doc_sentiment_%' THEN 'sentiment_scores' ELSE 'ungrouped' END AS grp,
 CASE WHEN feature LIKE 'img_emb_%' THEN 'image' WHEN feature LIKE 'text_emb_%' THEN 'text' WHEN feature LIKE 'doc_sentiment_%' THEN 'metadata' WHEN feature <> 'Age' THEN 'tabular' END AS modality,
 CASE WHEN feature LIKE '%_emb_%' THEN 'latent' WHEN feature = 'Age' THEN 'direct' ELSE 'engineered' END AS interpretability, CASE WHEN feature LIKE 'img_emb_%' THEN 'image_visual_patterns' WHEN feature LIKE 'text_emb_%' THEN 'text_semantic_patterns' END AS aggregation_key FROM (SELECT DISTINCT feature FROM attrib_v) s)"""
_DIM = "dim AS (SELECT feature, CASE WHEN feature LIKE 'img_emb_%' THEN 'image' WHEN feature LIKE 'text_emb_%' OR feature LIKE 'doc_sentiment_%' THEN 'text' ELSE 'tabular' END AS modality FROM (SELECT DISTINCT feature FROM attrib_v) d)"
query("A28_table_fingerprint")(lambda t: A.fingerprint(t.attrib_v))
query("A28_row_digests", "SELECT sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) AS digest FROM nation")(lambda t: t.nation.select(F.sha2(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey"), 256).alias("digest")))
query("A28_row_digests_orders", "SELECT sha256(o_orderkey || '|' || o_custkey || '|' || o_orderpriority) AS digest FROM orders")(lambda t: t.orders.select(F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderpriority"), 256).alias("digest")))
query("A29_feature_registry", f"WITH {_REG} SELECT * FROM reg")(reg)
query("A30_group_members", f"WITH {_REG} SELECT grp, count(*) AS n, string_agg(feature, ',' ORDER BY feature) AS features FROM reg GROUP BY grp")(lambda t: A.group_members(reg(t), "grp"))
query("A30_aggregation_members", f"WITH {_REG} SELECT aggregation_key, count(*) AS n, string_agg(feature, ',' ORDER BY feature) AS features FROM reg WHERE aggregation_key IS NOT NULL GROUP BY 1")(lambda t: A.group_members(reg(t), "aggregation_key"))
query("A31_provenance_map", f"WITH {_DIM} SELECT feature, modality, CASE modality WHEN 'tabular' THEN 0 WHEN 'text' THEN 1 ELSE 2 END AS place, count(*) OVER (PARTITION BY modality) AS n_in_modality FROM dim")(lambda t: A.provenance_map(dim(t)))
query("A32_classify_modality", f"WITH {_DIM} SELECT feature, modality FROM dim")(dim)
query("A33_modality_breakdown", "SELECT CASE WHEN feature LIKE 'text_emb_%' OR feature = 'doc_sentiment_score' THEN 'text' WHEN feature LIKE 'img_emb_%' THEN 'image' ELSE 'tabular' END AS modality, count(*) AS n FROM (SELECT DISTINCT feature FROM attrib_v) s GROUP BY 1")(
    lambda t: features(t).groupBy(A.coarse_modality(F.col("feature")).alias("modality")).agg(F.count(F.lit(1)).alias("n"))
)
_IMP = "imp AS (SELECT feature, avg(abs(contribution)) AS importance FROM attrib_v GROUP BY feature)"
query("E02_global_importance", f"WITH {_IMP} SELECT feature, round(importance, 8) AS importance, CAST(row_number() OVER (ORDER BY round(importance, 12) DESC, feature) AS INT) AS rank FROM imp")(lambda t: A.global_importance(t.attrib_v).withColumn("importance", F.round("importance", 8)))
query("E03_modality_importance", f"WITH {_IMP}, {_DIM} SELECT coalesce(modality, 'unknown') AS modality, count(*) AS n_features, round(sum(importance) / (SELECT sum(importance) FROM imp), 6) AS share FROM imp LEFT JOIN (SELECT * FROM dim WHERE feature <> 'Age') d USING (feature) GROUP BY 1")(
    lambda t: A.modality_importance(A.global_importance(t.attrib_v), dim(t).where("feature <> 'Age'"))
)
truth = lambda t: t.listings_v.select(F.col("listing_id").alias("row_id"), F.col("speed").alias("y"))
_TOPC = "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cls ORDER BY abs(mean_contribution) DESC, feature) AS INT) AS rank FROM (SELECT cls, feature, round(avg(contribution), 6) AS mean_contribution FROM attrib_v JOIN listings_v ON row_id = listing_id WHERE cls = speed GROUP BY 1, 2) s) u WHERE rank <= 5"
query("E04_per_class_top_k", _TOPC)(lambda t: A.per_class_top(t.attrib_v, truth(t), 5))
query("E05_importance_artifact", f"WITH c AS ({_TOPC}) SELECT cls, string_agg(feature, ',' ORDER BY rank) AS features, count(*) AS n FROM c GROUP BY cls")(
    lambda t: A.per_class_top(t.attrib_v, truth(t), 5).groupBy("cls").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]), ",").alias("features"), F.count(F.lit(1)).alias("n"))
)
_SH = "sh AS (SELECT row_id, modality, CASE WHEN sum(sum(abs(contribution))) OVER (PARTITION BY row_id) > 0 THEN sum(abs(contribution)) / sum(sum(abs(contribution))) OVER (PARTITION BY row_id) ELSE 0 END AS share FROM attrib_v JOIN dim USING (feature) GROUP BY 1, 2)"
query("E06_row_modality_share", f"WITH {_DIM}, {_SH} SELECT row_id, modality, round(share, 6) AS share FROM sh")(lambda t: A.row_shares(t.attrib_v, dim(t)))
query("E07_top_k_per_row", "SELECT row_id, feature, cls, contribution, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature, cls, contribution, value) AS rank FROM attrib_v) s WHERE rank <= 3")(
    lambda t: A.top_per_row(t.attrib_v, 3).select("row_id", "feature", "cls", "contribution", "rank")
)
query("E07_top_k_per_row_modality", f"WITH {_DIM} SELECT row_id, modality, feature, cls, contribution FROM (SELECT *, row_number() OVER (PARTITION BY row_id, modality ORDER BY abs(contribution) DESC, feature, cls, contribution, value) AS rank FROM attrib_v JOIN dim USING (feature)) s WHERE rank <= 1")(
    lambda t: A.top_per_row(t.attrib_v.join(dim(t), "feature"), 1, ["modality"]).select("row_id", "modality", "feature", "cls", "contribution")
)
query("E08_modality_availability", "SELECT listing_id, coalesce(trim(name), '') <> '' AS has_text, photos >= 1 AS has_image, TRUE AS has_tabular, TRUE AS has_metadata FROM listings_v")(lambda t: A.availability(t.listings_v, "name", "photos").select("listing_id", "has_text", "has_image", "has_tabular", "has_metadata"))
present = lambda t: t.orders.select(F.col("o_orderkey").alias("row_id"), F.lit("image").alias("modality"), (F.col("o_orderkey") % 4 > 0).alias("is_present"))
collapsed = lambda t: A.collapse_latent(t.attrib_v, reg(t), present(t))
_COL = f"""{_REG}, g AS (SELECT row_id, coalesce(aggregation_key, feature) AS name, coalesce(modality, 'unknown') AS modality, sum(abs(contribution)) AS magnitude, sum(contribution) AS net, count(*) AS n_dimensions, bool_or(modality = 'image' AND row_id % 4 = 0) AS base FROM attrib_v JOIN reg USING (feature) GROUP BY 1, 2, 3),
 col AS (SELECT row_id, name, modality, round(magnitude, 6) AS magnitude, CASE WHEN round(net, 9) >= 0 THEN 'positive' ELSE 'negative' END AS direction, n_dimensions, coalesce(base, FALSE) AS is_baseline, CASE WHEN sum(CASE WHEN base THEN 0 ELSE magnitude END) OVER (PARTITION BY row_id) > 0 THEN CASE WHEN base THEN 0 ELSE magnitude END / sum(CASE WHEN base THEN 0 ELSE magnitude END) OVER (PARTITION BY row_id) ELSE 0 END AS share FROM g)"""
query("E09_collapse_latent", f"WITH {_COL} SELECT * REPLACE (round(share, 6) AS share) FROM col")(collapsed)
query("E10_top_k_mixed", f"WITH {_COL} SELECT row_id, name, magnitude, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY magnitude DESC, name) AS rank FROM col WHERE NOT is_baseline) s WHERE rank <= 2")(lambda t: A.top_mixed(collapsed(t), 2).select("row_id", "name", "magnitude", "rank"))
query("E11_interpreted_record", f"WITH {_COL} SELECT row_id, string_agg(name, ',' ORDER BY magnitude DESC, name) FILTER (WHERE NOT is_baseline) AS top, count(*) FILTER (WHERE n_dimensions > 1) AS n_latent, CAST(count(*) AS INT) AS n_entries FROM col GROUP BY row_id")(
    lambda t: A.interpreted(collapsed(t), 100).select("row_id", F.expr("nullif(array_join(transform(top_factors, x -> x.name), ','), '')").alias("top"), F.size("latent_summary").cast("long").alias("n_latent"), "n_entries")
)
query("E12_split_factors", f"WITH {_COL} SELECT row_id, coalesce(string_agg(name, ',' ORDER BY magnitude DESC, name) FILTER (WHERE direction = 'positive'), '') AS positive, coalesce(string_agg(name, ',' ORDER BY magnitude DESC, name) FILTER (WHERE direction = 'negative'), '') AS negative FROM col GROUP BY row_id")(lambda t: A.split_factors(collapsed(t)))
_TPL = ", ".join(f"({i}, '{f}', '{c}', '{s}')" for i, (f, c, s) in enumerate(A.TEMPLATES))
_KW = "CASE " + " ".join(f"WHEN contains(lower(name), '{w}') THEN '{f}'" for w, f in A.KEYWORDS) + " END"
query("E15_rule_recommendations", f"""WITH {_COL}, tpl(i, feature, category, suggested) AS (VALUES {_TPL}), own AS (SELECT row_id, {_KW} AS feature, max(magnitude) AS m FROM col WHERE direction = 'negative' GROUP BY 1, 2 HAVING {_KW.replace('name', 'any_value(name)')} IS NOT NULL),
 k AS (SELECT r.row_id, t.feature, t.category, t.suggested, own.m, i FROM (SELECT DISTINCT row_id FROM col) r CROSS JOIN tpl t LEFT JOIN own ON own.row_id = r.row_id AND own.feature = t.feature)
 SELECT row_id, CAST(p AS INT) AS priority, feature, category, suggested FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN m IS NULL THEN 1 ELSE 0 END, CASE WHEN m IS NULL THEN i ELSE -m END, feature) AS p FROM k) s WHERE p <= 5""")(lambda t: A.recommend(collapsed(t)))
_RECS = "SELECT conv_id, turn, CASE CAST(turn % 4 AS INT) WHEN 0 THEN 'PhotoAmt' WHEN 1 THEN 'Fee' WHEN 2 THEN 'Breed1' ELSE 'fee' END AS feature, CASE WHEN conv_id % 3 = 0 THEN 'No change' WHEN conv_id % 3 = 1 THEN '5' ELSE role END AS suggested, CASE WHEN conv_id % 2 = 0 THEN '5' END AS current FROM conversations"
recs = lambda t: t.spark.sql(_RECS.replace("conversations", "{c}"), c=t.conversations)
query("E16_filter_recommendations", f"SELECT conv_id, turn, feature, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, feature ORDER BY turn) AS f FROM ({_RECS}) r WHERE feature <> 'Breed1' AND NOT contains(lower(suggested), 'no change') AND lower(suggested) <> coalesce(current, '')) s WHERE f = 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5")(
    lambda t: A.filter_recommendations(recs(t), "conv_id", "turn").select("conv_id", "turn", "feature", "place")
)


_SHOWN = "CASE name " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in A.DISPLAY_NAMES.items()) + " ELSE name END"
_SPOKEN = "CASE modality WHEN 'tabular' THEN 'listing attributes' WHEN 'text' THEN 'description content' WHEN 'image' THEN 'photo characteristics' WHEN 'metadata' THEN 'image metadata' ELSE modality END"
_TWO = "list(shown ORDER BY rk) FILTER (WHERE direction = '{0}')"
_ONCE = "CASE WHEN len({0}) = 2 AND {0}[1] = {0}[2] THEN {0}[1:1] ELSE {0} END"
query(
    "E17_template_explanation",
    f"""WITH {_COL}, {_S}, rk AS (SELECT * FROM (SELECT row_id, {_SHOWN} AS shown, direction, row_number() OVER (PARTITION BY row_id ORDER BY magnitude DESC, name) AS rk FROM col WHERE NOT is_baseline) a WHERE rk <= 5),
 fa AS (SELECT row_id, ({_TWO.format('positive')})[1:2] AS pos, ({_TWO.format('negative')})[1:2] AS neg FROM rk GROUP BY row_id),
 ms AS (SELECT row_id, modality, round(sum(round(share, 6)), 6) AS share FROM col GROUP BY 1, 2),
 md AS (SELECT row_id, list({_SPOKEN} ORDER BY share DESC, modality) FILTER (WHERE share > 0.01) AS m, max(share) AS top FROM ms GROUP BY row_id)
 SELECT md.row_id, 'The model predicts ' || CASE WHEN predicted <= 2 THEN 'a relatively fast adoption' ELSE 'a slower adoption timeline' END || ' (' || {_LAB} || '), '
 || CASE WHEN confidence >= 0.5 THEN 'with moderate confidence' WHEN confidence >= 0.3 THEN 'though with some uncertainty' ELSE 'though the model shows notable uncertainty across classes' END || '. '
 || CASE coalesce(len(m), 0) WHEN 0 THEN 'The prediction is based on multiple data signals.' WHEN 1 THEN 'The prediction is driven entirely by ' || m[1] || '.'
    ELSE 'The prediction is primarily driven by ' || m[1] || ' (' || CAST(CAST(round_even(top * 100, 0) AS INT) AS VARCHAR) || '%), with additional influence from ' || array_to_string(m[2:], ' and ') || '.' END
 || CASE WHEN len(pos) > 0 THEN ' Factors supporting faster adoption include ' || array_to_string({_ONCE.format('pos')}, ' and ') || '.' ELSE '' END
 || CASE WHEN len(neg) > 0 THEN ' Working against faster adoption: ' || array_to_string({_ONCE.format('neg')}, ' and ') || '.' ELSE '' END AS explanation
 FROM md JOIN scored ON listing_id = md.row_id LEFT JOIN fa ON fa.row_id = md.row_id""",
)(lambda t: A.explain(A.interpreted(collapsed(t), 5), scored(t).select(F.col("listing_id").alias("row_id"), "predicted", "confidence"), LABELS))
