"""Queries P01-P26 and K01-K15: cleaning, features and joins on the listing views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import features as X
from .base import query

_NAME_SQL = """CASE WHEN trim(name) = '' THEN NULL
 WHEN regexp_matches(lower(trim(name)), '^no\\s*name\\b.*$|^unnamed\\b.*$|^none$|^n/?a$|^unknown$|^-+$|^\\.+$|^\\?+$') THEN NULL
 WHEN regexp_matches(trim(name), '^[0-9]+$') THEN NULL WHEN NOT regexp_matches(trim(name), '[A-Za-z0-9]') THEN NULL ELSE trim(name) END"""
_RULE_SQL = """CASE WHEN name IS NULL THEN 'null' WHEN trim(name) = '' THEN 'empty'
 WHEN regexp_matches(lower(trim(name)), '^no\\s*name\\b.*$|^unnamed\\b.*$|^none$|^n/?a$|^unknown$|^-+$|^\\.+$|^\\?+$') THEN 'placeholder'
 WHEN regexp_matches(trim(name), '^[0-9]+$') THEN 'numeric' WHEN NOT regexp_matches(trim(name), '[A-Za-z0-9]') THEN 'symbol' ELSE 'kept' END"""


@query("P01_clean_names", f"SELECT listing_id, {_NAME_SQL} AS name, CAST(({_NAME_SQL}) IS NOT NULL AS INT) AS has_name FROM listings_v")
def _(t):
    return C.clean_names(t.listings_v, "name").select("listing_id", "name", "has_name")


@query("X09_name_quality_report", f"SELECT {_RULE_SQL} AS rule, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM listings_v GROUP BY 1")
def _(t):
    out = t.listings_v.groupBy(C.name_rule("name").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4))


query("P01_name_rule_counts", f"SELECT {_RULE_SQL} AS rule, count(*) AS n FROM listings_v GROUP BY 1")(lambda t: t.listings_v.groupBy(C.name_rule("name").alias("rule")).agg(F.count(F.lit(1)).alias("n")))


@query("P02_normalize_text", "SELECT doc_id, CASE WHEN nfc_normalize(trim(text, ' ')) IN ('nan', '<NA>', 'None', '') THEN NULL ELSE nfc_normalize(trim(text, ' ')) END AS text, source FROM documents")
def _(t):
    return C.normalize_text(t.documents, "text", "source").select("doc_id", "text", "source")


_CODES = {"breed1": ([1, 2, 3, 4, 5], 307), "breed2": ([1, 2, 3], 0), "photos": ([0, 1, 2], 0)}


@query("P03_fix_invalid_codes", "SELECT listing_id, CASE WHEN breed1 IN (1,2,3,4,5) THEN breed1 ELSE 307 END AS breed1, CASE WHEN breed2 IN (1,2,3) THEN breed2 ELSE 0 END AS breed2, CASE WHEN photos IN (0,1,2) THEN photos ELSE 0 END AS photos FROM listings_v")
def _(t):
    return C.fix_codes(t.listings_v, _CODES).select("listing_id", "breed1", "breed2", "photos")


@query("P03_invalid_code_counts", """SELECT 'breed1' AS "column", CAST(count(*) FILTER (WHERE breed1 NOT IN (1,2,3,4,5)) AS BIGINT) AS n_invalid, string_agg(DISTINCT CAST(breed1 AS VARCHAR), ',' ORDER BY CAST(breed1 AS VARCHAR)) FILTER (WHERE breed1 NOT IN (1,2,3,4,5)) AS bad_values FROM listings_v
UNION ALL SELECT 'breed2', count(*) FILTER (WHERE breed2 NOT IN (1,2,3)), string_agg(DISTINCT CAST(breed2 AS VARCHAR), ',' ORDER BY CAST(breed2 AS VARCHAR)) FILTER (WHERE breed2 NOT IN (1,2,3)) FROM listings_v
UNION ALL SELECT 'photos', count(*) FILTER (WHERE photos NOT IN (0,1,2)), string_agg(DISTINCT CAST(photos AS VARCHAR), ',' ORDER BY CAST(photos AS VARCHAR)) FILTER (WHERE photos NOT IN (0,1,2)) FROM listings_v""")
def _(t):
    return C.invalid_codes(t.listings_v, _CODES)


@query("P04_swap_columns_if", "SELECT listing_id, CASE WHEN breed1 = 0 AND breed2 <> 0 THEN breed2 ELSE breed1 END AS breed1, CASE WHEN breed1 = 0 AND breed2 <> 0 THEN 0 ELSE breed2 END AS breed2 FROM listings_v")
def _(t):
    return C.move_if_empty(t.listings_v, "breed1", "breed2").select("listing_id", "breed1", "breed2")


@query("P05_enforce_dtypes", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events")
def _(t):
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("bad"))
    return C.enforce_types(rows, {"k": "bigint", "bad": "double"})


_CLEAN_SQL = f"""clean_v AS (SELECT listing_id, owner_id, speed, type, age, photos, quantity, fee, vaccinated, dewormed, {_NAME_SQL} AS name,
 CASE WHEN b1 IN (1,2,3,4,5) THEN b1 ELSE 307 END AS breed1, CASE WHEN b2 IN (1,2,3) THEN b2 ELSE 0 END AS breed2,
 CASE WHEN state IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20) THEN state ELSE (SELECT state FROM listings_v WHERE state < 20 GROUP BY state ORDER BY count(*) DESC, state LIMIT 1) END AS state
 FROM (SELECT *, CASE WHEN breed1 = 0 AND breed2 <> 0 THEN breed2 ELSE breed1 END AS b1, CASE WHEN breed1 = 0 AND breed2 <> 0 THEN 0 ELSE breed2 END AS b2 FROM listings_v) s)"""


def clean_listings(t):
    """The fixed pipeline: names, breed swap, breed codes, states outside the dimension to the mode."""
    rows = C.fix_codes(C.move_if_empty(C.clean_names(t.listings_v, "name"), "breed1", "breed2"), {k: _CODES[k] for k in ("breed1", "breed2")})
    known = F.broadcast(t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("state")))  # a table of 25 rows
    usual = C.mode(t.listings_v.where("state < 20"), "state").withColumnRenamed("state", "_usual")
    joined = rows.join(known.withColumn("_ok", F.lit(True)), "state", "left").crossJoin(F.broadcast(usual))
    return joined.withColumn("state", F.when(F.col("_ok"), F.col("state")).otherwise(F.col("_usual")))


@query("P06_clean_table", f"WITH {_CLEAN_SQL} SELECT listing_id, name, CAST(name IS NOT NULL AS INT) AS has_name, breed1, breed2, state, quantity FROM clean_v")
def _(t):
    return clean_listings(t).select("listing_id", "name", "has_name", "breed1", "breed2", "state", "quantity")


# ---- P07-P17: features -------------------------------------------------------------------------
_RECODE = "CASE {c} WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN -1 END"
_BIN = "CASE WHEN age >= 0 AND age <= 1 THEN 0 WHEN age <= 3 AND age > 1 THEN 1 WHEN age <= 6 AND age > 3 THEN 2 WHEN age <= 12 AND age > 6 THEN 3 WHEN age <= 24 AND age > 12 THEN 4 WHEN age <= 60 AND age > 24 THEN 5 ELSE 6 END"
query("P07_binary_encode", "SELECT listing_id, CAST(type = 1 AS INT) AS is_dog FROM listings_v")(lambda t: t.listings_v.select("listing_id", X.equals("type", 1).alias("is_dog")))
query("P08_count_matches", "SELECT listing_id, CAST(vaccinated = 1 AS INT) + CAST(dewormed = 1 AS INT) AS health_care_score FROM listings_v")(lambda t: t.listings_v.select("listing_id", X.count_equal(["vaccinated", "dewormed"], 1).alias("health_care_score")))
query("P09_recode_map", f"SELECT listing_id, {_RECODE.format(c='vaccinated')} AS vaccinated, coalesce({_RECODE.format(c='photos')}, 0) AS photos FROM listings_v")(
    lambda t: t.listings_v.select("listing_id", X.care("vaccinated").alias("vaccinated"), X.care("photos", serving=True).alias("photos"))
)
query("P10_log_transforms", "SELECT listing_id, round(ln(1 + age), 6) AS log_age, round(ln(1 + fee), 6) AS log_fee, round(ln(1 + quantity), 6) AS log_quantity, round(ln(1 + photos), 6) AS log_photos FROM listings_v")(
    lambda t: t.listings_v.select("listing_id", *[F.round(F.log1p(c), 6).alias(f"log_{c}") for c in ("age", "fee", "quantity", "photos")])
)
query("P11_ordinal_bin", f"SELECT listing_id, age, {_BIN} AS age_bin FROM listings_v")(lambda t: t.listings_v.select("listing_id", "age", X.right_closed_bin("age").alias("age_bin")))
query("P12_ratio_and_flags", "SELECT listing_id, CAST(fee = 0 AS INT) AS is_free, round(fee / greatest(quantity, 1), 4) AS fee_per_pet, CAST(quantity = 1 AS INT) AS is_single_pet, CAST(photos > 0 AS INT) AS has_photos FROM listings_v")(
    lambda t: t.listings_v.select("listing_id", X.equals("fee", 0).alias("is_free"), F.round(X.per_unit("fee", "quantity"), 4).alias("fee_per_pet"), X.equals("quantity", 1).alias("is_single_pet"), (F.col("photos") > 0).cast("int").alias("has_photos"))
)
query("P13_name_features", f"SELECT listing_id, CAST(coalesce(length(n), 0) AS INT) AS name_length, CAST(coalesce(len(string_split_regex(n, '\\s+')), 0) AS INT) AS name_word_count FROM (SELECT listing_id, {_NAME_SQL} AS n FROM listings_v) s")(
    lambda t: X.name_features(C.clean_names(t.listings_v, "name"), "name", "has_name").select("listing_id", "name_length", "name_word_count")
)
query("P14_breed_flags", "SELECT listing_id, CAST(breed2 <> 0 AS INT) AS is_mixed_breed, CAST(breed1 <> 0 AS INT) + CAST(breed2 <> 0 AS INT) AS breed_count FROM listings_v")(
    lambda t: t.listings_v.select("listing_id", (F.col("breed2") != 0).cast("int").alias("is_mixed_breed"), X.count_nonzero(["breed1", "breed2"]).alias("breed_count"))
)
query("P15_nonzero_count_and_missing_flags", "SELECT listing_id, CAST(breed1 > 0 AS INT) + CAST(breed2 > 0 AS INT) + CAST(photos > 0 AS INT) AS color_count, CAST(breed2 = 0 AS INT) AS breed2_missing, CAST(photos = 0 AS INT) AS photos_missing FROM listings_v")(
    lambda t: t.listings_v.select("listing_id", X.count_nonzero(["breed1", "breed2", "photos"]).alias("color_count"), X.equals("breed2", 0).alias("breed2_missing"), X.equals("photos", 0).alias("photos_missing"))
)
query("P16_interactions", f"SELECT listing_id, age * CAST(type = 1 AS INT) AS age_x_type, dewormed * ({_RECODE.format(c='vaccinated')}) AS health_x_vaccinated FROM listings_v")(
    lambda t: t.listings_v.select("listing_id", (F.col("age") * X.equals("type", 1)).alias("age_x_type"), (F.col("dewormed") * X.care("vaccinated")).alias("health_x_vaccinated"))
)
query("P17_select_features", "SELECT listing_id, age, fee, CAST(NULL AS DOUBLE) AS video FROM listings_v")(lambda t: X.select_features(t.listings_v, {"listing_id": "long", "age": "int", "fee": "double", "video": "double"}))
query("P18_decode_labels", "SELECT listing_id, coalesce(n_name, 'Unknown') AS state_name, coalesce(CASE type WHEN 1 THEN 'Dog' WHEN 2 THEN 'Cat' END, 'Unknown') AS type_name FROM listings_v LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON state = n_nationkey")(
    lambda t: X.decode(t.listings_v, "state", t.nation.where("n_nationkey < 20").select("n_nationkey", "n_name"), "state_name").select("listing_id", "state_name", C.recode("type", {1: "Dog", 2: "Cat"}, "Unknown").alias("type_name"))
)
query(
    "P19_encode_request",
    """SELECT listing_id, CASE pet_type WHEN 'Dog' THEN 1 WHEN 'Cat' THEN 2 END AS type, CASE vacc WHEN 'Yes' THEN 1 WHEN 'No' THEN 2 WHEN 'Not Sure' THEN 3 END AS vaccinated, nullif(breed2, 0) AS breed2, CASE WHEN trim(name) = '' THEN NULL ELSE name END AS name,
 coalesce(pet_type IN ('Dog', 'Cat') AND vacc IN ('Yes', 'No', 'Not Sure') AND age BETWEEN 0 AND 255 AND fee >= 0 AND quantity >= 1, FALSE) AS valid
 FROM (SELECT *, CASE type WHEN 1 THEN 'Dog' ELSE 'Cat' END AS pet_type, CASE vaccinated WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' ELSE 'Maybe' END AS vacc FROM listings_v) s""",
)(lambda t: X.encode_request(t.listings_v.select("listing_id", "age", "fee", "quantity", "breed2", "name", C.recode("type", {1: "Dog"}, "Cat").alias("pet_type"), C.recode("vaccinated", {1: "Yes", 2: "No"}, "Maybe").alias("vaccinated"))))
query(
    "P20_format_value",
    """SELECT listing_id, CASE WHEN x = floor(x) AND abs(x) < 1000000 THEN CAST(CAST(x AS BIGINT) AS VARCHAR) WHEN abs(x) < 0.01 THEN printf('%.4f', x) ELSE printf('%.2f', x) END AS shown, CASE WHEN trim(coalesce(name, '')) = '' THEN '' WHEN name = '123' THEN '123' ELSE name END AS name
 FROM (SELECT *, CASE WHEN listing_id % 3 = 0 THEN age / 1024.0 WHEN listing_id % 3 = 1 THEN CAST(age AS DOUBLE) ELSE age * 0.25 END AS x FROM listings_v) s""",
)(
    lambda t: t.listings_v.withColumn("x", F.expr("cast(CASE WHEN listing_id % 3 = 0 THEN cast(age as double) / 1024 WHEN listing_id % 3 = 1 THEN age ELSE age * 0.25 END as double)").cast("string")).select("listing_id", C.format_value("x").alias("shown"), C.format_value("name").alias("name"))
)
query("P21_modality_defaults", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")(lambda t: t.docs_v.select("doc_id", "quality", "toxic").na.fill({"quality": 0, "toxic": -1}))
query("P23_assemble_by_schema", "SELECT listing_id, [CAST(age AS DOUBLE), 0.0, fee] AS vector, 1 AS n_missing FROM listings_v")(lambda t: X.assemble(t.listings_v, ["age", "video", "fee"]).select("listing_id", "vector", "n_missing"))
query("P24_degrade_modalities", "SELECT listing_id, age, CAST(0 AS DOUBLE) AS fee, CAST(0 AS INT) AS photos FROM listings_v")(lambda t: X.degrade(t.listings_v.select("listing_id", "age", "fee", "photos"), {"fee": "tabular", "photos": "image", "age": "meta"}, ["tabular", "image"]).withColumn("fee", F.col("fee").cast("double")))
query("P25_segment_label", "SELECT listing_id, CASE WHEN fee = 0 THEN 'Free' ELSE 'Paid' END AS fee_segment, CASE WHEN breed2 = 0 THEN 'Purebred' ELSE 'Mixed' END AS breed_segment FROM listings_v")(
    lambda t: t.listings_v.select("listing_id", F.when(F.col("fee") == 0, "Free").otherwise("Paid").alias("fee_segment"), F.when(F.col("breed2") == 0, "Purebred").otherwise("Mixed").alias("breed_segment"))
)
query("P26_row_filters", "SELECT listing_id, state FROM listings_v WHERE type = 1 AND fee > 0 AND name IS NOT NULL AND state IN (SELECT state FROM listings_v GROUP BY state ORDER BY count(*) DESC, state LIMIT 5)")(
    lambda t: X.in_top(t.listings_v.where("type = 1 and fee > 0 and name is not null"), t.listings_v, "state", 5).select("listing_id", "state")
)

# ---- K01-K15: joins and key sets ---------------------------------------------------------------
query(
    "K01_enrich_with_group_stats",
    """WITH s AS (SELECT owner_id, count(*) AS n, avg(photos) AS p, avg(fee) AS f FROM listings_v WHERE type = 1 GROUP BY owner_id)
 SELECT listing_id, round(coalesce(n, (SELECT avg(n) FROM s)), 6) AS owner_count, round(coalesce(p, (SELECT avg(p) FROM s)), 6) AS owner_mean_photos, round(coalesce(f, (SELECT avg(f) FROM s)), 6) AS owner_mean_fee FROM listings_v v LEFT JOIN s ON v.owner_id = s.owner_id""",
)(
    lambda t: X.GroupStats.fit(t.listings_v.where("type = 1"), "owner_id", {"photos": "owner_mean_photos", "fee": "owner_mean_fee"}, "owner_count")
    .apply(t.listings_v)  # owners without a listing of the fitted type get the mean of all owners
    .select("listing_id", F.round("owner_count", 6).alias("owner_count"), F.round("owner_mean_photos", 6).alias("owner_mean_photos"), F.round("owner_mean_fee", 6).alias("owner_mean_fee"))
)
query(
    "K01_enrich_with_group_stats_all",
    """WITH s AS (SELECT owner_id, count(*) AS n, avg(photos) AS p, avg(fee) AS f FROM listings_v GROUP BY owner_id)
 SELECT listing_id, round(CAST(n AS DOUBLE), 6) AS owner_count, round(p, 6) AS owner_mean_photos, round(f, 6) AS owner_mean_fee FROM listings_v v JOIN s ON v.owner_id = s.owner_id""",
)(
    lambda t: X.GroupStats.fit(t.listings_v, "owner_id", {"photos": "owner_mean_photos", "fee": "owner_mean_fee"}, "owner_count")
    .apply(t.listings_v)
    .select("listing_id", F.round("owner_count", 6).alias("owner_count"), F.round("owner_mean_photos", 6).alias("owner_mean_photos"), F.round("owner_mean_fee", 6).alias("owner_mean_fee"))
)
query(
    "K02_frequency_encode",
    """WITH f AS (SELECT breed1, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM listings_v WHERE breed1 < 5 GROUP BY breed1)
 SELECT listing_id, round(coalesce(share, (SELECT min(share) FROM f)), 6) AS breed1_freq FROM listings_v v LEFT JOIN f ON v.breed1 = f.breed1""",
)(lambda t: X.Frequencies.fit(t.listings_v.where("breed1 < 5"), "breed1").apply(t.listings_v, "breed1_freq").select("listing_id", F.round("breed1_freq", 6).alias("breed1_freq")))
query("K03_join_sentiment", "SELECT doc_id, coalesce(CAST(quality AS DOUBLE), 0.0) AS score FROM docs_v")(lambda t: X.left_fill(t.documents.select("doc_id"), t.labels.select("doc_id", F.col("quality").cast("double").alias("score")), "doc_id"))
query("K04_join_vision", "SELECT o_orderkey AS listing_id, coalesce(n, 0.0) AS n_lines, coalesce(q, 0.0) AS mean_quantity FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey")(
    lambda t: X.left_fill(t.orders.select(F.col("o_orderkey").alias("listing_id")), t.lineitem.groupBy(F.col("l_orderkey").alias("listing_id")).agg(F.count(F.lit(1)).cast("double").alias("n_lines"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity")), "listing_id")
)
query("K05_fuse_modalities", "SELECT doc_id, d.n_chars, l.quality, v.label FROM documents d FULL JOIN labels l USING (doc_id) FULL JOIN (SELECT vec_id + 100 AS doc_id, label FROM embeddings) v USING (doc_id)")(
    lambda t: X.fuse([t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", "quality"), t.embeddings.select((F.col("vec_id") + 100).alias("doc_id"), "label")], "doc_id")
)
query("K06_inner_cross_analysis", "SELECT quality, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY quality")(lambda t: t.documents.join(t.labels, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars")))
query("K07_attach_target", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality IS NULL) AS n_missing, count(*) FILTER (WHERE quality IS NULL) = 0 AS passed FROM docs_v")(
    lambda t: t.docs_v.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("quality").isNull()).alias("n_missing")).withColumn("passed", F.col("n_missing") == 0)
)
query(
    "K08_referential_integrity",
    """SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS orphans, round(CASE WHEN count(*) = 0 THEN 100 ELSE 100.0 * count(*) FILTER (WHERE ok) / count(*) END, 2) AS coverage_pct
 FROM (SELECT breed1 = 0 OR coalesce(breed1 IN (SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 1 AND 4), FALSE) AS ok FROM listings_v) s""",
)(lambda t: X.integrity(t.listings_v, "breed1", t.nation.where("n_nationkey between 1 and 4"), "n_nationkey", allow_zero=True))
query("K08_orphans", "SELECT breed1 AS value, count(*) AS n FROM listings_v WHERE breed1 > 4 GROUP BY 1")(lambda t: X.orphans(t.listings_v, "breed1", t.nation.where("n_nationkey between 1 and 4"), "n_nationkey", allow_zero=True))
query("K09_key_coverage", "SELECT count(*) AS n_keys, count(l.doc_id) AS n_matched, round(100.0 * count(l.doc_id) / count(*), 2) AS coverage_pct, 100.0 * count(l.doc_id) / count(*) >= 95 AS passed FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")(
    lambda t: X.key_coverage(t.documents, t.labels, "doc_id", 95)
)
query(
    "K10_key_alignment",
    """SELECT 'labels' AS other, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_first, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_other
 UNION ALL SELECT 'embeddings', (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings)), (SELECT count(*) FROM (SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM documents))""",
)(lambda t: X.key_alignment(t.documents.select("doc_id"), {"labels": t.labels.select("doc_id"), "embeddings": t.embeddings.select(F.col("vec_id").alias("doc_id"))}))
query("K11_membership_filter", "SELECT state, count(*) AS n FROM listings_v WHERE state IN (SELECT state FROM listings_v GROUP BY state ORDER BY count(*) DESC, state LIMIT 5) GROUP BY state")(lambda t: X.in_top(t.listings_v, t.listings_v, "state", 5).groupBy("state").agg(F.count(F.lit(1)).alias("n")))
query(
    "K12_scenario_cross",
    "SELECT listing_id, g.feature, CAST(g.candidate AS DOUBLE) AS candidate FROM listings_v CROSS JOIN (VALUES ('photos', 1), ('photos', 3), ('fee', 0), ('fee', 10), ('quantity', 1)) g(feature, candidate) WHERE candidate <> CASE feature WHEN 'photos' THEN CAST(photos AS DOUBLE) WHEN 'fee' THEN fee ELSE quantity END",
)(lambda t: X.scenarios(t.listings_v, {"photos": [1, 3], "fee": [0, 10], "quantity": [1]}, "listing_id").select("listing_id", "feature", "candidate"))
query("K13_subset_check", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS n_outside, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AS passed")(lambda t: X.subset_check(t.labels, t.documents, "doc_id"))
query("K14_same_rows", "SELECT 0::BIGINT AS only_left, count(*) AS only_right FROM listings_v WHERE listing_id % 11 IN (1, 2)")(
    lambda t: X.same_rows(t.listings_v.where("listing_id % 11 not in (1, 2)").select("listing_id", "name"), t.listings_v.select("listing_id", "name"))
)
query("K15_required_fields_check", "SELECT * FROM (VALUES ('age', 'present', TRUE), ('breed1', 'extra', FALSE), ('fee', 'present', TRUE), ('video', 'missing', FALSE)) v(\"column\", status, same_place)")(
    lambda t: X.field_check(t.listings_v.select("age", "fee", "breed1"), ["age", "fee", "video"])
)
