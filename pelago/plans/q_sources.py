"""Queries S01-S20: each writes what Spark derives from the given tables to a scratch folder and reads it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import files as S
from .base import query
from .q_evaluation import CUTS, P, _S, _TRIALS, trials
from .q_evaluation import scored as scored_rows

_LIST = "listing_id bigint, state int, age int, fee double, name string"
_list = lambda t: t.listings_v.select("listing_id", "state", "age", "fee", F.when(F.col("listing_id") % 5 == 0, F.concat(F.lit('say "hi",\n'), F.coalesce("name", F.lit("")))).otherwise(F.col("name")).alias("name"))


@query("S01_scan_listings", "SELECT listing_id, state, age, fee, CASE WHEN listing_id % 5 = 0 THEN 'say \"hi\",' || chr(10) || coalesce(name, '') ELSE CASE WHEN trim(name) = '' THEN NULL ELSE name END END AS name FROM listings_v")
def _(t):
    root = S.work_dir(t.spark)
    S.write_csv(_list(t), f"{root}/train")
    out = S.scan_listings(t.spark, root, "train", _LIST)
    return out.withColumn("name", F.when(F.trim("name") != "", F.col("name")))


@query("S02_scan_reference", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def _(t):
    root = S.work_dir(t.spark)
    S.write_csv(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), f"{root}/state")
    return S.scan_reference(t.spark, root, "state", {"state": "id int, name string"})


@query("S02_scan_reference_parts", "SELECT p_partkey AS id, p_name AS name FROM part")
def _(t):
    root = S.work_dir(t.spark)
    S.write_csv(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), f"{root}/part")
    return S.scan_reference(t.spark, root, "part", {"part": "id bigint, name string"})


@query("S03_scan_keyed_json", "SELECT n_regionkey AS region, count(*) AS n, min(n_name) AS first FROM nation GROUP BY 1")
def _(t):
    root = S.work_dir(t.spark) + "/json"
    t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.min("n_name").alias("first")).repartition(5, "region").write.json(root)
    t.nation.limit(1).select(F.lit("{no json").alias("value")).write.mode("append").text(root)
    rows = t.spark.read.schema("region int, n bigint, first string, _corrupt_record string").json(root)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


@query("S04_scan_keyed_indexed_json", "SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE n_name || '-x' END AS key, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE CAST(n_nationkey AS INT) END AS image_index FROM nation")
def _(t):
    keys = t.nation.select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat_ws("-", "n_name", F.lit("x"), F.col("n_nationkey").cast("string"))).alias("key"))
    return S.split_index(keys)


def _documents(t, root, key):
    """One JSON document per key, summed over the orders, in a folder of its own; besides, one file that is no JSON."""
    doc = t.orders.select(key.alias("key"), "o_orderkey", F.col("o_orderstatus").alias("s")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("latest"), F.array_sort(F.collect_set("s")).alias("kinds"))
    doc.repartition("key").write.partitionBy("key").json(root)
    t.orders.agg(F.concat(F.lit("{no json "), F.count(F.lit(1))).alias("value")).select("value", F.lit("broken").alias("key")).write.mode("append").partitionBy("key").text(root)


_DOCUMENT = "n bigint, latest bigint, kinds array<string>"


@query("S03_scan_keyed_json_files", "SELECT 'c' || CAST(o_orderkey % 32 AS VARCHAR) AS key, count(*) AS n, max(o_orderkey) AS latest, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS kinds FROM orders GROUP BY 1")
def _(t):
    root = S.work_dir(t.spark) + "/json"
    _documents(t, root, F.concat(F.lit("c"), (F.col("o_orderkey") % 32).cast("string")))
    return S.scan_keyed_json(t.spark, root, _DOCUMENT, S.FOLDER).select("key", "n", "latest", F.array_join("kinds", ",").alias("kinds"))


@query("S04_scan_keyed_indexed_json_files", "SELECT key, image_index, CAST(sum(n) AS BIGINT) AS n, max(latest) AS latest FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'plain' ELSE 'k-' || CAST(o_orderkey % 5 AS VARCHAR) END AS key, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE CAST(o_orderkey % 7 AS INT) END AS image_index, count(*) AS n, max(o_orderkey) AS latest FROM orders GROUP BY 1, 2) s GROUP BY 1, 2")
def _(t):
    root = S.work_dir(t.spark) + "/json"
    k = F.col("o_orderkey")
    _documents(t, root, F.when(k % 5 == 0, "plain").otherwise(F.concat_ws("-", F.lit("k"), (k % 5).cast("string"), (k % 7).cast("string"))))
    return S.scan_keyed_indexed_json(t.spark, root, _DOCUMENT, S.FOLDER).select("key", "image_index", "n", "latest")


@query("S05_lookup_documents", "SELECT 'found' AS status, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'missing', count(*) FROM (SELECT doc_id * 3 AS doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def _(t):
    found, _ = S.lookup(t.documents, t.labels, "doc_id")
    _, missing = S.lookup(t.documents, t.labels.select((F.col("doc_id") * 3).alias("doc_id")), "doc_id")
    n = F.count(F.lit(1)).alias("n")
    return found.agg(n).select(F.lit("found").alias("status"), "n").union(missing.agg(n).select(F.lit("missing").alias("status"), "n"))


@query("S06_scan_images_by_key", "SELECT DISTINCT o_orderstatus AS key, CAST(1 AS BIGINT) AS n FROM orders")
def _(t):
    path = S.work_dir(t.spark) + "/by_key"
    t.orders.select(F.col("o_orderstatus").alias("key"), "o_orderkey").repartition("key").write.partitionBy("key").parquet(path)
    return S.files_by_key(t.spark, path, r"/key=([^/]+)/").select("key", "n")


@query("S07_scan_parquet", "SELECT listing_id, state, age, fee FROM listings_v")
def _(t):
    path = S.work_dir(t.spark) + "/listings"
    S.write_parquet(_list(t).drop("name"), path)
    return S.scan_parquet(t.spark, path)


@query("S08_sink_parquet", "SELECT state, count(*) AS n FROM listings_v GROUP BY state")
def _(t):
    path = S.work_dir(t.spark) + "/by_state"
    S.write_parquet(t.listings_v.groupBy("state").agg(F.count(F.lit(1)).alias("n")), path)
    return S.scan_parquet(t.spark, path)


@query("S09_scan_feature_set", "SELECT listing_id, age, fee, CASE WHEN type = 1 THEN 'train' ELSE 'test' END AS split FROM listings_v")
def _(t):
    root = S.work_dir(t.spark)
    parts = {"train": "type = 1", "test": "type <> 1"}
    for split, rule in parts.items():
        S.write_feature_set(t.listings_v.where(rule).select("listing_id", "age", "fee"), root, "tabular", "v1", split)
    read = [S.scan_feature_set(t.spark, root, "tabular", "v1", split)[0].withColumn("split", F.lit(split)) for split in parts]
    return read[0].unionByName(read[1])


@query("S10_file_inventory")
def _(t):
    root = S.work_dir(t.spark)
    S.write_csv(_list(t).repartition(3), f"{root}/csv")
    S.write_parquet(_list(t).repartition(2), f"{root}/pq")
    return S.file_inventory(t.spark, root).where("extension in ('.csv', '.parquet')")


@query("S10_file_counts", "SELECT extension, count(DISTINCT state) AS n_files FROM listings_v CROSS JOIN (VALUES ('.csv'), ('.json')) e(extension) GROUP BY extension")
def _(t):
    root = S.work_dir(t.spark)
    rows = _list(t).withColumn("place", F.col("state")).repartition("place")
    rows.write.partitionBy("place").csv(f"{root}/csv")
    rows.write.partitionBy("place").json(f"{root}/json")
    return S.file_inventory(t.spark, root).where("extension in ('.csv', '.json')").groupBy("extension").agg(F.sum("n_files").alias("n_files"))


query("S11_feature_schema_sidecar", "SELECT * FROM (VALUES ('tabular', 'v1', 0, 'listing_id', 'bigint', 3, 42), ('tabular', 'v1', 1, 'age', 'int', 3, 42), ('tabular', 'v1', 2, 'fee', 'double', 3, 42)) v(modality, version, place, \"column\", dtype, n_columns, seed)")(
    lambda t: S.sidecar(t.listings_v.select("listing_id", "age", "fee"), "tabular", "v1")
)


@query(
    "S11_sidecar_against_table",
    """SELECT 'listing_id' AS "column", 'present' AS status, 'bigint' AS dtype, count(*) AS n_rows, count(*) - count(listing_id) AS n_null FROM listings_v UNION ALL SELECT 'name', 'present', 'string', count(*), count(*) - count(name) FROM listings_v
 UNION ALL SELECT 'fee', 'absent', 'double', NULL, NULL UNION ALL SELECT 'video', 'missing', NULL, NULL, NULL""",
)
def _(t):
    path = S.work_dir(t.spark) + "/sidecar"
    columns = S.sidecar(t.listings_v.select("listing_id", "name", "fee"), "tabular", "v1")
    columns.write.json(path)
    return S.sidecar_check(t.spark.read.schema(columns.schema).json(path), t.listings_v.select("listing_id", "name"), ["listing_id", "fee", "video"])


@query("S12_sink_submission", f"WITH {_S} SELECT listing_id, predicted FROM scored")
def _(t):
    path = S.work_dir(t.spark) + "/submission"
    S.write_submission(scored_rows(t), "listing_id", "predicted", path)
    return S.scan_csv(t.spark, path, "listing_id bigint, predicted int")


@query("S14_run_audit_record", f"WITH {_S} SELECT count(*) AS n_rows, count(*) FILTER (WHERE predicted = 2) AS n_2, '\"m1\"' AS model FROM scored")
def _(t):
    path = S.work_dir(t.spark) + "/audit"
    row = S.audit_row(scored_rows(t).select("listing_id", "predicted"), {"model": "m1", "cuts": list(CUTS), "columns": P})
    row.write.json(path)
    return t.spark.read.schema(row.schema).json(path).select("predictions.n_rows", "predictions.n_2", F.col("run")["model"].alias("model"))


@query("S15_sink_audit_jsonl", "SELECT CAST(strftime(ts, '%Y-%m-%d') AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY 1")
def _(t):
    path = S.work_dir(t.spark) + "/audit"
    S.append_jsonl(t.events.where("event_id % 2 = 0"), path, "ts")
    S.append_jsonl(t.events.where("event_id % 2 = 1"), path, "ts")
    return t.spark.read.schema("event_id bigint, date string").json(path).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("S16_validation_report", "SELECT CAST(3 AS BIGINT) AS n_checks, CAST(1 AS BIGINT) AS n_passed, FALSE AS overall_passed FROM listings_v HAVING count(*) > 0")
def _(t):
    p = Q.check_implications(t.listings_v, {"b": (F.col("breed2") != 0, F.col("breed1") != 0), "f": (F.lit(True), F.col("fee") >= 0), "y": (F.lit(True), F.col("age") > 0)})
    checks = p.select(F.col("rule").alias("check"), "passed")
    root = S.work_dir(t.spark)
    S.markdown(checks).coalesce(1).write.text(f"{root}/report")
    S.validation_report(checks).write.json(f"{root}/json")
    return t.spark.read.schema("n_checks bigint, n_passed bigint, overall_passed boolean").json(f"{root}/json")


@query("S17_experiment_log", f"SELECT trial, family, score FROM ({_TRIALS}) s ORDER BY score DESC, trial")
def _(t):
    path = S.work_dir(t.spark) + "/log"
    rows = trials(t).select("trial", "family", "score")
    S.append_experiment(rows.where("family = 'tree'"), path)
    S.append_experiment(rows.where("family <> 'tree'"), path)
    return S.experiments(t.spark, path, "score")


@query("S18_load_model_matrix", "SELECT listing_id, age, fee, speed FROM listings_v")
def _(t):
    x, y = S.load_matrix(t.listings_v.select("listing_id", "age", "fee", "speed"), "listing_id", "speed")
    return x.join(y, "listing_id")


@query("S19_explore_artifacts", "SELECT state, count(*) AS n, round(avg(speed), 6) AS mean_speed FROM listings_v GROUP BY state")
def _(t):
    path = S.work_dir(t.spark) + "/explore"
    rows = t.listings_v.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("speed"), 6).alias("mean_speed"))
    rows.write.json(path)
    return t.spark.read.schema(rows.schema).json(path)
