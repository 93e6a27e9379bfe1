"""Hand-made cases: nulls, ties, edges, both outcomes of checks, files, streams."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelago.functions import documents as D
from pelago.functions import images as I
from pelago.functions import text as T
from pelago.operators import attribution as A
from pelago.operators import cleaning as C
from pelago.operators import evaluation as E
from pelago.operators import features as X
from pelago.operators import models as M
from pelago.operators import quality as Q
from pelago.operators import stats as S
from pelago.plans.registry import queries
from pelago.shipping import ship
from pelago.sources import files as IO
from pelago.streaming import runs as R

QUERIES = queries()


def one(df):
    return df.collect()[0]


def test_names(spark):
    names = ["Rex", " Rex ", "", "  ", None, "No Name", "no  name yet", "nonamed", "Unnamed 01", "None", "n/a", "NA", "unknown", "--", "...", "??", "123", "!!!", "Rex 2"]
    got = [r["name"] for r in C.clean_names(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string"), "name").orderBy("i").collect()]
    assert got == ["Rex", "Rex", None, None, None, None, None, "nonamed", None, None, None, None, None, None, None, None, None, None, "Rex 2"]


def test_texts_and_codes(spark):
    ship(spark)
    df = spark.createDataFrame([("nan",), ("<NA>",), (" a ",), ("é",), (None,), ("",)], "t string")
    assert [r["t"] for r in C.normalize_text(df, "t").collect()] == [None, None, "a", "é", None, None]
    codes = spark.createDataFrame([(1, 0), (None, 5), (0, 3), (9, 0)], "a int, b int")
    fixed = C.fix_codes(codes, {"a": ([1, 2], 307)}).collect()
    assert [r["a"] for r in fixed] == [1, 307, 307, 307]  # nulls are invalid too
    moved = [tuple(r) for r in C.move_if_empty(codes, "a", "b").collect()]
    assert moved == [(1, 0), (None, 5), (3, 0), (9, 0)]
    typed = C.enforce_types(spark.createDataFrame([("7", "x"), (None, "1.5"), ("q", None)], "a string, b string"), {"a": "bigint", "b": "double"}).collect()
    assert [tuple(r) for r in typed] == [(7, None), (0, 1.5), (0, None)]


def test_bins_and_values(spark):
    ages = spark.createDataFrame([(a,) for a in (0, 1, 2, 3, 6, 7, 60, 61, 255, 300, -1, None)], "age int")
    assert [r[0] for r in ages.select(X.right_closed_bin("age")).collect()] == [0, 0, 1, 1, 2, 3, 5, 6, 6, 6, 6, 6]
    shown = spark.createDataFrame([(v,) for v in ("3.0", "0.00123", "2.345", "abc", "", None, "12345678")], "v string").select(C.format_value("v")).collect()
    assert [r[0] for r in shown] == ["3", "0.0012", "2.35", "abc", "", "", "12345678.00"]


def test_unseen_keys_and_empty_train(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "k string, v double")
    new = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    got = {r["k"]: r["f"] for r in X.Frequencies.fit(train, "k").apply(new, "f").collect()}
    assert got == {"a": 2 / 3, "z": 1 / 3, None: 1 / 3}
    stats = {r["k"]: (r["n"], r["m"]) for r in X.GroupStats.fit(train.where("k is not null"), "k", {"v": "m"}, "n").apply(new).collect()}
    assert stats["a"] == (2, 2.0) and stats["z"] == (1.5, 3.5)  # means over the groups
    assert X.Frequencies.fit(train.where("false"), "k").apply(new, "f").where("f is null").count() == 3


def test_text_statistics_modes(spark):
    df = spark.createDataFrame([("Hi there. Bye!", ), ("",), (None,), ("é_a!",)], "t string")
    tr = T.text_stats(df, "t").collect()
    assert (tr[0]["description_length"], tr[0]["word_count"], tr[0]["sentence_count"]) == (14, 3, 3)  # the empty tail counts
    assert tr[1]["word_count"] == 0 and tr[1]["sentence_count"] == 1 and tr[3]["punctuation_ratio"] == 0.25
    sv = T.text_stats(df, "t", "serving").collect()
    assert sv[0]["sentence_count"] == 2 and sv[1]["sentence_count"] == 0 and sv[3]["punctuation_ratio"] == 0.5
    pre = spark.createDataFrame([(None,), ("<b> </b>",), ("see http://a.b/c and me@x.org  now <i>ok</i>",)], "t string").select(T.preprocess("t")).collect()
    assert [r[0] for r in pre] == ["no description", "no description", "see and now ok"]


def test_text_queries_on_all_documents(spark, tmp_path):
    texts = [
        None, "", " \u00a0\x1f\n", "plain one. Two!", "Größe\u00a0über 日本。 ﬁne Ⅷ x² ٣ é e\u0301 mail\u2003ä@ö.de\u2003now", "\u2003see http://ä.b/ö\u3000end?\n", "www.a\u00a0the İstanbul the istanbul 😀!",
        "\x1cone\x1dtwo... \u2003 !three",
    ]
    rows = [(i, t, "de" if i % 2 else "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {k: [r.asDict() for r in QUERIES[f"{k}_all"](spark, str(tmp_path)).collect()] for k in ("X01_preprocess_text", "X02_text_stats", "X03_text_stats_eda", "X04_text_stats_serving", "X05_tokenize", "X06_word_frequency", "X06_word_frequency_by_class")}
    by = {k: {r["doc_id"]: r for r in v} for k, v in got.items() if not k.startswith("X06")}
    counts = {lang: Counter() for lang in ("", "de", "en")}
    for i, raw, lang in rows:
        t = raw or ""
        clean = re.sub(r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.-]+", " ", re.sub(r"<[^>]+>", " ", t))
        clean = unicodedata.normalize("NFKD", re.sub(r"\s+", " ", clean).strip())
        assert by["X01_preprocess_text"][i]["text"] == (clean if clean.strip() else "no description")
        w, n, parts = t.split(), max(1, len(t)), re.split(r"[.!?]+", t)
        want = (len(t), len(w), len(parts), sum(map(len, w)) / max(1, len(w)), len(re.findall("[A-Z]", t)) / n, len(re.findall(r"[^\w\s]", t)) / n, len(re.findall(r"\d", t)) / n)
        assert tuple(by["X02_text_stats"][i].values())[1:] == pytest.approx(want, abs=1e-6), i
        assert tuple(by["X03_text_stats_eda"][i].values())[1:] == (len(t), len(w), len(parts) - 1)
        s = t.strip()
        want = (len(s), max(1, sum(bool(p.strip()) for p in re.split(r"[.!?]+", s))), sum(not c.isalnum() and not c.isspace() for c in s) / max(1, len(s))) if s else (0, 0, 0)
        assert tuple(by["X04_text_stats_serving"][i].values())[1:] == pytest.approx(want, abs=1e-6), i
        tokens = [x for x in re.findall("[a-z]+", t.lower()) if len(x) > 1 and x not in T.STOP_WORDS]
        assert by["X05_tokenize"][i]["tokens"] == (None if raw is None else tokens)
        counts[""].update(tokens)
        counts[lang].update(tokens)
    top = lambda c, k: sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert [(r["token"], r["n"]) for r in got["X06_word_frequency"]] == top(counts[""], 30)
    assert {(r["lang"], r["token"], r["n"], r["rank"]) for r in got["X06_word_frequency_by_class"]} == {(lang, t, n, k + 1) for lang in ("de", "en") for k, (t, n) in enumerate(top(counts[lang], 10))}


def test_text_checks(spark):
    long = "This listing is well described and the photos are clear, so it should do well. "
    rows = [("", 1), ("short", 1), (long + "text_emb_3", 1), (long + "Expect one month.", 1), (long + "Expect one week, not one month.", 1), (long, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, c int").select(T.explanation_reason("t", "c")).collect()]
    assert got == ["empty", "too short", "raw name", "different class", None, None]
    d = [(None, "dog"), ("w " * 5, "dog"), ("w " * 120, "dog"), ("puppy " * 120, "dog"), ("w " * 500, ""), ("w " * 120, "")]
    assert [r[0] for r in spark.createDataFrame(d, "t string, p string").select(T.description_reason("t", "p")).collect()] == ["empty", "too short", "pet type missing", None, "too long", None]


def test_documents_with_missing_parts(spark):
    rows = [("a", "{}"), ("b", '{"documentSentiment":{"score":0.5},"sentences":[{"sentiment":{"score":1}},{}],"entities":[{"name":"X"},{"name":"Y","type":"T","salience":0.5}],"language":"en"}'), ("c", "no json")]
    out = {r["k"]: r for r in D.sentiment_features(D.parsed(spark.createDataFrame(rows, "k string, j string"), "j", D.SENTIMENT), "k").collect()}
    assert out["a"]["score"] == 0 and out["a"]["language"] == "" and out["c"]["n_sentences"] == 0
    assert (out["b"]["mean_sentence_score"], out["b"]["sentiment_variance"], out["b"]["entity_type_count"]) == (0.5, 0.25, 2)
    v = D.vision_features(D.parsed(spark.createDataFrame(rows[:1], "k string, j string"), "j", D.VISION), "k")
    assert one(v)["top_label"] == "" and D.vision_by_key(v.where("false"), "k").columns == ["k", *[f"mean_{c}" for c in ("n_labels", "top_score", "n_colors", "brightness", "brightness_std", "crop_confidence")]]


def test_quality_both_outcomes(spark):
    spec = Q.Contract((Q.ColumnSpec("a", "bigint", valid=(1, 2)), Q.ColumnSpec("b", "double", nullable=True, least=0)))
    df = spark.createDataFrame([(1, 1.0), (None, -1.0), (3, None)], "a bigint, b double")
    bad = {r["column"]: r["n_bad"] for r in Q.check_domains(df, spec).collect()}
    assert bad == {"a": 2, "b": 1}  # a null breaks a set and passes a range
    assert {r["column"]: r["severity"] for r in Q.check_nulls(df, spec).collect()} == {"a": "critical", "b": "expected"}
    assert spec.required() == ["a"] and [f.name for f in spec.schema()] == ["a", "b"] and spec["b"].least == 0
    dup = one(Q.check_duplicates(spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int"), "k"))
    assert (dup["total"], dup["n_distinct"], dup["n_duplicates"], dup["n_repeated"]) == (4, 2, 2, 1)
    p = spark.createDataFrame([(0.5, 0.5), (1.5, -0.5), (0.2, 0.2)], "p double, q double")
    r = one(Q.check_probabilities(p, ["p", "q"]))
    assert (r["n_outside"], r["n_bad_sum"], r["passed"]) == (1, 1, False)
    assert one(Q.check_probabilities(p.limit(1), ["p", "q"]))["passed"]


def test_statistics_against_numpy(spark):
    x = np.array([1.0, 2, 2, 3, 9, 11])
    df = spark.createDataFrame([(i, float(v), float(v) ** 2) for i, v in enumerate(x)], "i int, x double, y double")
    n, z = len(x), (x - x.mean()) / x.std()
    r = one(S.describe(df, ["x"]))
    assert math.isclose(r["skew"], (z**3).mean() * math.sqrt(n * (n - 1)) / (n - 2), abs_tol=1e-4) and r["std"] == round(x.std(ddof=1), 4)
    assert one(S.spearman(df, "i", ["x", "y"]))["r"] == 1.0
    two = spark.createDataFrame([("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 7, "a string, b string")
    o = np.array([[8, 2], [3, 7]])
    e = o.sum(1, keepdims=True) * o.sum(0) / 20
    chi = ((np.abs(o - e) - 0.5) ** 2 / e).sum()
    assert math.isclose(one(S.cramers_v(two, [("a", "b")]))["chi2"], chi, abs_tol=1e-4)
    assert one(S.cramers_v(two.withColumn("b", F.lit("x")), [("a", "b")]))["v"] == 0


def test_evaluation_ties_and_zero_division(spark):
    p = spark.createDataFrame([(1, 0.4, 0.4, 0.2), (2, 0.0, 0.0, 1.0)], "k int, p0 double, p1 double, p2 double")
    r = {x["k"]: x for x in E.scored(p, ["p0", "p1", "p2"], (0.8, 1.6)).collect()}
    assert r[1]["argmax"] == 0 and r[1]["predicted"] == 1 and r[2]["predicted"] == 2 and r[1]["confidence"] == 0.4
    y = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "y int, yhat int")
    m = {x["cls"]: x for x in E.per_class(E.confusion(y, "y", "yhat", (0, 1, 2))).collect()}
    assert m[1]["precision"] == 0 and m[1]["f1"] == 0 and m[0]["recall"] == 1
    assert one(E.quadratic_kappa(y.where("y = yhat"), "y", "yhat"))["kappa"] is None
    cuts, best = E.optimize_thresholds(spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.3), (3, 0.4), (4, 0.5)] * 3, "y int, ev double"), "y", "ev")
    assert best == 1.0 and cuts == sorted(cuts)
    ranked = E.rank_candidates(spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.5), (3, "b", 0.1)], "trial int, f string, s double"), "f", "s").collect()
    assert sorted((r["trial"], r["rank"], r["best_of_family"]) for r in ranked) == [(1, 1, True), (2, 1, False), (3, 3, True)]


def test_folds_are_balanced_and_repeatable(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    a, b = (E.stratified_folds(d, "k", "y", 5) for d in (df, df.repartition(7)))
    assert a.exceptAll(b).isEmpty()
    n = a.groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in n) and all(r["balanced"] for r in E.fold_balance(a, "y").collect())


def test_collapse_conserves_totals_and_shares(spark):
    rows = [(r, 0, f"{p}_emb_{i}", 0.0, (-1.0) ** i * (i + r)) for r in (1, 2) for p in ("img", "text") for i in range(4)] + [(1, 0, "log_fee", 0.0, 2.0), (2, 0, "odd", 0.0, 0.0)]
    long = spark.createDataFrame(rows, "row_id int, cls int, feature string, value double, contribution double")
    present = spark.createDataFrame([(1, "image", False), (2, "image", True)], "row_id int, modality string, is_present boolean")
    out = A.collapse_latent(long, A.registry(long.select("feature").distinct()), present)
    total = {r["row_id"]: r["s"] for r in out.groupBy("row_id").agg(F.sum("magnitude").alias("s")).collect()}
    want = {r: sum(abs(x[4]) for x in rows if x[0] == r) for r in (1, 2)}
    assert total == want
    assert all(abs(r["s"] - 1) < 1e-5 for r in out.groupBy("row_id").agg(F.sum("share").alias("s")).collect())
    assert out.where("is_baseline and share > 0").isEmpty()
    recs = A.recommend(out).groupBy("row_id").count().collect()
    assert all(r["count"] == 5 for r in recs)


def test_images_and_files(spark, tmp_path):
    ship(spark)
    rng = np.random.default_rng(1)
    pics = {}
    for name, (h, w) in {"cat-1": (5, 7), "cat-2": (6, 4), "dog-1": (3, 3)}.items():
        pics[name] = rng.integers(0, 256, (h, w, 3))
        (tmp_path / f"{name}.png").write_bytes(I.png(h, w, pics[name]))
    (tmp_path / "bad-1.png").write_bytes(b"no image")
    stats = {r["file"]: r for r in I.image_stats(I.scan_images(spark, str(tmp_path))).collect()}
    assert set(stats) == {"cat-1.png", "cat-2.png", "dog-1.png"}
    for name, rgb in pics.items():
        g = (299 * rgb[:, :, 0] + 587 * rgb[:, :, 1] + 114 * rgb[:, :, 2]) // 1000
        r = stats[f"{name}.png"]
        assert (r["height"], r["width"]) == g.shape and math.isclose(r["brightness"], round(g.mean(), 2), abs_tol=0.011)
    by = {r["key"]: r for r in I.quality_by_key(I.image_stats(I.scan_images(spark, str(tmp_path)))).collect()}
    assert by["cat"]["area_std"] == 5.5 and by["dog"]["area_std"] == 0
    assert {r["key"]: (r["n"], r["files"]) for r in IO.files_by_key(spark, str(tmp_path)).collect()}["cat"] == (2, ["cat-1.png", "cat-2.png"])
    inv = one(IO.file_inventory(spark, str(tmp_path)))
    assert (inv["extension"], inv["n_files"]) == (".png", 4)


def test_json_files_and_splits(spark, tmp_path):
    for name, text in {"p-1.json": '{\n"a": 1}', "x-y-12.json": '{"a": 2}', "bad.json": "{oops"}.items():
        (tmp_path / name).write_text(text)
    rows = IO.split_index(IO.scan_keyed_json(spark, str(tmp_path), "a int")).collect()
    assert {(r["key"], r["image_index"], r["a"]) for r in rows} == {("p", 1, 1), ("x-y", 12, 2)}
    with pytest.raises(ValueError):
        IO.scan_listings(spark, "/x", "valid", "a int")
    with pytest.raises(ValueError):
        IO.write_submission(spark.createDataFrame([(1, 9)], "k int, c int"), "k", "c", str(tmp_path / "out"))
    assert IO.missing_keys({"a": 1}, ["a", "b"]) == ["b"]


def test_feature_set_differences(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    IO.write_feature_set(df, str(tmp_path), "text", "v1", "train")
    rows, gaps = IO.scan_feature_set(spark, str(tmp_path), "text", "v1", "train")
    assert rows.columns == ["k", "v"] and gaps.isEmpty()


def test_pool_and_scale(spark):
    v = spark.createDataFrame([("a", [1.0, 5.0]), ("a", [3.0, -1.0])], "k string, v array<double>")
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    out = {r["k"]: r for r in I.pool_vectors(v, "k", "v", keys).collect()}
    assert out["a"]["pooled"] == [2.0, 2.0] and (out["b"]["pooled"], out["b"]["has_vector"], out["b"]["n_vectors"]) == ([], 0, 0)
    with pytest.raises(ValueError):
        I.pool_vectors(v, "k", "v", how="median")


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(100, 1, (60, 4)) * [5, 3, 1, 0.1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    out, var = I.pca(df, df, "v", 2)
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    got = np.array([r["scores"] for r in out.orderBy("i").collect()])
    assert np.allclose(np.abs(got), np.abs(c @ vt[:2].T), atol=1e-6) and np.allclose(var, (s**2 / (s**2).sum())[:2])


def test_ablation_and_search_score_every_fold(spark, monkeypatch):
    ids = spark.range(10).select(F.col("id").alias("listing_id"), (F.col("id") % 5).alias("fold"))

    def scored(rows, folds, family, columns=M.FEATURES, k=5, **settings):
        parts = folds.where(F.col("fold") < k).select("fold").distinct()
        return None, parts.select("fold", F.lit("valid").alias("part"), F.col("fold").cast("double").alias("kappa"))

    monkeypatch.setattr(M, "cross_validate", scored)
    assert [r["kappa"] for r in M.ablation(ids, ids, {"all": M.FEATURES, "age": ["age"]}, "tree").collect()] == [2.0, 2.0]
    assert [r["score"] for r in M.search(ids, ids, 2).collect()] == [2.0, 2.0]


def test_linear_attributions_explain_the_margin(spark, sf_dir):
    from pelago.plans.base import Tables

    rows = M.model_rows(Tables(spark, sf_dir).listings_v)
    model = M.learner("linear").fit(M.assembled(rows))
    sums = M.linear_attributions(model, rows).groupBy("row_id", "cls").agg(F.sum("contribution").alias("s")).where("cls = 0")
    assert abs(sums.agg(F.avg("s")).first()[0]) < 1e-6
    with pytest.raises(ValueError):
        M.learner("unknown")


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double, props string"
    stream = R.node_events(R.event_stream(spark, str(tmp_path / "in"), "*.parquet", schema))
    got = R.run_to_table(R.node_metrics(stream), str(tmp_path / "out"))
    want = R.node_metrics(R.node_events(raw))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double, props string"
    for i, ts in enumerate(["2024-01-01 00:00:10", "2024-01-01 02:00:00", "2024-01-01 00:00:20", "2024-01-01 04:00:00"]):
        spark.sql(f"SELECT {i + 1}L AS event_id, 1L AS user_id, timestamp_ntz'{ts}' AS ts, 'view' AS event_type, 1.0D AS value, '' AS props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = R.windowed_metrics(R.node_events(R.event_stream(spark, str(tmp_path / "in"), "*.parquet", schema)), "1 minute", late="10 minutes")
        q = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r["executions"] for r in rows if r["window_start"].hour == 0] == [1]  # restarted from its checkpoint, the late row is gone


def test_session_state_keeps_payload(spark):
    rows = [(1, "2024-01-01 00:00:00", 1, "pending", None), (1, "2024-01-01 00:00:05", 2, "complete", 7.0), (1, "2024-01-01 00:00:09", 3, None, None), (2, "2024-01-01 00:20:00", 4, "error", None)]
    df = spark.createDataFrame(rows, "session_id bigint, ts string, event_id bigint, status string, payload double").withColumn("ts", F.col("ts").cast("timestamp"))
    state = R.session_state(df)
    got = {r["session_id"]: (r["status"], r["payload"]) for r in state.collect()}
    assert got == {1: ("complete", 7.0), 2: ("error", None)}
    live = R.live_sessions(state, F.lit("2024-01-01 00:20:30").cast("timestamp"))
    assert [r["session_id"] for r in live.collect()] == [2]


def test_stateful_stream_equals_batch(spark, sf_dir, tmp_path):
    import time

    ship(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 5 = 0")
    raw.repartition(1).write.parquet(str(tmp_path / "in"))
    schema = "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double, props string"
    stream = R.stateful_sessions(R.session_updates(R.node_events(R.event_stream(spark, str(tmp_path / "in"), "*.parquet", schema))))
    want = {r["session_id"]: (r["status"], r["payload"]) for r in R.session_state(R.session_updates(R.node_events(raw))).collect()}
    # time-outs keep such a query busy, so it is stopped when its first result is there
    q = stream.writeStream.outputMode("update").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 90
    while time.time() < until and spark.table("sessions").count() < len(want):
        time.sleep(1)
    q.stop()
    assert {r["session_id"]: (r["status"], r["payload"]) for r in spark.table("sessions").collect()} == want


def test_running_counts(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, 500)
    df = spark.createDataFrame([(int(v), int(v) % 2) for v in x], "v int, g int").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in S.running_counts(df, "v", "n", ["g"], buckets=7).collect():
        assert r["_below"] == ((x % 2 == r["g"]) & (x < r["v"])).sum()


#: The ten end-to-end requests (name of the case, type, name, age, breed2, vaccinated, quantity, fee, text).
SCENARIOS = [
    ("typical_dog_with_description", 1, "Buddy", 3, 0, 1, 1, 0.0, "Buddy is a friendly dog."), ("typical_cat_no_description", 2, "Whiskers", 6, 0, 1, 1, 50.0, ""),
    ("fully_documented_pet", 1, "Max", 12, 264, 1, 1, 0.0, "Max is house-trained."), ("minimal_input", 2, "", 1, 0, 3, 1, 0.0, ""),
    ("high_fee_unvaccinated", 1, "Rex", 24, 0, 2, 1, 500.0, "Rex."), ("young_puppy_healthy", 1, "Luna", 1, 0, 1, 1, 0.0, "Luna."),
    ("senior_cat_health_issues", 2, "Grandpa", 120, 0, 1, 1, 200.0, "Grandpa."), ("multiple_pets_listing", 2, "The Three Amigos", 2, 0, 2, 3, 0.0, "Three."),
    ("whitespace_only_description", 1, "Shadow", 8, 0, 1, 1, 30.0, "    \n\t   \n  "), ("very_long_description", 2, "Cleopatra", 36, 0, 1, 1, 0.0, "long " * 2000),
]


def test_ten_requests(spark):
    rows = [(c, {1: "Dog", 2: "Cat"}[t], n, a, b, {1: "Yes", 2: "No", 3: "Not Sure"}[v], q, f, x, 0) for c, t, n, a, b, v, q, f, x in SCENARIOS]
    df = spark.createDataFrame(rows, "listing_id string, pet_type string, name string, age int, breed2 int, vaccinated string, quantity int, fee double, text string, images int")
    coded = {r["listing_id"]: r for r in X.encode_request(df).collect()}
    assert all(r["valid"] for r in coded.values()) and coded["minimal_input"]["name"] is None and coded["minimal_input"]["vaccinated"] == 3
    assert coded["typical_dog_with_description"]["breed2"] is None and coded["fully_documented_pet"]["breed2"] == 264
    made = {r["listing_id"]: r for r in A.availability(df, "text", "images").withColumns({"bin": X.right_closed_bin("age"), "unit": X.per_unit("fee", "quantity")}).collect()}
    assert {k for k, r in made.items() if not r["has_text"]} == {"typical_cat_no_description", "minimal_input", "whitespace_only_description"}
    assert not any(r["has_image"] for r in made.values())
    assert [made[c[0]]["bin"] for c in SCENARIOS] == [1, 2, 3, 0, 4, 0, 6, 1, 3, 5]
    stats = {r["listing_id"]: r for r in T.text_stats(df, "text", "serving").collect()}
    assert stats["whitespace_only_description"]["word_count"] == 0 and stats["very_long_description"]["word_count"] == 2000


def test_request_domains(spark):
    rows = [(1, 3, 0.0, 1, 0, " ", "Dog", "Yes"), (2, 300, 0.0, 1, 4, "Rex", "Cat", "No"), (3, 1, -1.0, 1, 4, "Rex", "Cat", "No"), (4, 1, 1.0, 0, 4, "Rex", "Bird", "Not Sure")]
    out = {r["listing_id"]: r for r in X.encode_request(spark.createDataFrame(rows, "listing_id int, age int, fee double, quantity int, breed2 int, name string, pet_type string, vaccinated string")).collect()}
    assert [out[i]["valid"] for i in (1, 2, 3, 4)] == [True, False, False, False] and out[1]["name"] is None and out[1]["breed2"] is None and out[4]["type"] is None


def test_text_patterns_are_linear(spark):
    import time

    hostile = ["a" * 1_000_000, "<" * 500_000, "a@" * 400_000, " " * 500_000 + "b" + " " * 500_000 + "c", "<b " * 300_000 + ">x", "." * 500_000 + "@" * 500_000]
    df = spark.createDataFrame([(x,) for x in hostile], "t string").coalesce(1)
    df.select(T.preprocess("t")).count()
    began = time.perf_counter()
    got = [r[0] for r in df.select(T.preprocess("t").alias("t"), C.strip("t").alias("s")).collect()]
    T.text_stats(df, "t", "serving").collect()
    assert time.perf_counter() - began < 20
    assert got[0] == hostile[0] and got[1] == hostile[1] and got[3] == "b c" and got[4] == "x"


def test_preprocess_makes_each_step_once(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(T.preprocess("t").alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 3


def test_addresses_and_tags_as_the_plain_patterns_have_them(spark):
    import random
    import re

    rng = random.Random(7)
    texts = ["".join(rng.choice("a@.< >b\n+-_:,w/") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["Call me:joe@x.com, or (ann@y.org). Thanks", "a@b.c+d@e.f", "www.a@b.c", "x:http://q.de/a@b.c y", "ä@ö.de;e\u0301@x.y"]
    want = []
    for x in texts:
        x = re.sub(r"<[^>]+>", " ", x)
        x = re.sub(r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.-]+", " ", x)
        want.append(unicodedata.normalize("NFKD", re.sub(r"\s+", " ", x).strip()) or T.PLACEHOLDER)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, t string")
    assert [r[0] for r in df.orderBy("i").select(T.preprocess("t")).collect()] == want


def test_probabilities_of_paired_tests(spark):
    assert abs(E.t_probability(2.776445, 4) - 0.05) < 1e-6 and abs(E.t_probability(1.959964, 10_000_000) - 0.05) < 1e-5
    assert abs(E.t_probability(-12.7062, 1) - 0.05) < 1e-6 and E.t_probability(0.0, 7) == 1.0
    below = sum(sum(i + 1 for i in range(10) if signs >> i & 1) <= 15 for signs in range(1 << 10))
    assert E.signed_rank_probability(0, 5, 0) == 0.0625 and E.signed_rank_probability(15, 10, 0) == 2 * below / 1024
    rows = [("p", float(i), float(i) - d) for i, d in enumerate([1, 2, 3, 4, 5, -6, 7, 8])] + [("q", 1.0, 1.0), ("q", 2.0, 2.0)]
    out = {r.pair: r for r in E.paired_tests(spark.createDataFrame(rows, "pair string, a double, b double"), "pair", "a", "b").collect()}
    assert out["p"].w == 6 and abs(out["p"].p_w - 2 * 14 / 256) < 1e-9 and abs(out["p"].t - 3 / (np.std([1, 2, 3, 4, 5, -6, 7, 8], ddof=1) / 8**0.5)) < 1e-9 and 0.09 < out["p"].p_t < 0.1
    assert out["q"].t is None and out["q"].p_w == 1.0


def test_models_over_folds(spark, sf_dir):
    """M05, M16, M18, M19 on real folds: every row is scored once, and the sums agree."""
    from pelago.plans.base import Tables

    t = Tables(spark, sf_dir)
    rows, folds = M.model_rows(t.listings_v).cache(), E.stratified_folds(t.listings_v, "listing_id", "speed", 2).cache()
    oof, metrics = M.cross_validate(rows, folds, "tree", k=2)
    assert oof.count() == rows.count() == oof.select("listing_id").distinct().count()
    assert oof.where("abs(p0 + p1 + p2 + p3 + p4 - 1) > 1e-9").isEmpty() and metrics.count() == 4
    each = M.fold_metrics(rows, folds, "tree", k=2).collect()
    assert sum(r.n for r in each) == rows.count() and all(len(r.cuts) == 4 and sorted(r.cuts) == r.cuts and -1 <= r.kappa <= 1 and 0 <= r.macro_f1 <= 1 for r in each)
    by_fold = {r.fold: r.kappa for r in metrics.where("part = 'valid'").collect()}
    assert all(abs(by_fold[r.fold] - r.kappa) < 1e-9 for r in each)  # both at cuts of the training rows
    totals = {r.metric: r for r in M.fold_summary(M.fold_metrics(rows, folds, "tree", k=2)).collect()}
    assert abs(totals["accuracy"]["mean"] - sum(r.accuracy for r in each) / 2) < 1e-6
    assert {r.subset for r in M.ablation(rows, folds, {"all": M.FEATURES, "care": ["vaccinated"]}, "tree", k=2).collect()} == {"all", "care"}
    stacked = M.stack([oof, M.cross_validate(rows, folds, "linear", k=2)[0]], rows.select("listing_id", "y"))
    assert stacked.count() == rows.count() and stacked.where("p0 is null").isEmpty()
    found = M.search(rows, folds, 2, k=2).collect()
    assert len(found) == 2 and found[0].score >= found[1].score
    curve = {r.share: r for r in M.learning_curve(rows, folds, "tree", (0.5, 1.0), 2).collect()}
    assert curve[1.0].n_train == curve[1.0].n_valid == rows.count() > curve[0.5].n_train > 0 and curve[0.5].n_folds == 2
    valid = [r.kappa for r in metrics.where("part = 'valid'").collect()]
    assert abs(curve[1.0].mean_valid - sum(valid) / 2) < 1e-9 and abs(curve[1.0].std_valid - abs(valid[0] - valid[1]) / 2**0.5) < 1e-9


def test_one_pass_scores_all_models_as_single_passes_do(spark):
    """The kappas of several models from one count of their scored rows, and the same from each on its own; a tie lies on a cut, one value is no number."""
    rows = spark.range(400).select(
        F.col("id").alias("listing_id"), (F.col("id") * 7 % 5).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("fold"),
        *[(F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(9)) / 4).alias(c) for c in M.FEATURES],
    ).withColumn("age", F.when(F.col("listing_id") == 3, float("nan")).otherwise(F.col("age")))
    data = M.assembled(rows).cache()
    models = [M.learner("tree").fit(data.where("listing_id <> 3")), M.Linear([[0.3 * k] * 8 for k in range(5)], [0.1] * 5), M.Linear([[0.0] * 8] * 5, [0.0] * 5)]
    parts = [F.when(F.col("fold") == f, "valid").when(F.col("fold") != 3, "train") for f in range(3)]
    scores, cuts = M._kappas(models, data, parts)
    got = {(r["model"], r["part"]): (r["n"], r["kappa"]) for r in E.quadratic_kappa(scores, "y", "predicted", ["model", "part"], "n").collect()}
    at = {r["model"]: r["cuts"] for r in cuts.collect()}
    for i, (model, part) in enumerate(zip(models, parts, strict=True)):
        own = M.probabilities(model, data.withColumn("part", part)).withColumn("ev", E.expected_value(M.P))
        best, _ = E.optimize_thresholds(own.where("part = 'train'"), "y", "ev")
        want = E.quadratic_kappa(E.scored(own, M.P, best).where("part is not null"), "y", "predicted", ["part"]).collect()
        assert at[i] == best and {p: v for (k, p), v in got.items() if k == i} == {r["part"]: (r["n"], r["kappa"]) for r in want}
    edges = spark.createDataFrame([(c * 4 / 200,) for c in range(201)] + [(c * 4 / 200 - 1e-15,) for c in range(201)] + [(float("nan"),)], "ev double")
    plain = E.by_thresholds(F.col("ev"), [c * 4 / 200 for c in range(1, 201)])
    assert edges.where(E.cuts_reached("ev") != plain).isEmpty()


def test_normal_forms_hold_few_strings_at_once():
    import tracemalloc

    import pyarrow as pa

    texts = [None, "", "plain", "Größe ﬁne Ⅷ", "é"] + ["ä" * 2000] * 4000
    column = pa.array(texts, pa.string())
    tracemalloc.start()
    got = C._normal_form("NFKD", column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [x and unicodedata.normalize("NFKD", x) for x in texts] and peak < 4 << 20
    assert C._normal_form("NFC", pa.array([], pa.string())).to_pylist() == []


def test_contributions_are_gathered_in_parts_by_their_number(spark, monkeypatch):
    rows = [(i % 40, i % 3, f"text_emb_{i % 4}" if i % 2 else "log_fee", 0.1 * i - 9) for i in range(200)]
    long = spark.createDataFrame(rows, "row_id long, cls int, feature string, contribution double")
    present = spark.createDataFrame([(i, "text", i % 3 > 0) for i in range(40)], "row_id long, modality string, is_present boolean")
    reg = A.registry(long.select("feature").distinct())
    want = sorted(map(tuple, A.collapse_latent(long, reg, present).collect()))
    assert {r[0] for r in want if r[6]} == {i for i in range(1, 40, 2) if i % 3 == 0}
    monkeypatch.setattr(A, "TASK_ROWS", 10)
    out = A.collapse_latent(long, reg, present)
    assert out.rdd.getNumPartitions() == 20 and sorted(map(tuple, out.collect())) == want
