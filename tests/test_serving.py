"""The serving path against plain Python, boosted trees against a plain loop, and searches against brute force."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelago.functions import images as I
from pelago.operators import evaluation as E
from pelago.operators import features as X
from pelago.operators import joins
from pelago.operators import models as M
from pelago.operators import serving as S
from pelago.operators import stats
from pelago.plans import q_serving as Q
from pelago.plans import registry
from pelago.plans.base import Tables
from pelago.streaming import runs as R

FORM = "request_id int, owner_id int, pet_type string, name string, age_months int, gender string, breed1 int, breed2 int, color1 int, color2 int, color3 int, maturity_size int, fur_length int, vaccinated string, dewormed string, sterilized string, health string, fee double, quantity int, state int, video_amt int, photos int"
GOOD = (1, 7, "Dog", "Rex the Dog", 4, "Male", 10, 0, 1, 2, 0, 2, 1, "Yes", "No", "Not Sure", "Healthy", 25.0, 2, 5, 0, 3)


def form(**changes):
    names = [c.split()[0] for c in FORM.split(", ")]
    return tuple((dict(zip(names, GOOD, strict=True)) | changes).values())


def plain_features(t, shares, defaults):
    """The serving features of one coded request, one after another."""
    care = {1: 1, 2: 0, 3: -1}
    dog, b2, c2, c3 = int(t["pet_type"] == 1), t["breed2"] or 0, t["color2"] or 0, t["color3"] or 0
    named = bool(t["name"] and t["name"].strip())
    age_bin = next((i for i, (lo, hi) in enumerate(zip(X.AGE_EDGES, X.AGE_EDGES[1:], strict=False)) if lo <= t["age_months"] <= hi), 6)
    return {
        "is_dog": dog, "Gender": t["gender"], "MaturitySize": t["maturity_size"], "FurLength": t["fur_length"], "Health": t["health"], "Vaccinated": care[t["vaccinated"]], "Dewormed": care[t["dewormed"]],
        "Sterilized": care[t["sterilized"]], "health_care_score": sum(t[c] == 1 for c in ("vaccinated", "dewormed", "sterilized")), "Age": t["age_months"], "log_age": math.log1p(t["age_months"]), "age_bin": age_bin,
        "Fee": t["fee"], "log_fee": math.log1p(t["fee"]), "is_free": int(t["fee"] == 0), "fee_per_pet": t["fee"] / max(t["quantity"], 1), "Quantity": t["quantity"], "log_quantity": math.log1p(t["quantity"]),
        "is_single_pet": int(t["quantity"] == 1), "PhotoAmt": t["photos"], "log_photo_amt": math.log1p(t["photos"]), "has_photos": int(t["photos"] > 0), "VideoAmt": t["video_amt"], "has_video": int(t["video_amt"] > 0),
        "has_name": int(named), "name_length": len(t["name"]) if named else 0, "name_word_count": len(t["name"].split()) if named else 0, "Breed1": t["breed1"], "Breed2": b2, "is_mixed_breed": int(b2 != 0),
        "breed_count": 1 + (b2 != 0), "breed1_frequency": shares["breed1"].get(t["breed1"], defaults["breed1_frequency"]), "Color1": t["color1"], "Color2": c2, "Color3": c3,
        "color_count": sum(c != 0 for c in (t["color1"], c2, c3)), "breed2_missing": int(b2 == 0), "color2_missing": int(c2 == 0), "color3_missing": int(c3 == 0), "age_x_type": t["age_months"] * dog,
        "health_x_vaccinated": t["health"] * care[t["vaccinated"]], "rescuer_pet_count": defaults["rescuer_pet_count"], "rescuer_mean_photo_amt": defaults["rescuer_mean_photo_amt"],
        "rescuer_mean_fee": defaults["rescuer_mean_fee"], "state_freq": shares["state"].get(t["state"], defaults["state_freq"]),
    }


def test_forms_are_coded_or_rejected(spark):
    bad = {"pet_type": "Bird", "age_months": 256, "gender": None, "breed1": None, "maturity_size": 5, "fur_length": 0, "vaccinated": "yes", "dewormed": None, "sterilized": "", "health": "Fine", "fee": -0.5, "quantity": 0, "video_amt": -1}
    rows = [form()] + [form(request_id=10 + i, **{c: v}) for i, (c, v) in enumerate(bad.items())]
    rows += [form(request_id=2, age_months=-1, quantity=0), form(request_id=3, name="  ", breed2=None, color1=None, fee=None, quantity=None, state=None, video_amt=None, photos=None), form(request_id=4, age_months=255)]
    out = {r["request_id"]: r for r in S.encode_forms(spark.createDataFrame(rows, FORM)).collect()}
    assert [out[10 + i]["rejects"] for i in range(len(bad))] == list(bad)
    assert out[2]["rejects"] == "age_months,quantity" and out[1]["rejects"] == out[3]["rejects"] == out[4]["rejects"] == ""
    one = out[1]
    assert (one["pet_type"], one["gender"], one["vaccinated"], one["dewormed"], one["sterilized"], one["health"], one["breed2"], one["color2"], one["color3"]) == (1, 1, 1, 2, 3, 1, None, 2, None)
    assert (out[3]["name"], out[3]["fee"], out[3]["quantity"], out[3]["photos"], out[3]["color1"]) == (None, 0.0, 1, 0, 0)


def test_request_features_as_the_plain_steps_have_them(spark):
    train = [form(request_id=i, owner_id=i % 3, breed1=10 + i % 2, state=i % 4, fee=float(i), photos=i % 5) for i in range(12)]
    coded = S.encode_forms(spark.createDataFrame(train, FORM))
    state = S.fit_state(coded).persist()
    rows = [r.asDict() for r in coded.collect()]
    n = len(rows)
    shares = {k: {v: sum(r[k] == v for r in rows) / n for v in {r[k] for r in rows}} for k in ("breed1", "state")}
    groups = {o: [r for r in rows if r["owner_id"] == o] for o in {r["owner_id"] for r in rows}}
    mean = lambda f: sum(f(r) for r in rows) / n
    of = lambda r, c: sum(x[c] for x in groups[r["owner_id"]]) / len(groups[r["owner_id"]])
    defaults = {
        "breed1_frequency": mean(lambda r: shares["breed1"][r["breed1"]]), "state_freq": mean(lambda r: shares["state"][r["state"]]), "rescuer_pet_count": mean(lambda r: len(groups[r["owner_id"]])),
        "rescuer_mean_photo_amt": mean(lambda r: of(r, "photos")), "rescuer_mean_fee": mean(lambda r: of(r, "fee")),
    }
    asked = [form(request_id=i, age_months=a, breed1=b, state=s, name=nm, fee=f, quantity=q) for i, (a, b, s, nm, f, q) in enumerate(itertools.product((0, 1, 3, 7, 255), (10, 99), (1, 77), ("", " A b c "), (0.0, 9.5), (1, 3)))]
    codes = S.encode_forms(spark.createDataFrame(asked, FORM))
    got = {r["request_id"]: r.asDict() for r in S.request_features(codes, state).collect()}
    assert len(S.FEATURES) == len(set(S.FEATURES)) == 45
    for r in codes.collect():
        want = plain_features(r.asDict(), shares, defaults)
        assert list(want) == S.FEATURES
        assert {c: got[r["request_id"]][c] for c in want} == pytest.approx(want), r
    # without training rows: the fixed defaults
    none = S.request_features(codes, S.fit_state(coded.where("1 = 0"))).first()
    assert (none["breed1_frequency"], none["state_freq"], none["rescuer_pet_count"], none["rescuer_mean_photo_amt"]) == (0.001, 0.02, 1.0, 3.0)
    state.unpersist()


def test_stream_equals_batch_with_rejects(spark, sf_dir, tmp_path):
    """Several micro-batches; the stream's plan keeps no state and shuffles nothing by the model."""
    t = Tables(spark, sf_dir)
    forms = t.forms_v.withColumn("f", F.col("request_id") % 3)
    forms.write.partitionBy("f").parquet(f"{tmp_path}/in")
    stream = R.event_stream(spark, f"{tmp_path}/in/f=*", "*.parquet", forms.drop("f").schema)
    state = Q.fitted_state(t, Q.FITTED)
    scores, rejects = S.serve_stream(stream, state, Q.score, f"{tmp_path}/out")
    coded = S.encode_forms(t.forms_v)
    batch = Q.score(S.request_features(coded.where("rejects = ''"), state))
    rows = lambda d, *c: sorted(tuple(r) for r in d.select(*c).collect())
    assert rows(scores, "request_id", "predicted", "expected_value") == rows(batch, "request_id", "predicted", "expected_value")
    assert rows(rejects, "request_id", "rejects") == rows(coded.where("rejects <> ''"), "request_id", "rejects") != []
    assert spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() > 2
    empty = S.serve_stream(R.event_stream(spark, f"{tmp_path}/in/f=0", "none*.parquet", forms.drop("f").schema), state, Q.score, f"{tmp_path}/empty")
    assert [d.count() for d in empty] == [0, 0]


def test_changes_against_a_plain_loop(spark, sf_dir):
    t = Tables(spark, sf_dir)
    state = Q.fitted_state(t, Q.FITTED)
    coded = S.encode_forms(t.forms_v).where("rejects = ''").drop("submitted").orderBy("request_id").limit(60).persist()
    rows = [r.asDict() for r in coded.collect()]
    shares = {k: {r["key"]: r["value"] for r in state.where("key is not null").collect() if r["feature"] == f} for f, k in S.SHARES.items()}
    defaults = {r["feature"]: r["value"] for r in state.where("key is null").collect()}

    def scored(row):
        f = plain_features(row, shares, defaults)
        x = [round(f[c], 6) if c in Q._REAL else f[c] for c in MODEL.columns]
        e = [math.exp(b + sum(w * v for w, v in zip(ws, x, strict=True))) for ws, b in zip(MODEL.weights, MODEL.intercepts, strict=True)]
        ev = sum(k * v for k, v in enumerate(e)) / sum(e)
        return sum(ev >= c for c in M.CUTS), ev

    MODEL = Q.MODEL
    grid, single = set(), set()
    for r in rows:
        c0, ev0 = scored(r)
        for f, values in S.GRID.items():
            for v in values:
                c1, _ = scored(r | {S.FIELDS[f]: v})
                if c1 < c0:
                    grid.add((r["request_id"], f, str(v), c1, c0 - c1))
        applies = [r["video_amt"] == 0, r["fee"] > 0, r["vaccinated"] != 1, r["dewormed"] != 1, r["sterilized"] != 1, r["name"] is None]
        for ok, (f, name, v, _) in zip(applies, S.CHANGES, strict=True):
            c1, ev1 = scored(r | {S.FIELDS[f]: v})
            if ok and (ev0 - ev1 > 1e-9 or c1 < c0):
                text = f"Improves adoption speed prediction from class {c0} to {c1}" if c1 < c0 else f"Improves expected adoption time score by {ev0 - ev1:.2f}"
                single.add((r["request_id"], name, "Yes" if f == "Name" else str(v), c1 < c0, text))
    got = S.change_grid(coded, state, Q.score).collect()
    assert {(r["request_id"], r["feature"], r["candidate"], r["new_class"], r["improvement"]) for r in got} == grid and grid
    got = S.single_changes(coded, state, Q.score).collect()
    assert {(r["request_id"], r["feature"], r["suggested"], r["class_improved"], r["expected_impact"]) for r in got} == single and single
    gains = [(r["request_id"], r["place"], -round(r["ev_gain"], 9)) for r in got]
    assert sorted(gains) == sorted(gains, key=lambda g: (g[0], g[2], g[1]))
    coded.unpersist()


@pytest.mark.parametrize("name", ["E13_single_changes", "E14_change_grid"])
def test_changes_stay_small_for_the_compiler(spark, sf_dir, capsys, name):
    # the state is joined once, by two keys, and no generated method is beyond the 8,000 bytes up to which the JVM compiles
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = registry.queries()[name](spark, sf_dir)
        df.explain()
        assert len(re.findall(r"Join .*LeftOuter", capsys.readouterr().out)) == 2
        df.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_boosted_trees_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = np.clip(np.round(1.2 * x[:, 0] + 0.5 * x[:, 1] ** 2 + 1), 0, 3).astype(int)  # class 4 has no row
    df = spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x, strict=True))], "listing_id int, y int, a double, b double, c double")
    rows = M.assembled(df, ["a", "b", "c"])
    model = M.learner("boosted", maxIter=4).fit(rows)
    out = model.transform(rows).orderBy("listing_id").collect()
    for r in out[:40]:
        p = []
        for booster, slope, offset in model.members:
            if booster is None:
                p.append(offset)
                continue
            margin = sum(w * tree.predict(r["vector"]) for w, tree in zip(booster.treeWeights, booster.trees, strict=True))
            p.append(1 / (1 + math.exp(-(slope * margin + offset))))
        assert [r[c] for c in M.P] == pytest.approx([v / sum(p) for v in p], abs=1e-9)
    assert all(r["p4"] == 0 for r in out) and model.members[4] == (None, 0.0, 0.0)
    assert np.mean([int(np.argmax([r[c] for c in M.P])) == r["y"] for r in out]) > 0.7
    # calibrated: among many rows the mean probability of a class is near its share
    assert np.mean([[r[c] for c in M.P] for r in out], axis=0) == pytest.approx([np.mean(y == k) for k in range(5)], abs=0.06)


@pytest.mark.parametrize("classes", [3, 4])
def test_threshold_search_is_exhaustive(spark, classes):
    rng = np.random.default_rng(classes)
    y = rng.integers(0, classes, 200)
    ev = np.clip(y * 0.6 + rng.normal(0.4, 0.5, 200), -0.2, classes - 0.8)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, ev, strict=True)], "y int, ev double")
    coarse, finer, top = 8, 3, classes - 1
    fine = coarse * finer
    bins = np.clip(np.floor(ev * (fine / top)), 0, fine - 1)

    def kappa(cuts):
        yh = sum((bins >= c).astype(int) for c in cuts)
        e = (y**2).sum() + (yh**2).sum() - 2 * y.sum() * yh.sum() / len(y)
        return 1 - ((y - yh) ** 2).sum() / e if e > 0 else 0.0

    first = min(itertools.combinations_with_replacement(range(0, fine + 1, finer), top), key=lambda c: (-kappa(c), c))
    near = [[c for c in range(max(0, f - finer), min(fine, f + finer) + 1)] for f in first]
    best = min((c for c in itertools.product(*near) if list(c) == sorted(c)), key=lambda c: (-kappa(c), c))
    r = E.threshold_search(df, "y", "ev", classes, coarse, finer).collect()[0]
    assert r["cuts"] == pytest.approx([c * top / fine for c in best]) and r["kappa"] == pytest.approx(kappa(best))
    assert E.threshold_search(df.where("1 = 0"), "y", "ev", classes, coarse, finer).collect()[0]["kappa"] == 0.0


def test_split_join_spreads_hot_keys(spark):
    """80 % of the rows share one value; after the join no partition holds much more than its part."""
    n, parts = 200_000, 16
    rows = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 8, 0).when(F.col("id") % 1000 == 9, None).otherwise(F.col("id")).alias("v"))
    table = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.coalesce(F.col("v") * 2, F.lit(-1)))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(keep, (str(parts), "-1", "false"), strict=True):
            spark.conf.set(k, v)
        out = joins.join_split(rows, table, "v", "v", "n", "x", F.xxhash64("k"))
        assert out.columns == ["k", "v", "x"]
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == parts and max(sizes) < 1.2 * n / parts
        assert out.where("x = coalesce(v * 2, -1)").count() == out.count() == n
        missing = joins.join_split(rows, table.where("v <> 0"), "v", "v", "n", "x", F.xxhash64("k"))
        assert missing.where("x is null").count() == rows.where("v = 0 or v is null").count() and missing.count() == n
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    ranks = {r["k"]: r["rank_v"] for r in stats.average_ranks(rows.where("k < 20 and v is not null"), "k", ["v"]).collect()}
    assert ranks[0] == 8.5 and ranks[8] == 17 and ranks[19] == 19  # 9 is null


def test_class_share_draw(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 10 < 7).cast("int").alias("y"))
    one, two = E.class_share_draw(df, "y", df, "k"), E.class_share_draw(df.repartition(7), "y", df.repartition(3), "k")
    assert one.exceptAll(two).count() == 0 and one.where("drawn is null").count() == 0
    assert one.where("drawn = 1").count() / 20_000 == pytest.approx(0.7, abs=0.015)
    assert E.class_share_draw(df.where("1 = 0"), "y", df.limit(3), "k").where("drawn is null").count() == 3


def test_axes_by_covariance_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) @ np.diag([5.0, 3.0, 1.0, 0.2]) @ np.linalg.qr(rng.normal(size=(4, 4)))[0] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "i int, v array<double>").repartition(5)
    mean, matrix, n = I.covariance(df, "v")
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(matrix, np.cov(x.T))
    out = I.covariance_pca(df, df, "v", 2).orderBy("i").collect()
    values, axes = np.linalg.eigh(np.cov(x.T))
    best = np.abs((x - x.mean(axis=0)) @ axes[:, ::-1][:, :2])
    assert np.allclose(np.abs([r["scores"] for r in out[:-1]]), best, atol=1e-6) and out[-1]["scores"] is None
    assert np.allclose([r["residual"] for r in out[:-1]], ((x - x.mean(axis=0)) ** 2).sum(axis=1) - (best**2).sum(axis=1), atol=1e-6)
    assert out[0]["explained"] == pytest.approx(values[::-1][:2].sum() / values.sum())


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    grey, color = rng.integers(0, 256, (5, 9)), rng.integers(0, 256, (4, 3, 3))
    rows = [("a-1.png", I.png(5, 9, grey, 0)), ("a-2.png", I.png(4, 3, color)), ("b-x-3.png", I.png(5, 9, grey)[:25]), ("b-x-4.png", b"")]
    I.write_files(spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "name string, data binary"), f"{tmp_path}/i")
    got = {r["file"]: r for r in I.file_stats(spark, f"{tmp_path}/i").collect()}
    assert set(got) == {"a-1.png", "a-2.png"} and (got["a-1.png"]["width"], got["a-1.png"]["height"]) == (9, 5)
    assert got["a-1.png"]["brightness"] == pytest.approx(grey.mean(), abs=0.006) and got["a-1.png"]["kb"] == round((len(rows[0][1]) + 1) / 1024, 2)
    assert {r["key"]: r["files"] for r in I.files_by_key(spark, f"{tmp_path}/i").collect()} == {"a": ["a-1.png", "a-2.png"], "b-x": ["b-x-3.png", "b-x-4.png"]}


def test_sessions_on_event_time(spark, tmp_path):
    """Several micro-batches with updates out of order; a session ends when the watermark passes its creation by the limit."""
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [
        [(1, at(10), 2, "phase1_ready", None), (1, at(0), 1, "pending", 5.0), (2, at(20), 3, "pending", None)],
        [(1, at(5), 9, None, 1.0), (2, at(90), 4, None, 7.0), (3, at(95), 5, "error", None)],
        [(2, at(130), 6, "complete", None), (4, at(100), 7, None, None)],
    ]
    schema = "session_id long, ts timestamp, event_id long, status string, payload double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    read = lambda: R.event_stream(spark, f"{tmp_path}/in/*", "*.parquet", schema)
    got = {r["session_id"]: r for r in R.last_states(R.expiring_sessions(read(), 10**8, late="1 hour"), f"{tmp_path}/all").collect()}
    want = {r["session_id"]: r for r in R.session_state(spark.createDataFrame([r for b in batches for r in b], schema)).collect()}
    assert {k: tuple(r)[1:5] for k, r in got.items()} == {k: tuple(r)[1:5] for k, r in want.items()} and not any(r["expired"] for r in got.values())
    got = {r["session_id"]: r["expired"] for r in R.last_states(R.expiring_sessions(read(), 60), f"{tmp_path}/some").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_class_reports(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 1)], "y int, yhat int")
    assert sorted(tuple(r) for r in E.error_by_class(df, "y", "yhat").collect()) == [(0, 2, 1, 0.5), (1, 1, 0, 0.0), (3, 1, 1, 1.0)]
    got = [tuple(r) for r in E.class_shares(df, "yhat", df, "y").orderBy("cls").collect()]
    assert got == [(0, 1, 25.0, 2, 50.0), (1, 3, 75.0, 1, 25.0), (2, 0, 0.0, 0, 0.0), (3, 0, 0.0, 1, 25.0), (4, 0, 0.0, 0, 0.0)]


def test_every_sentence_of_the_explanation(spark):
    from pelago.operators import attribution as A

    def told(cls, confidence, shares, pos, neg):
        df = spark.createDataFrame([(cls, confidence, shares, pos, neg)], "c int, f double, s array<struct<share:double,modality:string>>, p array<string>, n array<string>")
        return df.select(A.template_explanation(F.col("c"), F.lit("L"), F.col("f"), F.col("s"), F.col("p"), F.col("n"))).first()[0]

    assert told(2, 0.5, [(0.625, "text"), (0.36, "image"), (0.012, "other"), (0.003, "tabular")], ["A", "A", "B"], []) == (
        "The model predicts a relatively fast adoption (L), with moderate confidence. The prediction is primarily driven by description content (62%), with additional influence from photo characteristics and other. Factors supporting faster adoption include A."
    )
    assert told(3, 0.3, [(1.0, "tabular")], [], ["A", "B", "C"]) == "The model predicts a slower adoption timeline (L), though with some uncertainty. The prediction is driven entirely by listing attributes. Working against faster adoption: A and B."
    assert told(4, 0.1, [], [], []) == "The model predicts a slower adoption timeline (L), though the model shows notable uncertainty across classes. The prediction is based on multiple data signals."
