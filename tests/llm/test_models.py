"""The trained parts of op1 and op8 against plain versions, and columns with the operators' own names."""

import random

import numpy as np
from pyspark.sql import functions as F

from pelago.llm import op1_quality_rules as op1
from pelago.llm import op7_exact_dedup as op7
from pelago.llm import op8_quality_classifier as op8
from pelago.llm.common import labelled_sample, table
from pelago.llm.textvec import Texts

SF = "/root/testdata/sf0.01"


def test_isotonic_equals_the_minimax_formula():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 12)
        cells = [(float(i), rng.randint(0, 5), 5) for i in range(n)]
        y = [p / m for _, p, m in cells]
        want = [max(min(sum(y[a : b + 1]) / (b - a + 1) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        at, value = op8.isotonic(cells)
        assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
        assert np.allclose(sorted({round(x, 9) for x in want}), value)


def test_ridge_equals_one_solution_over_all_rows(spark):
    docs, labels = table(spark, SF, "documents", "doc_id", "text"), table(spark, SF, "labels", "doc_id", "quality")
    model = op8.fit(docs, labels)
    rows = [r for r in labelled_sample(docs, labels, "quality", op8.SAMPLE_ROWS).collect() if r.slot < int((1 << 20) * (1 - op8.CALIBRATION))]
    x = op8.statistics(Texts([r.text.encode() for r in rows]))
    mean, scale = np.round(x.mean(0), 9), np.maximum(np.round(x.std(0), 9), 1e-6)
    assert np.allclose(model["mean"], mean, atol=1e-8) and np.allclose(model["scale"], scale, atol=1e-8)
    z, y = op8.fourier(x, mean, scale), np.array([r.y for r in rows], float)
    wide = np.vstack([z, np.sqrt(op8.RIDGE) * np.eye(z.shape[1])])  # ridge as least squares over more rows
    beta = np.linalg.lstsq(wide, np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(z @ model["beta"], z @ beta, atol=1e-5)
    assert len(rows) > 100


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, op8.STATISTICS)) * 0.5
    z = op8.fourier(x, np.zeros(op8.STATISTICS), np.ones(op8.STATISTICS))[:, :-1]
    kernel = np.exp(-op8.GAMMA * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.35 and np.abs(z @ z.T - kernel).mean() < 0.08


def test_op1_verdict_and_held_out_separation(spark):
    out = op1.op1_quality_rules(spark, SF).join(table(spark, SF, "labels", "doc_id", "quality"), "doc_id").toPandas()
    assert (out.kept == (~out.base_failed & (out.probability >= op1.MIN_PROBABILITY))).all()
    unseen = out[[zlib_fold(i) for i in out.doc_id]]
    good, bad = unseen.probability[unseen.quality == 1].to_numpy(), unseen.probability[unseen.quality == 0].to_numpy()
    assert len(good) and len(bad) and (good[:, None] > bad[None, :]).mean() > 0.9
    assert unseen.kept[unseen.quality == 1].mean() > 0.9 and unseen.kept[unseen.quality == 0].mean() < 0.5


def zlib_fold(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_op1_grams_are_of_characters_and_know_no_neighbour():
    texts = ["abcé日本😀x", "", "a", "日本", "two words here", "é" * 50]
    raw = [t.encode() for t in texts]
    points, starts = Texts(raw).characters()
    assert [chr(c) for c in points] == list("\n".join(texts) + "\n") and starts.tolist() == list(np.cumsum([0] + [len(t) + 1 for t in texts]))
    together = [(b, np.cumsum(n)) for b, n in op1.gram_bins(Texts(raw))]
    for i, t in enumerate(raw):
        for (bins, ends), (own, n) in zip(together, op1.gram_bins(Texts([t])), strict=True):
            assert bins[ends[i] - len(own) : ends[i]].tolist() == own.tolist() and n.tolist() == [len(own)]
    assert [int(n[0]) for _, n in op1.gram_bins(Texts(["日本語x".encode()]))] == [1, 0, 3, 2]


def test_op1_model_equals_plain_logistic_steps():
    """The shard's weights after all rounds, by dense matrices."""
    import pandas as pd

    rng = random.Random(3)
    texts = [" ".join(rng.choice("good fine clear bad junk noise".split()[k * 3 : k * 3 + 3]) for _ in range(12)) for k in (0, 1) for _ in range(8)]
    y = np.array([1] * 8 + [0] * 8, float)
    got = op1.fit_shard((0,), pd.DataFrame({"slot": range(16), "doc_id": range(16), "text": texts, "y": y})).iloc[0]
    x = np.zeros((16, op1.FAMILIES * op1.BINS), np.float32)
    for f, (bins, counts) in enumerate(op1.gram_bins(Texts([t.encode() for t in texts]))):
        for b, d in zip(bins, np.repeat(np.arange(16), counts), strict=True):
            x[d, f * op1.BINS + b] += 1 / counts[d]
    w, b, seen, seen_b = np.zeros(x.shape[1]), 0.0, np.full(x.shape[1], 1e-8), 1e-8
    weight = np.where(y > 0.5, 0.5 / 8, 0.5 / 8)
    for _ in range(op1.ROUNDS):
        e = weight * (1 / (1 + np.exp(-(b + x @ w))) - y)
        g = x.T @ e + 1e-7 * w
        seen += g * g
        w -= 0.8 * g / np.sqrt(seen)
        seen_b += e.sum() ** 2
        b -= 0.05 * e.sum() / np.sqrt(seen_b)
    score = lambda v, c: x @ np.array(v) + c
    assert np.allclose(score(got.w, got.b), score(w, b), atol=0.05) and ((score(w, b) > 0) == (y == 1)).all()


def test_columns_with_the_operators_names_pass_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = ["text_sha256", "_digest", "_kept", "_drop", "_top", "_n", "_keep_id", "_group_size", "_row", "_place", "kept", "keep_id", "_part", "_s"]
    marked = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in own})
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    for out in (op7.drop_duplicates(marked), op1.keep_good(marked, labels)):
        assert out.columns == marked.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in own)
    want = {}
    for r in docs.collect():
        want[r.text] = max(want.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in op7.drop_duplicates(marked).collect()) == sorted(want.values())
