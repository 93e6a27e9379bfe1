"""Quality rules: exact base counts, then a calibrated logistic regression on hashed n-grams.

The model sees word 1- and 2-grams and character 3- and 4-grams of the whole text, hashed into four
tables of `BINS` weights. It is fitted on a bounded sample of labelled rows: `SHARDS` tasks fit
one shard each, their weights are averaged (a fixed size, whatever the input), and Platt's
sigmoid is fitted on other labelled rows from a histogram of `STEPS` bins. Scoring runs in Arrow
batches over every document against fixed thresholds.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are
scored alike; without usable labels the model has no verdict and every row that passes the base
rule is kept; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, labelled_sample, slices, table
from .textvec import Texts, mix

U = np.uint64
#: Labelled rows that may be used, the bytes of their texts at most (a trainer's memory is bounded by
#: both; longer texts are scored, not learned from), how many tasks fit, and the share of slots that calibrates.
SAMPLE_ROWS, SAMPLE_BYTES, SHARDS, CALIBRATION = 6144, 1 << 18, 6, 0.3
BINS, STEPS, ROUNDS = 1 << 14, 64, 80
#: Fixed thresholds: words, repeated words in percent, and the calibrated probability.
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_PROBABILITY = 20, 30, 0.3
FAMILIES = 4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    words = t.words()
    return {
        "n_words": t.n_words,
        "word_chars": t.per_doc(t.mask & ((t.buf & 0xC0) != 0x80)),
        "n_symbols": t.per_doc(_SYMBOL[t.buf]),
        "n_dup_lines": t.duplicate_lines(),
        "n_repeat_words": t.repeated_words(words, 8),
    }


def gram_bins(t: Texts):
    """For each family: bins of its n-grams and how many each document has, in document order."""
    words = t.words()
    yield (words >> U(50)).astype(np.int32), t.n_words
    at, pairs = t.windows(words, 2)
    yield (pairs >> U(50)).astype(np.int32), np.maximum(t.n_words - 1, 0)
    points, starts = t.characters()
    for k in (3, 4):
        m = len(points) - k + 1
        if m <= 0:
            yield np.zeros(0, np.int32), np.zeros(t.n, np.int64)
            continue
        g = points[:m].copy()
        for j in range(1, k):
            g *= np.uint32(0x01000193)
            g ^= points[j : j + m]
        g *= np.uint32(0x9E3779B1)
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x85EBCA77)
        # grams start at a document's characters and its closing line feed; the last k - 1 would leave it
        n = np.maximum(np.diff(starts) - (k - 1), 0)
        keep = np.ones(m, bool)
        for j in range(1, k):
            bad = starts[1:] - j
            keep[bad[(bad >= 0) & (bad < m)]] = False
        yield (g[keep] >> np.uint32(18)).astype(np.int32), n


def raw_scores(t: Texts, weights: np.ndarray, bias: float) -> np.ndarray:
    """Mean weight of the n-grams of each family, summed over the families."""
    z = np.full(t.n, bias)
    for f, (bins, counts) in enumerate(gram_bins(t)):
        c = np.concatenate(([0.0], np.cumsum(weights[f][bins], dtype=np.float64)))
        ends = np.cumsum(counts)
        z += (c[ends] - c[ends - counts]) / np.maximum(counts, 1)
    return z


def fit_shard(key, pdf):
    """Weights of one shard: full-batch Adagrad on the logistic loss of mean-pooled n-grams."""
    import pandas as pd

    pdf = pdf.sort_values(["slot", "doc_id"])
    y = pdf["y"].to_numpy(float)
    t = Texts([(x or "").encode() for x in pdf["text"]])
    idx, val, doc = [], [], []
    for f, (bins, counts) in enumerate(gram_bins(t)):
        d = np.repeat(np.arange(t.n), counts)
        cell, n = np.unique(d * np.int64(BINS) + bins, return_counts=True)
        d = cell // BINS
        idx.append((cell % BINS + f * BINS).astype(np.int32))
        val.append((n / np.maximum(counts, 1)[d]).astype(np.float32))
        doc.append(d.astype(np.int32))
        del d, cell, n
    idx, val, doc = np.concatenate(idx), np.concatenate(val), np.concatenate(doc)
    w, b, seen, seen_b = np.zeros(FAMILIES * BINS), 0.0, np.full(FAMILIES * BINS, 1e-8), 1e-8
    # both classes weigh the same
    weight = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(ROUNDS):
        z = b + np.bincount(doc, val * w[idx], t.n)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(idx, val * e[doc], FAMILIES * BINS) + 1e-7 * w
        seen += g * g
        w -= 0.8 * g / np.sqrt(seen) * (seen > 1e-7**2)
        b -= 0.05 * e.sum() / np.sqrt(seen_b := seen_b + e.sum() ** 2)
    return pd.DataFrame({"shard": [int(key[0])], "n": [len(y)], "w": [w.tolist()], "b": [b]})


def platt(cells: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Slope and offset of the sigmoid from (score, positives, rows), by Newton steps."""
    s, p, n = (np.array(c, float) for c in zip(*cells, strict=True))
    a, b = 1.0, 0.0
    x = np.stack([s, np.ones_like(s)])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g = x @ (n * q - p) + np.array([1e-3 * a, 0])
        h = (x * (n * q * (1 - q))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def fit(documents: DataFrame, labels: DataFrame) -> dict | None:
    """Weights, bias and calibration; None if there are no labels of both classes."""
    short = documents.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    sample = labelled_sample(short, labels, "quality", SAMPLE_ROWS)
    cut = int((1 << 20) * (1 - CALIBRATION))
    schema = "shard int, n long, w array<double>, b double"
    shards = (
        sample.where(F.col("slot") < cut)
        .groupBy((F.col("slot") % SHARDS).cast("int").alias("shard"))
        .applyInPandas(fit_shard, schema)
        .collect()
    )
    shards.sort(key=lambda r: r["shard"])
    if not shards:
        return None
    weights = np.mean([r["w"] for r in shards], axis=0).reshape(FAMILIES, BINS)
    bias = float(np.mean([r["b"] for r in shards]))

    def score(batches):
        for batch, texts in slices(batches, "text"):
            z = raw_scores(Texts(texts), weights, bias)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(z * 4) / 4), batch.column(1)], ["z", "y"])

    cells = (
        sample.where(F.col("slot") >= cut).select("text", "y").mapInArrow(score, "z double, y int")
        .groupBy(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), "z")).alias("z")).agg(F.sum("y").alias("p"), F.count("y").alias("n"))
        .orderBy("z").collect()
    )
    rows = [(r["z"], r["p"], r["n"]) for r in cells]
    if not rows or sum(r[1] for r in rows) in (0, sum(r[2] for r in rows)):
        return None
    a, b = platt(rows)
    return {"weights": weights.astype(np.float32), "bias": bias, "a": a, "b": b}


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def scored(documents: DataFrame, model: dict | None, carry: str | None = None) -> DataFrame:
    """One row per document with the counts and the verdict; with carry, the input's columns and the
    verdict under that name, which they must not have."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in slices(batches, "text"):
            t, m = Texts(texts), shared.value
            c = base_counts(t)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            if m:
                z = m["a"] * raw_scores(t, m["weights"], m["bias"]) + m["b"]
                p = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)
            else:
                p = np.ones(t.n)
            kept = ~failed & (p >= MIN_PROBABILITY)
            if carry:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept)], [*batch.schema.names, carry])
            else:
                arrays = [batch.column(0), *(pa.array(v.astype(np.int64)) for v in c.values()), pa.array(failed), pa.array(p), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *c, "base_failed", "probability", "kept"])

    if carry:
        return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(carry, T.BooleanType())]))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep_good(documents: DataFrame, labels: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    """The rows whose text passes the base rule and the model, with all their columns."""
    model = fit(documents if train_on is None else train_on, labels)
    names = [F.col(f"`{c}`") for c in documents.columns]
    (kept,) = fresh(documents.columns, "_kept")
    return scored(documents, model, carry=kept).where(kept).select(*names)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return scored(documents, fit(documents, table(spark, sf_dir, "labels", "doc_id", "quality")))
