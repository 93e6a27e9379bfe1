"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of the whole text are standardised by moments of the training rows, mapped to
`FEATURES` random cosines that approximate a Gaussian kernel, and a ridge regression is fitted
from normal equations that each of `SHARDS` tasks sums over its rows. Isotonic regression over
binned scores of other labelled rows turns the ridge output into a probability. All that comes to
the driver has a fixed size. Rows whose crc32(doc_id as text) mod 5 is 0 are never learned from;
labels, lang, source and doc_id are not inputs.

Defined results: a null or empty text has all-zero statistics and gets a score like any other;
repeated rows are scored alike; without labels of both classes every score is 0.5; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, scratch, slices, table, written
from .textvec import Texts, mix

#: Labelled rows that may be used, the tasks that sum over them, the share that calibrates.
SAMPLE_ROWS, SHARDS, CALIBRATION = 8192, 8, 0.3
FEATURES, GAMMA, RIDGE, BIN = 192, 0.06, 1.0, 0.02
THRESHOLD = 0.3


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _BAR, _SHOUT, _STOP, _PAUSE = _set(b"#*$%&|<>"), _set(b"|"), _set(b"!"), _set(b".?!"), _set(b",;:")
_UPPER, _LOWER, _DIGIT = _set(bytes(range(65, 91))), _set(bytes(range(97, 123))), _set(bytes(range(48, 58)))
STATISTICS = 18


def statistics(t: Texts) -> np.ndarray:
    """A row of STATISTICS numbers for each document."""
    words = t.words()
    n, chars = np.maximum(t.n_words, 1), np.maximum(t.size, 1)
    doc = t.doc_of_words(np.arange(len(words)))
    first = np.unique(mix(words ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), return_index=True)[1]
    distinct = np.bincount(doc[first], minlength=t.n)
    starts, ends, per_line = t.lines()
    line_doc = np.searchsorted(t.at, starts, side="right") - 1
    lines = np.maximum(np.bincount(line_doc, per_line > 0, t.n), 1)
    length = (t.ends - t.starts).astype(np.int64)
    last = t.buf[t.ends - 1] if len(words) else np.zeros(0, np.uint8)
    upper, lower = t.per_doc(_UPPER[t.buf]), t.per_doc(_LOWER[t.buf])
    return np.stack(
        [
            np.log1p(t.n_words), t.per_words(length) / n, t.per_doc(_SYMBOL[t.buf]) / n, upper / np.maximum(upper + lower, 1),
            t.per_doc(_DIGIT[t.buf]) / chars, t.per_doc(_PAUSE[t.buf]) / n, t.per_doc(_STOP[t.buf]) / n, t.per_doc(_SHOUT[t.buf]) / n,
            t.per_doc(_BAR[t.buf]) / n, t.duplicate_lines() / lines, t.repeated_words(words, 8) / n, distinct / n,
            np.log1p(t.n_words / lines), t.per_doc(t.buf >= 128) / chars, t.per_words(length == 1) / n, t.per_words(length > 12) / n,
            t.per_words(_SYMBOL[last]) / n, np.log1p(lines),
        ],
        axis=1,
    )


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(8)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (STATISTICS, FEATURES))
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([np.cos(z @ w + phase) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def isotonic(cells: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit to (score, positives, rows), in score order."""
    blocks: list[list[float]] = []
    for s, p, n in cells:
        blocks.append([s * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([s / n for s, _, n in blocks]), np.array([p / n for _, p, n in blocks])


def fit(documents: DataFrame, labels: DataFrame) -> dict | None:
    with scratch(documents.sparkSession):
        return _fit(documents, labels)


def _fit(documents: DataFrame, labels: DataFrame) -> dict | None:
    def measured(batches):
        for batch, texts in slices(batches, "text"):
            x = statistics(Texts(texts))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, STATISTICS, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), flat], ["y", "slot", "x"])

    sample = labelled_sample(documents, labels, "quality", SAMPLE_ROWS).select("text", "y", "slot")
    rows = written(sample.mapInArrow(measured, "y int, slot long, x array<double>"), "statistics")
    cut = int((1 << 20) * (1 - CALIBRATION))
    train = rows.where(F.col("slot") < cut)
    column = lambda f: [F.round(f(F.col("x")[i]), 9).alias(f"c{i}") for i in range(STATISTICS)]
    mean, scale = train.agg(*column(F.avg)).first(), train.agg(*column(F.stddev_pop)).first()
    if mean is None or mean[0] is None:
        return None
    mean, scale = np.array(mean, float), np.maximum(np.array(scale, float), 1e-6)

    def normal(key, pdf):
        import pandas as pd

        z = fourier(np.stack(pdf["x"].to_numpy()), mean, scale)
        y = pdf["y"].to_numpy(float)
        return pd.DataFrame({"shard": [int(key[0])], "zz": [(z.T @ z).ravel().tolist()], "zy": [(z.T @ y).tolist()], "p": [y.sum()], "n": [len(y)]})

    sums = train.groupBy((F.col("slot") % SHARDS).cast("int").alias("shard")).applyInPandas(normal, "shard int, zz array<double>, zy array<double>, p double, n long").collect()
    sums.sort(key=lambda r: r["shard"])
    size = FEATURES + 1
    zz, zy = np.sum([r["zz"] for r in sums], axis=0).reshape(size, size), np.sum([r["zy"] for r in sums], axis=0)
    beta = np.linalg.solve(zz + RIDGE * np.eye(size), zy)

    def ridge(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, STATISTICS)
            z = np.round(fourier(x, mean, scale) @ beta / BIN) * BIN
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(z, 6))], ["y", "z"])

    cells = rows.where(F.col("slot") >= cut).select("y", "x").mapInArrow(ridge, "y int, z double").groupBy("z").agg(F.sum("y").alias("p"), F.count("y").alias("n")).orderBy("z").collect()
    cells = [(r["z"], r["p"], r["n"]) for r in cells]
    positives, n = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if positives in (0, n) or sum(r["p"] for r in sums) in (0, sum(r["n"] for r in sums)):
        return None
    at, value = isotonic(cells)
    return {"mean": mean, "scale": scale, "beta": beta, "at": at, "value": value}


SCHEMA = "doc_id long, score double, predicted int"


def scored(documents: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch, texts in slices(batches, "text"):
            if m:
                z = fourier(statistics(Texts(texts)), m["mean"], m["scale"]) @ m["beta"]
                # a small slope keeps the order of scores inside a level of the calibration
                s = np.clip(0.998 * np.interp(z, m["at"], m["value"]) + 0.002 / (1 + np.exp(-4 * np.clip(z, -5, 5))), 0, 1)
            else:
                s = np.full(len(texts), 0.5)
            s = np.round(s, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return scored(documents, fit(documents, table(spark, sf_dir, "labels", "doc_id", "quality")))
