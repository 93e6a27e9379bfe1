"""Image features from the image source (A23-A25, S06): brightness, sharpness, sizes; vector pooling."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import quantiles

#: A file's key in `key-n.ext`.
KEYED = r"^(.*)-\d+\.[A-Za-z]+$"


def luma_and_blur(data: bytes, height: int, width: int, channels: int) -> tuple[float, float]:
    """Mean luma, and the variance of the Laplacian with mirrored borders. Pixels come as BGR bytes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    g = a[:, :, 0] if channels < 3 else (299 * a[:, :, 2] + 587 * a[:, :, 1] + 114 * a[:, :, 0]) // 1000
    p = np.pad(g, 1, mode="symmetric")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    n, s, squares = lap.size, int(lap.sum()), int((lap * lap).sum())
    return float(g.mean()), (n * squares - s * s) / (n * n)  # whole numbers up to the division, so the same in every order


@F.pandas_udf(T.StructType([T.StructField("brightness", T.DoubleType()), T.StructField("blur", T.DoubleType())]))
def _measure(image: pd.DataFrame) -> pd.DataFrame:
    rows = [luma_and_blur(d, h, w, c) for d, h, w, c in zip(image["data"], image["height"], image["width"], image["nChannels"], strict=True)]
    return pd.DataFrame(rows, columns=["brightness", "blur"])


def image_stats(images: DataFrame) -> DataFrame:
    """(file, width, height, aspect_ratio, brightness, blur); files that do not decode are left out."""
    out = images.withColumn("m", _measure("image"))
    return out.select(file_name("image.origin").alias("file"), "image.width", "image.height", F.round(F.col("image.width") / F.col("image.height"), 4).alias("aspect_ratio"), F.round("m.brightness", 2).alias("brightness"), F.round("m.blur", 2).alias("blur"))


def file_name(path: str) -> Column:
    """The name in a path like `.../name=x/part-0`, as write_files() leaves it, or else its last part."""
    named = F.regexp_extract(F.col(path), r"/name=([^/]+)/[^/]*$", 1)
    return F.when(named != "", named).otherwise(F.element_at(F.split(path, "/"), -1))


def write_files(rows: DataFrame, path: str) -> None:
    """One file for each row (name, data): its bytes and a closing line feed, which decoders pass over."""
    rows.select("name", F.col("data").cast("string").alias("value")).write.partitionBy("name").text(path)


def scan_images(spark, path: str) -> DataFrame:
    """Decoded images of all files below the path; what does not decode is left out."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)


def scan_files(spark, path: str) -> DataFrame:
    """(path, length) of all files below the path; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def file_stats(spark, path: str) -> DataFrame:
    """image_stats() of the image files below a path, with their size in KB."""
    sizes = scan_files(spark, path).select(file_name("path").alias("file"), F.round(F.col("length") / 1024, 2).alias("kb"))
    return image_stats(scan_images(spark, path)).join(sizes, "file").select("file", "width", "height", "aspect_ratio", "kb", "brightness", "blur")


def files_by_key(spark, path: str) -> DataFrame:
    """(key, n, files): the sorted names of the files `key-n.ext` of each key. An entity has few images."""
    named = scan_files(spark, path).select(file_name("path").alias("file"))
    return named.groupBy(F.regexp_extract("file", KEYED, 1).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("file")).alias("files"))


def quality_by_key(stats: DataFrame) -> DataFrame:
    """Per key of `key-n.ext`: mean brightness and blur, and the population deviation of the areas."""
    keyed = stats.withColumn("key", F.regexp_extract("file", KEYED, 1))
    area = F.col("width") * F.col("height")
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("brightness"), 4).alias("mean_brightness"), F.round(F.avg("blur"), 4).alias("mean_blur"), F.round(F.coalesce(F.stddev_pop(area), F.lit(0.0)), 4).alias("area_std"))


def png(height: int, width: int, pixels: np.ndarray, level: int = 6) -> bytes:
    """A PNG of a grey array, or of an RGB one with three axes; level 0 stores without compression."""
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def pool_vectors(vectors: DataFrame, key: str, vector: str, keys: DataFrame | None = None, how: str = "mean") -> DataFrame:
    """Element-wise mean or max by key, as an array; keys without vectors get an empty one, flag 0."""
    if how not in ("mean", "max"):
        raise ValueError(f"unknown pooling {how!r}")
    cells = vectors.select(key, F.posexplode(vector).alias("pos", "x"))
    agg = F.avg("x") if how == "mean" else F.max("x")
    by = cells.groupBy(key, "pos").agg(agg.cast("double").alias("x")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("pooled"))
    counts = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n_vectors"))
    out = by.join(counts, key)
    if keys is not None:
        out = keys.select(key).distinct().join(out, key, "left")
    return out.select(key, F.coalesce("pooled", F.array().cast("array<double>")).alias("pooled"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), F.col("n_vectors").isNotNull().cast("int").alias("has_vector"))


def scale(train: DataFrame, df: DataFrame, columns, how: str = "standard") -> DataFrame:
    """Standard (population deviation) or robust (median, quartiles) scaling fitted on train."""
    if how == "standard":
        fitted = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    else:
        fitted = reduce(DataFrame.crossJoin, [quantiles(train, c, [0.25, 0.5, 0.75]).select(F.col("q1").alias(f"_m_{c}"), (F.col("q2") - F.col("q0")).alias(f"_s_{c}")) for c in columns])  # one row each
    out = df.crossJoin(F.broadcast(fitted))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") != 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}).drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def pca(train: DataFrame, df: DataFrame, vector: str, k: int) -> tuple[DataFrame, list[float]]:
    """Scores on k components fitted on centred train vectors, and their explained variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    wide = lambda d: d.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(wide(train))
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(wide(train)))
    out = model.transform(centre.transform(wide(df))).withColumn("scores", vector_to_array("_p")).drop("_v", "_c", "_p")
    return out, [float(x) for x in model.explainedVariance]


def covariance(vectors: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and count of equally long vectors, from sums that each task makes of its own rows.

    A task sends one row of d * d sums, and what comes to the driver has d * d numbers."""

    def sums(batches):
        n, s, q = 0, 0.0, 0.0
        for batch in batches:
            if len(batch):
                x = batch.column(0).flatten().to_numpy().reshape(len(batch), -1)
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([q.ravel().tolist()], pa.list_(pa.float64()))], ["n", "s", "q"])

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(sums, "n bigint, s array<double>, q array<double>")
    n = int(rows.agg(F.sum("n")).collect()[0][0] or 0)
    total = lambda c: np.array([r[1] for r in rows.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x")).orderBy("i").collect()])
    if not n:
        return np.zeros(0), np.zeros((0, 0)), 0
    mean = total("s") / n
    return mean, (total("q").reshape(len(mean), -1) - n * np.outer(mean, mean)) / max(1, n - 1), n


def principal_axes(matrix: np.ndarray, k: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """The k leading axes of a covariance and their variances, by power iteration from the diagonal direction
    and deflation. The number of steps is fixed, so the result is the same everywhere."""
    left, axes, values = matrix.copy(), [], []
    for _ in range(k):
        v = np.full(len(left), 1 / np.sqrt(len(left)))
        for _ in range(steps):
            w = left @ v
            size = np.sqrt((w * w).sum())
            if size == 0:
                break
            v = w / size
        value = float(v @ left @ v)
        axes.append(v)
        values.append(value)
        left = left - value * np.outer(v, v)
    return np.array(axes), np.array(values)


def covariance_pca(train: DataFrame, df: DataFrame, vector: str, k: int, steps: int = 300) -> DataFrame:
    """df with the scores of its centred vectors on k axes of train's covariance, what of their squared
    length the axes leave, and the axes' share of the variance. Rows without a vector have nulls."""
    mean, matrix, n = covariance(train, vector)
    if not n:
        raise ValueError("no vector to fit on")
    axes, values = principal_axes(matrix, k, steps)
    array = lambda x: F.array(*[F.lit(float(y)) for y in x])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    out = df.withColumn("_d", F.zip_with(F.col(vector), array(mean), lambda x, y: x.cast("double") - y))
    out = out.withColumn("scores", F.when(F.col("_d").isNotNull(), F.array(*[dot("_d", array(a)) for a in axes])))
    return out.withColumns({"residual": dot("_d", "_d") - dot("scores", "scores"), "explained": F.lit(float(values.sum() / np.trace(matrix)))}).drop("_d")
