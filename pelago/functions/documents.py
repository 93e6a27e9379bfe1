"""Nested annotation documents: sentiment and vision features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTIMENT = "documentSentiment struct<score:double,magnitude:double>, sentences array<struct<sentiment:struct<score:double,magnitude:double>>>, entities array<struct<name:string,type:string,salience:double>>, language string"
VISION = "labelAnnotations array<struct<description:string,score:double>>, imagePropertiesAnnotation struct<dominantColors:struct<colors:array<struct<color:struct<red:double,green:double,blue:double>>>>>, cropHintsAnnotation struct<cropHints:array<struct<confidence:double>>>"


def parsed(df: DataFrame, text: str, schema: str) -> DataFrame:
    return df.withColumn("d", F.from_json(text, schema))


def _moments(values: Column) -> Column:
    """n, total and m2 (sum of squared differences from the mean) of an array in one pass."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("m2"))

    def add(a, x):
        n, d = a["n"], x * a["n"] - a["total"]
        return F.struct((n + 1).alias("n"), (a["total"] + x).alias("total"), (a["m2"] + F.when(n > 0, d * d / (n * (n + 1))).otherwise(0.0)).alias("m2"))

    return F.aggregate(values, start, add)


def _mean(m: str) -> Column:
    return F.when(F.col(f"{m}.n") > 0, F.col(f"{m}.total") / F.col(f"{m}.n")).otherwise(0.0)


def _var(m: str) -> Column:
    """Population variance, 0 for fewer than one value."""
    return F.when(F.col(f"{m}.n") > 0, F.col(f"{m}.m2") / F.col(f"{m}.n")).otherwise(0.0)


def sentiment_features(df: DataFrame, key: str) -> DataFrame:
    """Document and sentence scores, entity counts; missing parts give 0 or an empty text."""
    scores = F.coalesce(F.transform("d.sentences", lambda s: F.coalesce(s["sentiment"]["score"], F.lit(0.0))), F.array().cast("array<double>"))
    sizes = F.coalesce(F.transform("d.sentences", lambda s: F.coalesce(s["sentiment"]["magnitude"], F.lit(0.0))), F.array().cast("array<double>"))
    kinds = F.coalesce(F.transform("d.entities", lambda e: F.coalesce(e["type"], F.lit("UNKNOWN"))), F.array().cast("array<string>"))
    # arrays are made once, and each is gone over once
    rows = df.select(key, "d", scores.alias("scores"), sizes.alias("sizes"), kinds.alias("kinds"))
    rows = rows.select("*", _moments(F.col("scores")).alias("of_scores"), _moments(F.col("sizes")).alias("of_sizes"))
    return rows.select(
        key,
        F.round(F.coalesce("d.documentSentiment.score", F.lit(0.0)), 4).alias("score"),
        F.round(F.coalesce("d.documentSentiment.magnitude", F.lit(0.0)), 4).alias("magnitude"),
        F.size("scores").alias("n_sentences"),
        F.round(_mean("of_scores"), 4).alias("mean_sentence_score"),
        F.round(_mean("of_sizes"), 4).alias("mean_sentence_magnitude"),
        F.round(F.coalesce(F.array_min("scores"), F.lit(0.0)), 6).alias("min_sentence_score"),
        F.round(F.coalesce(F.array_max("scores"), F.lit(0.0)), 6).alias("max_sentence_score"),
        F.round(_var("of_scores"), 6).alias("sentiment_variance"),
        F.size("kinds").alias("entity_count"),
        F.size(F.array_distinct("kinds")).alias("entity_type_count"),
        F.coalesce("d.language", F.lit("")).alias("language"),
    )


def vision_features(df: DataFrame, *keys: str) -> DataFrame:
    """Labels, brightness of the dominant colours and the first crop confidence of each image."""
    none = F.array().cast("array<double>")
    labels = F.coalesce(F.transform("d.labelAnnotations", lambda x: F.coalesce(x["description"], F.lit(""))), F.array().cast("array<string>"))
    part = lambda c, k: F.coalesce(c["color"][k], F.lit(0.0))
    shades = F.coalesce(F.transform("d.imagePropertiesAnnotation.dominantColors.colors", lambda c: (part(c, "red") + part(c, "green") + part(c, "blue")) / 3), none)
    first = lambda path, default: F.coalesce(F.expr(path), F.lit(default))
    rows = df.select(*keys, "d", labels.alias("names"), shades.alias("shades"))
    rows = rows.select("*", _moments(F.col("shades")).alias("of_shades"))
    return rows.select(
        *keys,
        F.size("names").alias("n_labels"),
        first("try_element_at(d.labelAnnotations, 1).description", "").alias("top_label"),
        F.round(first("try_element_at(d.labelAnnotations, 1).score", 0.0), 4).alias("top_score"),
        F.array_join("names", "|").alias("labels"),
        F.size("shades").alias("n_colors"),
        F.round(_mean("of_shades"), 4).alias("brightness"),
        F.round(F.when(F.size("shades") > 1, F.sqrt(_var("of_shades"))).otherwise(0.0), 4).alias("brightness_std"),
        F.round(first("try_element_at(d.cropHintsAnnotation.cropHints, 1).confidence", 0.0), 4).alias("crop_confidence"),
    )


def vision_by_key(images: DataFrame, key: str) -> DataFrame:
    numbers = ["n_labels", "top_score", "n_colors", "brightness", "brightness_std", "crop_confidence"]
    return images.groupBy(key).agg(*[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in numbers])


def entities(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode("d.entities").alias("e")).select(key, F.lower("e.name").alias("name"), F.coalesce("e.type", F.lit("UNKNOWN")).alias("type"), F.coalesce("e.salience", F.lit(0.0)).alias("salience"))


def entity_types(rows: DataFrame, keep: int = 8) -> DataFrame:
    """Counts and mean salience of the most frequent types; the others together."""
    counts = rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("salience").alias("s"))
    top = counts.orderBy(F.desc("n"), "type").limit(keep).select("type", F.lit(True).alias("_top"))
    named = counts.join(F.broadcast(top), "type", "left").withColumn("type", F.when(F.col("_top"), F.col("type")).otherwise("Other"))
    return named.groupBy("type").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean_salience"))


def label_frequency(images: DataFrame, n: int) -> DataFrame:
    rows = images.select(F.explode(F.split("labels", r"\|")).alias("label")).where("label <> ''")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(n)
