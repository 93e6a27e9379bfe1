"""Serving: form rows to codes with rejects (P19), all tabular features from fitted state (P22), and the
scored request stream (R10).

Fitted state is one table (feature, key, value): the share of each key among the training rows, and
for every fitted feature a row without a key, its default. Batches and streams join the same table;
a stream joins it as a static side, so nothing is kept in the stream's state.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import cleaning
from . import features as X

#: Codes of the form's choices.
PET_TYPES = {"Dog": 1, "Cat": 2}
GENDERS = {"Male": 1, "Female": 2, "Mixed": 3}
ANSWERS = {"Yes": 1, "No": 2, "Not Sure": 3}
HEALTH = {"Healthy": 1, "Minor Injury": 2, "Serious Injury": 3}
#: What an absent field counts as; a field not named here must be there.
ABSENT = {"name": "", "breed2": 0, "color1": 0, "color2": 0, "color3": 0, "fee": 0.0, "quantity": 1, "state": 0, "video_amt": 0, "photos": 0}
#: Defaults where there are no training rows to fit them on.
UNFITTED = {"breed1_frequency": 0.001, "state_freq": 0.02, "rescuer_pet_count": 1.0, "rescuer_mean_photo_amt": 3.0, "rescuer_mean_fee": 0.0}
#: Key column of each fitted share.
SHARES = {"breed1_frequency": "breed1", "state_freq": "state"}
#: What a request takes from the state: the shares of its keys, and the defaults.
FITTED = [*SHARES, *[f"_{f}" for f in UNFITTED]]

#: What an owner can change and the candidate values, and the field of each.
GRID = {"PhotoAmt": [1, 3, 5, 7, 10], "VideoAmt": [0, 1, 2], "Vaccinated": [1], "Dewormed": [1], "Sterilized": [1], "Fee": [0, 10, 25, 50], "Name": ["Buddy"], "Quantity": [1]}
FIELDS = {"PhotoAmt": "photos", "VideoAmt": "video_amt", "Vaccinated": "vaccinated", "Dewormed": "dewormed", "Sterilized": "sterilized", "Fee": "fee", "Name": "name", "Quantity": "quantity"}
#: The single changes by effect on the expected value: feature, shown name, new value, when it applies.
CHANGES = [
    ("VideoAmt", "Video Amount", 1, "video_amt = 0"), ("Fee", "Adoption Fee", 0, "fee > 0"), ("Vaccinated", "Vaccinated", 1, "vaccinated <> 1"),
    ("Dewormed", "Dewormed", 1, "dewormed <> 1"), ("Sterilized", "Sterilized", 1, "sterilized <> 1"), ("Name", "Pet Name", "Buddy", "name is null"),
]

#: The serving features in order.
FEATURES = [
    "is_dog", "Gender", "MaturitySize", "FurLength", "Health", "Vaccinated", "Dewormed", "Sterilized", "health_care_score", "Age", "log_age", "age_bin", "Fee", "log_fee", "is_free", "fee_per_pet",
    "Quantity", "log_quantity", "is_single_pet", "PhotoAmt", "log_photo_amt", "has_photos", "VideoAmt", "has_video", "has_name", "name_length", "name_word_count", "Breed1", "Breed2", "is_mixed_breed",
    "breed_count", "breed1_frequency", "Color1", "Color2", "Color3", "color_count", "breed2_missing", "color2_missing", "color3_missing", "age_x_type", "health_x_vaccinated", "rescuer_pet_count",
    "rescuer_mean_photo_amt", "rescuer_mean_fee", "state_freq",
]


def encode_forms(forms: DataFrame) -> DataFrame:
    """Codes for the form's choices, null for zero second breeds and colors and for blank names, and in
    `rejects` the fields that break their domain, joined by commas (empty: accepted). Works on streams."""
    given = forms.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in ABSENT.items()})
    coded = given.withColumns(
        {"pet_type": cleaning.recode("pet_type", PET_TYPES), "gender": cleaning.recode("gender", GENDERS), "health": cleaning.recode("health", HEALTH)}
        | {c: cleaning.recode(c, ANSWERS) for c in ("vaccinated", "dewormed", "sterilized")}
        | {c: F.expr(f"nullif({c}, 0)") for c in ("breed2", "color2", "color3")}
        | {"name": F.when(cleaning.strip("name") != "", F.col("name"))}
    )
    known = lambda c: F.col(c).isNotNull()
    domains = {
        "pet_type": known("pet_type"), "age_months": F.col("age_months").between(0, 255), "gender": known("gender"), "breed1": known("breed1"), "maturity_size": F.col("maturity_size").between(1, 4),
        "fur_length": F.col("fur_length").between(1, 3), "vaccinated": known("vaccinated"), "dewormed": known("dewormed"), "sterilized": known("sterilized"), "health": known("health"),
        "fee": F.col("fee") >= 0, "quantity": F.col("quantity") >= 1, "video_amt": F.col("video_amt") >= 0,
    }
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in domains.items()]
    return coded.withColumn("rejects", F.concat_ws(",", *broken))


def fit_state(train: DataFrame, owner: str = "owner_id") -> DataFrame:
    """(feature, key, value) of accepted, encoded rows: shares by key, and the mean over the training
    rows of every fitted feature as its default."""
    row = lambda feature, key, value: [F.lit(feature).alias("feature"), key.cast("bigint").alias("key"), value.cast("double").alias("value")]
    none, parts = F.lit(None), []
    for feature, key in SHARES.items():
        counts = train.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n").cast("double").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))  # one row
        parts.append(counts.crossJoin(F.broadcast(total)).select(*row(feature, F.col(key), F.col("n") / F.col("total"))))
        parts.append(total.select(*row(feature, none, F.col("squares") / F.col("total") / F.col("total"))))
    n = F.col("n").cast("double")
    owners = train.groupBy(owner).agg(F.count(F.lit(1)).alias("n"), F.avg("photos").alias("photos"), F.avg("fee").alias("fee"))
    means = owners.agg((F.sum(n * n) / F.sum(n)).alias("count"), (F.sum(n * F.col("photos")) / F.sum(n)).alias("photos"), (F.sum(n * F.col("fee")) / F.sum(n)).alias("fee"))
    cells = [F.struct(*row(f, none, F.col(c))) for f, c in (("rescuer_pet_count", "count"), ("rescuer_mean_photo_amt", "photos"), ("rescuer_mean_fee", "fee"))]
    parts.append(means.select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts)


def save_state(state: DataFrame, path: str) -> DataFrame:
    """Write the fitted state, and give the stored table that batches and streams join."""
    state.write.mode("overwrite").parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def request_features(requests: DataFrame, state: DataFrame, keep: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """The columns in keep and FEATURES for encoded requests; keys that the state lacks, and requests'
    owners, who are unknown when serving, get the defaults. Works on streams."""
    return _features(_with_state(requests, state), keep)


def _with_state(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Encoded requests with the columns FITTED, from left joins with the state, whose size is left to
    the planner, and one join with a single row."""
    defaults = state.where("key is null").agg(*[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("value"))), F.lit(v)).alias(f"_{f}") for f, v in UNFITTED.items()])
    rows = requests
    for feature, key in SHARES.items():
        shares = state.where((F.col("feature") == feature) & F.col("key").isNotNull()).select(F.col("key").alias(f"_k_{key}"), F.col("value").alias(feature))
        rows = rows.join(shares, F.col(key) == F.col(f"_k_{key}"), "left")
    rows = rows.crossJoin(F.broadcast(defaults))  # one row
    return rows.select(*requests.columns, *FITTED)


def _features(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns in keep and FEATURES, row by row, for encoded requests with their columns FITTED."""
    whole = lambda c: F.col(c).cast("int")
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("int")
    zero = lambda c: F.coalesce(whole(c), F.lit(0))
    has = {c: flag(F.col(c).isNotNull()) for c in ("name", "breed2", "color2", "color3")}
    dog = flag(F.col("pet_type") == 1)
    out: dict[str, Column] = {
        "is_dog": dog, "Gender": whole("gender"), "MaturitySize": whole("maturity_size"), "FurLength": whole("fur_length"), "Health": whole("health"),
        "Vaccinated": X.care("vaccinated", serving=True), "Dewormed": X.care("dewormed", serving=True), "Sterilized": X.care("sterilized", serving=True),
        "health_care_score": X.count_equal(["vaccinated", "dewormed", "sterilized"], 1),
        "Age": whole("age_months"), "log_age": F.log1p("age_months"), "age_bin": X.right_closed_bin("age_months"),
        "Fee": F.col("fee"), "log_fee": F.log1p("fee"), "is_free": flag(F.col("fee") == 0), "fee_per_pet": X.per_unit("fee", "quantity"),
        "Quantity": whole("quantity"), "log_quantity": F.log1p("quantity"), "is_single_pet": flag(F.col("quantity") == 1),
        "PhotoAmt": whole("photos"), "log_photo_amt": F.log1p("photos"), "has_photos": flag(F.col("photos") > 0), "VideoAmt": whole("video_amt"), "has_video": flag(F.col("video_amt") > 0),
        "has_name": has["name"], "name_length": F.coalesce(F.length("name"), F.lit(0)), "name_word_count": F.coalesce(F.size(F.split(cleaning.strip("name"), r"(?U)\s+")), F.lit(0)),
        "Breed1": whole("breed1"), "Breed2": zero("breed2"), "is_mixed_breed": has["breed2"], "breed_count": 1 + has["breed2"], "breed1_frequency": F.coalesce("breed1_frequency", "_breed1_frequency"),
        "Color1": whole("color1"), "Color2": zero("color2"), "Color3": zero("color3"), "color_count": flag(F.col("color1") != 0) + has["color2"] + has["color3"],
        "breed2_missing": 1 - has["breed2"], "color2_missing": 1 - has["color2"], "color3_missing": 1 - has["color3"],
        "age_x_type": whole("age_months") * dog, "health_x_vaccinated": whole("health") * X.care("vaccinated", serving=True),
        "rescuer_pet_count": F.col("_rescuer_pet_count"), "rescuer_mean_photo_amt": F.col("_rescuer_mean_photo_amt"), "rescuer_mean_fee": F.col("_rescuer_mean_fee"),
        "state_freq": F.coalesce("state_freq", "_state_freq"),
    }
    return rows.select(*keep, *[out[c].alias(c) for c in FEATURES])


def _moved(encoded: DataFrame, changes: Column) -> DataFrame:
    """Each row with each of its changes, an array of (feature, candidate): the field set, and in `current` what it was."""
    rows = encoded.withColumn("_c", F.explode(changes)).select("*", "_c.*").drop("_c")
    is_ = lambda f: F.col("feature") == f
    current = F.coalesce(*[F.when(is_(f), F.col(c).cast("string")) for f, c in FIELDS.items()])
    kinds = dict(encoded.dtypes)
    return rows.withColumns({"current": current} | {c: F.when(is_(f), F.col("candidate").cast(kinds[c])).otherwise(F.col(c)) for f, c in FIELDS.items()})


def _compared(encoded: DataFrame, changes: Column, state: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores before and after each change. Rows carry their first score along, so nothing is joined by request,
    and what they have from the state, whose keys no change touches, so that is joined once."""
    rows = _with_state(encoded, state)
    base = score(_features(rows.withColumn("_row", F.struct(*rows.columns)), ("_row",)))
    rows = base.select("_row.*", F.struct(F.col("predicted").alias("class0"), F.col("expected_value").alias("ev0")).alias("_was"))
    moved = _moved(rows, changes)
    facts = F.struct("feature", "candidate", "current", "_was.class0", "_was.ev0")
    after = score(_features(moved.withColumn("_row", facts), ("request_id", "_row")))
    # a filter on a score that Spark moved below this step would repeat the whole model in every term; it
    # is not moved past a partition number, as long as that is read
    return after.select("request_id", "_row.*", F.col("predicted").alias("class1"), F.col("expected_value").alias("ev1"), F.spark_partition_id().alias("_here"))


def change_grid(encoded: DataFrame, state: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every candidate of GRID that differs from the request's own value and lowers the class, with `improvement`
    in classes and its place in the request's list (by improvement, then the grid's order)."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(str(v)).alias("candidate")) for f, values in GRID.items() for v in values])
    out = _compared(encoded, cells, state, score).withColumn("improvement", F.col("class0") - F.col("class1")).where("improvement > 0 and _here >= 0")
    order = F.array_position(F.array(*[F.lit(f"{f}={v}") for f, values in GRID.items() for v in values]), F.concat_ws("=", "feature", "candidate"))
    place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("improvement"), order))
    return out.select("request_id", "feature", F.coalesce("current", F.lit("None")).alias("current"), "candidate", F.col("class1").alias("new_class"), "improvement", place.alias("place"))


def single_changes(encoded: DataFrame, state: DataFrame, score: Callable[[DataFrame], DataFrame], least: float = 1e-9) -> DataFrame:
    """The single changes that apply to a request and lower its class or its expected value, the largest gain
    first, with a text on the effect."""
    made = F.array_compact(F.array(*[F.when(F.expr(applies), F.struct(F.lit(f).alias("feature"), F.lit(str(v)).alias("candidate"))) for f, _, v, applies in CHANGES]))
    out = _compared(encoded, made, state, score).withColumn("ev_gain", F.col("ev0") - F.col("ev1")).withColumn("class_improved", F.col("class1") < F.col("class0"))
    out = out.where(((F.col("ev_gain") > least) | F.col("class_improved")) & (F.col("_here") >= 0))
    place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc(F.round("ev_gain", 9)), "feature"))
    out = out.select("request_id", "feature", "candidate", "class0", "class1", "ev_gain", "class_improved", place.alias("place"))  # the texts come after the shuffle
    shown = F.create_map(*[F.lit(x) for f, name, _, _ in CHANGES for x in (f, name)])[F.col("feature")]
    text = F.when(F.col("class_improved"), F.format_string("Improves adoption speed prediction from class %d to %d", "class0", "class1")).otherwise(F.format_string("Improves expected adoption time score by %.2f", "ev_gain"))
    return out.select("request_id", shown.alias("feature"), F.when(F.col("feature") == "Name", "Yes").otherwise(F.col("candidate")).alias("suggested"), "ev_gain", "class_improved", text.alias("expected_impact"), "place")


def serve_stream(forms: DataFrame, state: DataFrame, score: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """Encode, build and score a stream of forms over what is there; gives (scored rows, rejected rows).

    Both come from one plan without state and one write for each micro-batch, parted by `rejected`.
    A batch that runs again after a failure writes over its own folder, so no row is lost or doubled."""
    spark = forms.sparkSession
    rows = score(request_features(encode_forms(forms), state, ("request_id", "rejects"))).withColumn("rejected", F.col("rejects") != "")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").partitionBy("rejected").parquet(f"{path}/batch={epoch}")

    keep(spark.createDataFrame([], rows.schema), -1)  # so that the table exists without a row
    query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(rows.schema).option("basePath", path).parquet(path)
    return out.where("not rejected").drop("rejects", "rejected", "batch"), out.where("rejected").select("request_id", "rejects")
