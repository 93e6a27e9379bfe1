"""Queries of the serving path: P19 encoded forms, P22 all request features, R10 the scored stream with its rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import models as M
from ..operators import serving as S
from ..sources.files import work_dir
from ..streaming import runs as R
from .base import query

#: State is fitted on forms before this day; customers who come later are breeds that it has not seen.
FITTED = "1995-09-01"
_CODE = lambda c, codes: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items()) + " END"
_NOT = {
    "pet_type": "pet_type IS NULL", "age_months": "age_months IS NULL OR age_months < 0 OR age_months > 255", "gender": "gender IS NULL", "breed1": "breed1 IS NULL", "maturity_size": "maturity_size NOT IN (1, 2, 3, 4)",
    "fur_length": "fur_length NOT IN (1, 2, 3)", "vaccinated": "vaccinated IS NULL", "dewormed": "dewormed IS NULL", "sterilized": "sterilized IS NULL", "health": "health IS NULL", "fee": "fee < 0", "quantity": "quantity < 1", "video_amt": "video_amt < 0",
}
_CODED = f"""SELECT request_id, submitted, owner_id, {_CODE('pet_type', S.PET_TYPES)} AS pet_type, CASE WHEN trim(name) <> '' THEN name END AS name, age_months, {_CODE('gender', S.GENDERS)} AS gender, breed1, nullif(breed2, 0) AS breed2,
 color1, nullif(color2, 0) AS color2, nullif(color3, 0) AS color3, maturity_size, fur_length, {', '.join(f'{_CODE(c, S.ANSWERS)} AS {c}' for c in ('vaccinated', 'dewormed', 'sterilized'))}, {_CODE('health', S.HEALTH)} AS health,
 coalesce(fee, 0.0) AS fee, coalesce(quantity, 1) AS quantity, state, video_amt, photos FROM forms_v"""
_ENC = f"enc AS (SELECT *, concat_ws(',', {', '.join(f'CASE WHEN {bad} THEN {chr(39)}{c}{chr(39)} END' for c, bad in _NOT.items())}) AS rejects FROM ({_CODED}) c)"
_CODES = ["request_id", "owner_id", "pet_type", "name", "age_months", "gender", "breed1", "breed2", "color1", "color2", "color3", "maturity_size", "fur_length", "vaccinated", "dewormed", "sterilized", "health", "fee", "quantity", "state", "video_amt", "photos", "rejects"]
query("P19_encode_form", f"WITH {_ENC} SELECT {', '.join(_CODES)} FROM enc")(lambda t: S.encode_forms(t.forms_v).select(*_CODES))


def _state_sql(until: str) -> str:
    return f"""tr AS (SELECT * FROM enc WHERE rejects = '' AND submitted < TIMESTAMP '{until}'),
 bs AS (SELECT breed1, count(*) * 1.0 / (SELECT count(*) FROM tr) AS share FROM tr GROUP BY breed1), ss AS (SELECT state, count(*) * 1.0 / (SELECT count(*) FROM tr) AS share FROM tr GROUP BY state),
 ow AS (SELECT owner_id, count(*) AS n, avg(photos) AS p, avg(fee) AS f FROM tr GROUP BY owner_id),
 df AS (SELECT avg(bs.share) AS b, avg(ss.share) AS s, avg(n) AS n, avg(p) AS p, avg(f) AS f FROM tr JOIN bs ON tr.breed1 = bs.breed1 JOIN ss ON tr.state = ss.state JOIN ow ON tr.owner_id = ow.owner_id)"""


_CARE = "CASE {0} WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN -1 END"
_SQL = {
    "is_dog": "CAST(pet_type = 1 AS INT)", "Gender": "gender", "MaturitySize": "maturity_size", "FurLength": "fur_length", "Health": "health",
    "Vaccinated": _CARE.format("vaccinated"), "Dewormed": _CARE.format("dewormed"), "Sterilized": _CARE.format("sterilized"),
    "health_care_score": "CAST(vaccinated = 1 AS INT) + CAST(dewormed = 1 AS INT) + CAST(sterilized = 1 AS INT)",
    "Age": "age_months", "log_age": "round(ln(1 + age_months), 6)", "age_bin": "CASE WHEN age_months <= 1 THEN 0 WHEN age_months <= 3 THEN 1 WHEN age_months <= 6 THEN 2 WHEN age_months <= 12 THEN 3 WHEN age_months <= 24 THEN 4 WHEN age_months <= 60 THEN 5 ELSE 6 END",
    "Fee": "fee", "log_fee": "round(ln(1 + fee), 6)", "is_free": "CAST(fee = 0 AS INT)", "fee_per_pet": "round(fee / greatest(quantity, 1), 6)",
    "Quantity": "quantity", "log_quantity": "round(ln(1 + quantity), 6)", "is_single_pet": "CAST(quantity = 1 AS INT)",
    "PhotoAmt": "photos", "log_photo_amt": "round(ln(1 + photos), 6)", "has_photos": "CAST(photos > 0 AS INT)", "VideoAmt": "video_amt", "has_video": "CAST(video_amt > 0 AS INT)",
    "has_name": "CAST(name IS NOT NULL AS INT)", "name_length": "CAST(coalesce(length(name), 0) AS INT)", "name_word_count": "CAST(coalesce(len(string_split_regex(trim(name), '\\s+')), 0) AS INT)",
    "Breed1": "e.breed1", "Breed2": "coalesce(breed2, 0)", "is_mixed_breed": "CAST(breed2 IS NOT NULL AS INT)", "breed_count": "1 + CAST(breed2 IS NOT NULL AS INT)", "breed1_frequency": "round(coalesce(bs.share, df.b), 6)",
    "Color1": "color1", "Color2": "coalesce(color2, 0)", "Color3": "coalesce(color3, 0)", "color_count": "CAST(color1 <> 0 AS INT) + CAST(color2 IS NOT NULL AS INT) + CAST(color3 IS NOT NULL AS INT)",
    "breed2_missing": "CAST(breed2 IS NULL AS INT)", "color2_missing": "CAST(color2 IS NULL AS INT)", "color3_missing": "CAST(color3 IS NULL AS INT)",
    "age_x_type": "age_months * CAST(pet_type = 1 AS INT)", "health_x_vaccinated": f"health * ({_CARE.format('vaccinated')})",
    "rescuer_pet_count": "round(df.n, 6)", "rescuer_mean_photo_amt": "round(df.p, 6)", "rescuer_mean_fee": "round(df.f, 4)", "state_freq": "round(coalesce(ss.share, df.s), 6)",
}
_REAL = {c: 4 if c == "rescuer_mean_fee" else 6 for c, e in _SQL.items() if e.startswith("round(")}


def _features_sql(until: str, columns=S.FEATURES, source="enc", more="", name="ft") -> str:
    cells = ", ".join(f'{_SQL[c]} AS "{c}"' for c in columns)
    head = f"{_ENC}, {_state_sql(until)}, " if name == "ft" else ""
    return f"{head}{name} AS (SELECT request_id{more}, {cells} FROM {source} e LEFT JOIN bs ON e.breed1 = bs.breed1 LEFT JOIN ss ON e.state = ss.state CROSS JOIN df WHERE rejects = '')"


def accepted_forms(t):
    """The accepted forms, encoded once and stored, spread evenly however the orders' file is cut. The rejects are
    filtered as they are read: a filter that Spark moved below the encoding would repeat all of it, in generated
    methods too long for the JVM to compile."""
    return S.save_state(S.encode_forms(t.forms_v).repartition("request_id"), work_dir(t.spark) + "/forms").where("rejects = ''")


def fitted_state(t, until: str, forms=None):
    """The state of the accepted forms before a day, stored."""
    forms = accepted_forms(t) if forms is None else forms
    train = forms.where(F.col("submitted") < F.lit(until).cast("timestamp"))
    return S.save_state(S.fit_state(train), work_dir(t.spark) + "/state")


def request_rows(t, until: str):
    forms = accepted_forms(t)
    rows = S.request_features(forms, fitted_state(t, until, forms))
    return rows.select("request_id", *[F.round(c, _REAL[c]).alias(c) if c in _REAL else c for c in S.FEATURES])


_ALL = f"SELECT request_id, {', '.join(chr(34) + c + chr(34) for c in S.FEATURES)} FROM ft"
query("P22_request_features", f"WITH {_features_sql(FITTED)} {_ALL}")(lambda t: request_rows(t, FITTED))
query("P22_request_features_all", f"WITH {_features_sql('2100-01-01')} {_ALL}")(lambda t: request_rows(t, "2100-01-01"))  # fitted on every accepted form: no key is unseen

# ---- R10: a model with given weights over fitted and plain serving features --------------------------
_COLUMNS = ["is_dog", "log_age", "age_bin", "log_fee", "is_single_pet", "log_photo_amt", "has_name", "is_mixed_breed", "breed1_frequency", "state_freq", "health_care_score", "health_x_vaccinated", "color_count", "has_video", "name_length"]
_SCALE = {"breed1_frequency": 40.0, "state_freq": 40.0, "name_length": 0.05}
MODEL = M.Linear([[((4 * k + 7 * j) % 13 - 6) / 20 * _SCALE.get(c, 1.0) for j, c in enumerate(_COLUMNS)] for k in range(5)], [0.2, 0.1, 0.3, 0.0, -0.1], tuple(_COLUMNS))


def score(features):
    """Key, class and expected value, the fitted features rounded as the SQL has them."""
    rows = features.withColumns({c: F.round(c, _REAL[c]) if c in _REAL else F.col(c).cast("double") for c in _COLUMNS})
    out = rows.withColumn("expected_value", MODEL.expected_value()).withColumn("predicted", E.by_thresholds(F.col("expected_value"), M.CUTS))
    return out.select(*[c for c in features.columns if c not in S.FEATURES], "predicted", "expected_value")


def rounded(df):
    return df.withColumn("expected_value", F.round("expected_value", 6))


def served(t):
    """The forms as a stream of order rows joined with the customers, scored."""
    state = fitted_state(t, FITTED)
    orders = R.event_stream(t.spark, t.sf_dir, "orders*.parquet", t.orders.schema)
    return S.serve_stream(t.over("forms_v", orders=orders), state, score, work_dir(t.spark) + "/served")


_E = ", ".join(f"exp({b} + " + " + ".join(f'({w}) * "{c}"' for w, c in zip(ws, _COLUMNS, strict=True)) + f") AS e{k}" for k, (ws, b) in enumerate(zip(MODEL.weights, MODEL.intercepts, strict=True)))
_CUTS = " + ".join(f"CAST(ev >= {c} AS INT)" for c in M.CUTS)
query("R10_request_stream_scores", f"WITH {_features_sql(FITTED, _COLUMNS)} SELECT request_id, {_CUTS} AS predicted, round(ev, 6) AS expected_value FROM (SELECT request_id, (e1 + 2 * e2 + 3 * e3 + 4 * e4) / (e0 + e1 + e2 + e3 + e4) AS ev FROM (SELECT request_id, {_E} FROM ft) x) y")(
    lambda t: rounded(served(t)[0])
)
query("R10_request_stream_rejects", f"WITH {_ENC} SELECT request_id, rejects FROM enc WHERE rejects <> ''")(lambda t: served(t)[1])

# ---- E13, E14: changed requests through P22 and the same model ---------------------------------------
def changed(t, changes):
    forms = accepted_forms(t)
    return changes(forms.drop("submitted"), fitted_state(t, FITTED, forms), score)


_VALUES = ", ".join(f"('{f}', '{v}', {i})" for i, (f, v) in enumerate((f, v) for f, values in S.GRID.items() for v in values))
_KIND = {"fee": "DOUBLE", "name": "VARCHAR"}
_SET = ", ".join(f"CASE WHEN feature = '{f}' THEN CAST(candidate AS {_KIND.get(c, 'INT')}) ELSE {c} END AS {c}" for f, c in S.FIELDS.items())
_KEEP = "request_id, pet_type, age_months, gender, breed1, breed2, color1, color2, color3, maturity_size, fur_length, health, state, rejects"


def _changed_sql(values: str, applies: str) -> str:
    """o: each request's class and expected value; n: those of each change."""
    score = lambda source, keep: f"(SELECT *, {_CUTS} AS cls FROM (SELECT {keep}, (e1 + 2 * e2 + 3 * e3 + 4 * e4) / (e0 + e1 + e2 + e3 + e4) AS ev FROM (SELECT {keep}, {_E} FROM {source}) x) y)"
    moved = f"mv AS (SELECT {_KEEP}, feature, candidate, g, {_SET} FROM (SELECT * FROM enc CROSS JOIN (VALUES {values}) v(feature, candidate, g) WHERE rejects = '' AND {applies}) c)"
    changed = _features_sql(FITTED, _COLUMNS, "mv", ", feature, candidate, g", "fm")
    return f"{_features_sql(FITTED, _COLUMNS)}, {moved}, {changed}, o AS {score('ft', 'request_id')}, n AS {score('fm', 'request_id, feature, candidate, g')}"


_CURRENT = "CASE feature " + " ".join(f"WHEN '{f}' THEN CAST({c} AS VARCHAR)" for f, c in S.FIELDS.items()) + " END"
query(
    "E14_change_grid",
    f"""WITH {_changed_sql(_VALUES, 'TRUE')}, b AS (SELECT n.*, o.cls - n.cls AS improvement FROM n JOIN o ON o.request_id = n.request_id WHERE n.cls < o.cls)
 SELECT b.request_id, feature, coalesce({_CURRENT}, 'None') AS current, candidate, b.cls AS new_class, improvement, CAST(row_number() OVER (PARTITION BY b.request_id ORDER BY improvement DESC, g) AS INT) AS place FROM b JOIN enc ON enc.request_id = b.request_id""",
)(lambda t: changed(t, S.change_grid))
_SINGLE = ", ".join(f"('{f}', '{v}', {i})" for i, (f, _, v, _) in enumerate(S.CHANGES))
_APPLIES = "CASE feature " + " ".join(f"WHEN '{f}' THEN {applies}" for f, _, _, applies in S.CHANGES) + " END"
_NAMED = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{name}'" for f, name, _, _ in S.CHANGES) + " END"
query(
    "E13_single_changes",
    f"""WITH {_changed_sql(_SINGLE, _APPLIES)}, b AS (SELECT n.request_id, feature, candidate, o.ev - n.ev AS gain, o.cls AS c0, n.cls AS c1 FROM n JOIN o ON o.request_id = n.request_id WHERE o.ev - n.ev > 1e-9 OR n.cls < o.cls)
 SELECT request_id, {_NAMED} AS feature, CASE WHEN feature = 'Name' THEN 'Yes' ELSE candidate END AS suggested, round(gain, 6) AS ev_gain, c1 < c0 AS class_improved,
 CASE WHEN c1 < c0 THEN printf('Improves adoption speed prediction from class %d to %d', c0, c1) ELSE printf('Improves expected adoption time score by %.2f', gain) END AS expected_impact, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(gain, 9) DESC, feature) AS INT) AS place FROM b""",
)(lambda t: changed(t, S.single_changes).withColumn("ev_gain", F.round("ev_gain", 6)))
