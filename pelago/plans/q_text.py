"""Queries X01-X14 and J01-J06 on documents, conversations, and annotation documents made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import text as T
from ..operators import cleaning as C
from ..operators.stats import quantiles
from .base import query

query("X01_preprocess_stats", "SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS n_null, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS n_empty_or_null, round(avg(length(text)), 4) AS mean_length, round(median(length(text)), 4) AS median_length, CAST(min(length(text)) AS INT) AS min_length, CAST(max(length(text)) AS INT) AS max_length FROM documents")(
    lambda t: t.documents.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull()).alias("n_null"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_empty_or_null"), F.round(F.avg(F.length("text")), 4).alias("mean_length"),
        F.min(F.length("text")).alias("min_length"), F.max(F.length("text")).alias("max_length"),
    ).crossJoin(quantiles(t.documents.select(F.length("text").alias("length")), "length", [0.5]).select(F.round("q0", 4).alias("median_length")))
)
#: White space of every kind for the SQL, whose own classes are ASCII.
_WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_WORDS = f"list_filter(string_split_regex(x, '[{_WS}]+'), lambda v: v <> '')"
_RAW = "(SELECT *, coalesce(text, '') AS x FROM documents)"
_LINKS = rf"https?://[^{_WS}]+|www\.[^{_WS}]+|[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+"
_SPACED = f"regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '{_LINKS}', ' ', 'g'), '[{_WS}]+', ' ', 'g')"
_STATS = rf"""SELECT doc_id, CAST(length(x) AS INT) AS description_length, CAST(len(w) AS INT) AS word_count, CAST(greatest(len(string_split_regex(x, '[.!?]+')), 1) AS INT) AS sentence_count,
 round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda v: length(v))) * 1.0 / len(w) ELSE 0 END, 6) AS avg_word_length, round(len(regexp_extract_all(x, '[A-Z]')) * 1.0 / greatest(length(x), 1), 6) AS uppercase_ratio,
 round(len(regexp_extract_all(x, '[^\p{{L}}\p{{N}}_{_WS}]')) * 1.0 / greatest(length(x), 1), 6) AS punctuation_ratio, round(len(regexp_extract_all(x, '\p{{Nd}}')) * 1.0 / greatest(length(x), 1), 6) AS digit_ratio
 FROM (SELECT *, {_WORDS} AS w FROM {_RAW} r) s"""
_EDA = f"SELECT doc_id, CAST(length(x) AS INT) AS char_length, CAST(len({_WORDS}) AS INT) AS word_count, CAST(greatest(len(string_split_regex(x, '[.!?]+')) - 1, 0) AS INT) AS sentence_count FROM {_RAW} r"
_SERVING = rf"""SELECT doc_id, CAST(length(x) AS INT) AS description_length, CAST(CASE WHEN x = '' THEN 0 ELSE greatest(len(list_filter(string_split_regex(x, '[.!?]+'), lambda v: regexp_matches(v, '[^{_WS}]'))), 1) END AS INT) AS sentence_count,
 round(len(regexp_extract_all(x, '[^\p{{L}}\p{{N}}{_WS}]')) * 1.0 / greatest(length(x), 1), 6) AS punctuation_ratio FROM (SELECT doc_id, regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS x FROM {_RAW} r) s"""
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOK = f"list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"
_RATIOS = ("avg_word_length", "uppercase_ratio", "punctuation_ratio", "digit_ratio")
#: On every document, null texts and all scripts included. X01 ends in a normal form that SQL lacks: a test
#: compares it with plain Python, and X01_preprocess_composed checks the rest of it.
_X = {
    "X01_preprocess_text": (lambda d: d.select("doc_id", T.preprocess("text").alias("text")), None),
    "X02_text_stats": (lambda d: T.text_stats(d, "text").select("doc_id", "description_length", "word_count", "sentence_count", *[F.round(c, 6).alias(c) for c in _RATIOS]), _STATS),
    "X03_text_stats_eda": (lambda d: T.text_stats(d, "text", "eda").select("doc_id", "char_length", "word_count", "sentence_count"), _EDA),
    "X04_text_stats_serving": (
        lambda d: T.text_stats(d, "text", "serving").select("doc_id", F.col("description_length").cast("int").alias("description_length"), F.col("sentence_count").cast("int").alias("sentence_count"), F.round("punctuation_ratio", 6).alias("punctuation_ratio")),
        _SERVING,
    ),
    "X05_tokenize": (lambda d: d.select("doc_id", T.tokens("text").alias("tokens")), f"SELECT doc_id, {_TOK} AS tokens FROM documents"),
    "X06_word_frequency": (lambda d: T.top_tokens(d, "text", 30), f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOK}) AS token FROM documents) s GROUP BY token ORDER BY n DESC, token LIMIT 30"),
    "X06_word_frequency_by_class": (
        lambda d: T.top_tokens(d, "text", 10, "lang"),
        f"SELECT * FROM (SELECT lang, token, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS INT) AS rank FROM (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({_TOK}) AS token FROM documents) s GROUP BY lang, token) u) v WHERE rank <= 10",
    ),
}
for _name, (_f, _sql) in _X.items():
    for _id in (_name, f"{_name}_all"):  # the second name is of a time when the first left rows out
        query(_id, _sql)(lambda t, f=_f: f(t.documents))
query("X01_preprocess_composed", f"SELECT doc_id, CASE WHEN trim({_SPACED}) = '' THEN 'no description' ELSE nfc_normalize(trim({_SPACED})) END AS text FROM {_RAW} r")(
    lambda t: t.documents.select("doc_id", C.nfc(T.preprocess("text")).alias("text"))
)
query("X07_language_profile", "SELECT lang AS language, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct, round(1 - (SELECT count(*) FROM documents WHERE lang = 'en') * 1.0 / (SELECT count(*) FROM documents), 6) AS multilingual_ratio FROM documents GROUP BY lang")(
    lambda t: T.language_profile(t.documents, "lang")
)
PROFILES = {"de": ["der", "die", "und", "das"], "en": ["the", "and", "of", "to"], "es": ["el", "que", "los", "y"], "fr": ["le", "et", "les", "des"]}
query(
    "X07_guess_language",
    "SELECT doc_id, CASE WHEN greatest(" + ", ".join(f"h_{k}" for k in sorted(PROFILES)) + ") = 0 THEN 'unknown' " + " ".join(f"WHEN h_{k} = greatest({', '.join(f'h_{j}' for j in sorted(PROFILES))}) THEN '{k}'" for k in sorted(PROFILES)) + " END AS language FROM (SELECT doc_id, "
    + ", ".join("len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{v}'" for v in p) + f"))) AS h_{k}" for k, p in sorted(PROFILES.items())) + r" FROM (SELECT doc_id, string_split_regex(lower(text), '\s+') AS w FROM documents) s) u",
)(lambda t: T.guess_language(t.documents, "text", "doc_id", PROFILES))
query("X08_text_coverage", "SELECT count(*) AS n, count(text) AS n_not_null, count(*) FILTER (WHERE coalesce(trim(text), '') <> '') AS n_with_text, round(count(*) FILTER (WHERE coalesce(trim(text), '') <> '') * 1.0 / count(*), 6) AS share FROM documents")(lambda t: T.text_coverage(t.documents, "text"))
query("X10_unicode_normalize", "SELECT doc_id, nfc_normalize(text) = text AS same, sha256(nfc_normalize(text)) AS sha FROM documents")(
    lambda t: t.documents.withColumn("n", C.nfc("text")).select("doc_id", (F.col("n") == F.col("text")).alias("same"), F.sha2("n", 256).alias("sha"))
)

# ---- checks on conversation texts: some get a phrase by their number ---------------------------------
_TALK = """SELECT conv_id, turn, CAST(conv_id % 5 AS INT) AS cls, CASE CAST((conv_id + turn) % 8 AS INT) WHEN 0 THEN '' WHEN 1 THEN text || ' text_emb_12' WHEN 2 THEN 'likely adopted within a week, ' || text WHEN 3 THEN 'no description, no photos: ' || text WHEN 4 THEN 'the listing text and photo quality: ' || text WHEN 5 THEN 'a puppy: ' || text ELSE text END AS text FROM conversations"""
_low = "lower(trim(text))"


def _talk(t):
    return t.spark.sql(_TALK.replace("conversations", "{c}"), c=t.conversations)


def _any(words, low=_low):
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


_RIGHT = " OR ".join(f"(cls = {c} AND {_any(w)})" for c, w in T.CLASS_WORDS.items())
_WRONG = " OR ".join(f"(cls <> {c} AND {_any(w)})" for c, w in T.CLASS_WORDS.items())
query("X11_reject_report_text", f"SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(trim(text), '(img_emb_|text_emb_)[0-9]+') THEN 'raw name' WHEN length(trim(text)) < 50 THEN 'too short' WHEN ({_WRONG}) AND NOT ({_RIGHT}) THEN 'different class' END AS reason FROM ({_TALK}) s")(
    lambda t: _talk(t).select("conv_id", "turn", T.explanation_reason("text", "cls").alias("reason"))
)
_PETS = " OR ".join(f"(pet = '{p}' AND {_any(w)})" for p, w in T.PET_WORDS.items())
query("X12_reject_description_text", rf"SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(trim(text), '(img_emb_|text_emb_)[0-9]+') THEN 'raw name' WHEN n < 10 THEN 'too short' WHEN n > 40 THEN 'too long' WHEN NOT ({_PETS}) THEN 'pet type missing' END AS reason FROM (SELECT *, len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) AS n, CASE WHEN cls < 3 THEN 'dog' ELSE 'cat' END AS pet FROM ({_TALK}) s) u")(
    lambda t: _talk(t).withColumn("pet", F.when(F.col("cls") < 3, "dog").otherwise("cat")).select("conv_id", "turn", T.description_reason("text", "pet", 10, 40).alias("reason"))
)
query("X13_absent_modality_mentions", f"SELECT conv_id, turn, CASE WHEN NOT (cls < 2) AND {_any(T.ABOUT_TEXT, 'lower(text)')} THEN 'text' WHEN NOT (cls > 2) AND {_any(T.ABOUT_IMAGE, 'lower(text)')} THEN 'image' END AS mention FROM ({_TALK}) s")(
    lambda t: _talk(t).withColumns({"ht": F.col("cls") < 2, "hi": F.col("cls") > 2}).select("conv_id", "turn", T.absent_mentions("text", "ht", "hi").alias("mention"))
)
query("X14_contradiction_check", f"SELECT conv_id, turn, CASE WHEN cls < 4 AND cls * 0.2 > 0.3 AND {_any(T.TEXT_ABSENT, 'lower(text)')} THEN 'text' WHEN cls > 0 AND (4 - cls) * 0.2 > 0.3 AND {_any(T.IMAGE_ABSENT, 'lower(text)')} THEN 'image' END AS issue FROM ({_TALK}) s")(
    lambda t: _talk(t).select("conv_id", "turn", T.contradiction("text", F.col("cls") * 0.2, (4 - F.col("cls")) * 0.2, F.col("cls") < 4, F.col("cls") > 0).alias("issue"))
)

# ---- annotation documents: one per order, its lines as sentences, entities, labels and colours ------
_SCORE = "CAST(l_quantity AS DOUBLE) / 50"


def sentiment_docs(t):
    """JSON texts with the shape of sentiment documents, made of orders and their lines."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", F.struct(F.struct((F.col("l_quantity") / 50).alias("score"), (F.col("l_quantity") / 32).alias("magnitude")).alias("sentiment")).alias("s"),
                                             F.struct(F.concat(F.lit("Part"), F.col("l_partkey") % 9).alias("name"), F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("T"), F.col("l_suppkey") % 11)).alias("type"), (F.col("l_quantity") / 128).alias("salience")).alias("e")))).alias("l")
    )
    rows = t.orders.select(F.col("o_orderkey").alias("k"), "o_totalprice").join(lines, "k", "left")
    doc = F.struct(
        F.when(F.col("k") % 3 != 0, F.struct((F.col("k") % 16 / 16).alias("score"), (F.col("k") % 8 / 8).alias("magnitude"))).alias("documentSentiment"),
        F.transform("l", lambda x: x["s"]).alias("sentences"), F.transform("l", lambda x: x["e"]).alias("entities"), F.when(F.col("k") % 4 != 0, "en").alias("language"),
    )
    return D.parsed(rows.select("k", F.to_json(doc).alias("doc")), "doc", D.SENTIMENT)


def vision_docs(t):
    """JSON texts with the shape of vision documents: one for each order line."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    color = lambda d: F.struct(F.struct((F.col("l_quantity") + d).alias("red"), F.lit(3.0).alias("green"), (F.col("l_suppkey") % 7).cast("double").alias("blue")).alias("color"))
    doc = F.struct(
        F.when(F.col("l_linenumber") != 3, F.array(F.struct(F.concat(F.lit("L"), F.col("l_partkey") % 13).alias("description"), (F.col("l_quantity") / 50).alias("score")), F.struct(F.concat(F.lit("M"), F.col("l_suppkey") % 5).alias("description"), F.lit(0.25).alias("score")))).alias("labelAnnotations"),
        F.struct(F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.array(color(0), color(6))).otherwise(F.array(color(3))).alias("colors")).alias("dominantColors")).alias("imagePropertiesAnnotation"),
        F.struct(F.array(F.struct((F.col("l_quantity") / 50).alias("confidence"))).alias("cropHints")).alias("cropHintsAnnotation"),
    )
    return D.parsed(rows.select("k", "l_linenumber", F.to_json(doc).alias("doc")), "doc", D.VISION)


_LINES = f"SELECT l_orderkey AS k, count(*) AS n, avg({_SCORE}) AS m, avg(l_quantity / 32) AS g, min({_SCORE}) AS lo, max({_SCORE}) AS hi, var_pop({_SCORE}) AS v, count(DISTINCT CASE WHEN l_linenumber % 4 <> 0 THEN 'T' || (l_suppkey % 11) ELSE 'UNKNOWN' END) AS kinds FROM lineitem GROUP BY 1"
_J = f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN round(o_orderkey % 16 / 16.0, 4) ELSE 0.0 END AS score, CASE WHEN o_orderkey % 3 <> 0 THEN round(o_orderkey % 8 / 8.0, 4) ELSE 0.0 END AS magnitude, CAST(coalesce(n, 0) AS INT) AS n_sentences, round(coalesce(m, 0), 4) AS mean_sentence_score, round(coalesce(g, 0), 4) AS mean_sentence_magnitude, CAST(coalesce(n, 0) AS INT) AS entity_count, CASE WHEN o_orderkey % 4 <> 0 THEN 'en' ELSE '' END AS language"
_FROM = f" FROM orders LEFT JOIN ({_LINES}) l ON o_orderkey = k"
query("J01_parse_sentiment", _J + _FROM)(
    lambda t: D.sentiment_features(sentiment_docs(t), "k").select("k", "score", "magnitude", "n_sentences", "mean_sentence_score", "mean_sentence_magnitude", "entity_count", "language")
)
query("J02_sentiment_features", "SELECT o_orderkey AS k, round(coalesce(lo, 0), 6) AS min_sentence_score, round(coalesce(hi, 0), 6) AS max_sentence_score, round(coalesce(v, 0), 6) AS sentiment_variance, CAST(coalesce(kinds, 0) AS INT) AS entity_type_count" + _FROM)(
    lambda t: D.sentiment_features(sentiment_docs(t), "k").select("k", "min_sentence_score", "max_sentence_score", "sentiment_variance", "entity_type_count")
)
_LAB = "'L' || (l_partkey % 13) || '|' || 'M' || (l_suppkey % 5)"
_V = f"""SELECT l_orderkey AS k, l_linenumber, CAST(CASE WHEN l_linenumber <> 3 THEN 2 ELSE 0 END AS INT) AS n_labels, CASE WHEN l_linenumber <> 3 THEN 'L' || (l_partkey % 13) ELSE '' END AS top_label, CASE WHEN l_linenumber <> 3 THEN round({_SCORE}, 4) ELSE 0.0 END AS top_score, CASE WHEN l_linenumber <> 3 THEN {_LAB} ELSE '' END AS labels,
 CAST(CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n_colors, round((l_quantity + 3 + 3 + l_suppkey % 7) / 3, 4) AS brightness, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 0.0 END AS brightness_std, round({_SCORE}, 4) AS crop_confidence FROM lineitem"""
query("J03_parse_vision", _V.replace("0.0", "CAST(0 AS DOUBLE)").replace("1.0", "CAST(1 AS DOUBLE)"))(lambda t: D.vision_features(vision_docs(t), "k", "l_linenumber"))
query("J04_vision_features_by_key", f"SELECT k, round(avg(n_labels), 4) AS mean_n_labels, round(avg(n_colors), 4) AS mean_n_colors, round(avg(brightness_std), 4) AS mean_brightness_std FROM ({_V}) s GROUP BY k")(
    lambda t: D.vision_by_key(D.vision_features(vision_docs(t), "k", "l_linenumber"), "k").select("k", "mean_n_labels", "mean_n_colors", "mean_brightness_std")
)
_ENT = "SELECT 'part' || (l_partkey % 9) AS name, CASE WHEN l_linenumber % 4 <> 0 THEN 'T' || (l_suppkey % 11) ELSE 'UNKNOWN' END AS type, l_quantity / 128 AS salience FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
query("J05_entity_analysis", f"WITH e AS ({_ENT}), c AS (SELECT type, count(*) AS n, sum(salience) AS s FROM e GROUP BY type), k AS (SELECT type FROM c ORDER BY n DESC, type LIMIT 8) SELECT CASE WHEN type IN (SELECT type FROM k) THEN type ELSE 'Other' END AS type, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 4) AS mean_salience FROM c GROUP BY 1")(
    lambda t: D.entity_types(D.entities(sentiment_docs(t), "k"))
)
query("J05_entity_names", f"SELECT name, count(*) AS n FROM ({_ENT}) e GROUP BY name ORDER BY n DESC, name LIMIT 20")(lambda t: D.entities(sentiment_docs(t), "k").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(20))
query("J06_label_frequency", f"SELECT label, count(*) AS n FROM (SELECT unnest(string_split({_LAB}, '|')) AS label FROM lineitem WHERE l_linenumber <> 3) s GROUP BY label ORDER BY n DESC, label LIMIT 10")(
    lambda t: D.label_frequency(D.vision_features(vision_docs(t), "k", "l_linenumber"), 10)
)
