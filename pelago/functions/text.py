"""Text columns: preprocessing, statistics, tokens (X01-X10) and text checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.cleaning import nfkd

PLACEHOLDER = "no description"
#: English stop words of the token counts.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "this", "that", "these",
    "those", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "what",
    "which", "who", "whom", "when", "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "because", "as", "until", "while", "about", "between", "through",
    "during", "before", "after", "above", "below", "up", "down", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there",
    "if", "also", "s", "t", "don", "didn", "doesn", "won", "isn", "aren",
]


#: White space of every kind, and what is none, as Python has them (to stand inside brackets).
_SPACE = r"\s\x1c-\x1f"


#: Letters, digits and the underscore of every script (to stand inside brackets).
_WORD = r"\p{L}\p{N}_"


def preprocess(text: str) -> Column:
    """Placeholder for missing texts; tags, links, e-mail addresses and runs of space removed; NFKD.

    Every pattern is linear in the text: a tag is looked for only before the last `>`, and an address
    only where a run of its characters starts (or right behind a match), for it must reach an `@`."""
    c = F.col(text)
    after = F.substring_index(c, ">", -1)
    t = F.concat(F.regexp_replace(F.left(c, F.length(c) - F.length(after)), r"<[^>]++>", " "), after)
    link, address = rf"https?://[^{_SPACE}]++|www\.[^{_SPACE}]++", rf"(?:(?<![{_WORD}.+-])|\G)[{_WORD}.+-]++@[{_WORD}-]++\.[{_WORD}.-]++"
    t = F.regexp_replace(t, f"(?U){link}|{address}", " ")
    t = nfkd(F.trim(F.regexp_replace(t, rf"(?U)[{_SPACE}]+", " ")))  # the Python column is read twice, not made twice
    return F.when(F.coalesce(t, F.lit("")) == "", PLACEHOLDER).otherwise(t)


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U)[{_SPACE}]+"), lambda w: w != "")


def text_stats(df: DataFrame, text: str, mode: str = "training") -> DataFrame:
    """Length, words, sentences, mean word length and ratios; mode: training, serving or eda."""
    raw = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.regexp_replace(raw, rf"(?U)^[{_SPACE}]++|(?<![{_SPACE}])[{_SPACE}]++\z", "") if mode == "serving" else raw
    # what several columns read is made once: text, and word count with the length of all words
    sums = F.aggregate(words(F.col("_t")), F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars")), lambda s, w: F.struct((s["n"] + 1).alias("n"), (s["chars"] + F.length(w)).alias("chars")))
    df = df.withColumn("_t", trimmed).withColumn("_w", sums)
    t, n, n_words = F.col("_t"), F.length("_t"), F.col("_w.n")
    parts = F.split(t, r"[.!?]+")
    if mode == "serving":
        sentences, upper, punct = F.size(F.filter(parts, lambda p: p.rlike(rf"(?U)[^{_SPACE}]"))), r"\p{Lu}", rf"(?U)[^\p{{L}}\p{{N}}{_SPACE}]"
    else:
        sentences, upper, punct = F.size(parts), "[A-Z]", rf"(?U)[^\p{{L}}\p{{N}}_{_SPACE}]"
    least = F.greatest(n, F.lit(1))
    count = lambda p: F.regexp_count(t, F.lit(p))
    if mode == "eda":
        return df.withColumns({"char_length": n, "word_count": n_words, "sentence_count": F.greatest(F.size(parts) - 1, F.lit(0))}).drop("_t", "_w")
    out = {
        "description_length": n,
        "word_count": n_words,
        "sentence_count": F.greatest(sentences, F.lit(1)),
        "avg_word_length": F.when(n_words > 0, F.col("_w.chars") / n_words).otherwise(0.0),
        "uppercase_ratio": count(upper) / least,
        "punctuation_ratio": count(punct) / least,
        "digit_ratio": count(r"\p{Nd}") / least,
    }
    if mode == "serving":
        out = {k: F.when(n == 0, F.lit(0)).otherwise(v) for k, v in out.items()}
    return df.withColumns(out).drop("_t", "_w")


def tokens(text: str) -> Column:
    """Lower-case runs of letters without stop words and single letters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def token_counts(df: DataFrame, text: str, by: str | None = None) -> DataFrame:
    keys = [by] if by else []
    return df.select(*keys, F.explode(tokens(text)).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(df: DataFrame, text: str, k: int, by: str | None = None) -> DataFrame:
    counts = token_counts(df, text, by)
    w = (W.partitionBy(by) if by else W.partitionBy()).orderBy(F.desc("n"), "token")
    if by is None:  # a top-k needs no global window
        return counts.orderBy(F.desc("n"), "token").limit(k)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def language_profile(df: DataFrame, language: str, english: str = "en") -> DataFrame:
    """Rows and share of each language, and how far the whole is from English only."""
    counts = df.groupBy(F.coalesce(language, F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("language") == english, F.col("n")).otherwise(0)).alias("_en"))
    out = counts.crossJoin(F.broadcast(total))  # one row
    return out.select("language", "n", F.round(100.0 * F.col("n") / F.col("_all"), 2).alias("pct"), F.round(1 - F.col("_en") / F.col("_all"), 6).alias("multilingual_ratio"))


def guess_language(df: DataFrame, text: str, key: str, profiles: Mapping[str, Sequence[str]]) -> DataFrame:
    """The language whose stop words fill most of a text; the first by name of equals, unknown if none do."""
    found = words(F.lower(text))
    within = lambda p: F.size(F.filter(found, lambda w: w.isin(list(p))))
    hits = {lang: within(p) for lang, p in sorted(profiles.items())}
    most = F.greatest(*hits.values())
    out = F.when(most == 0, "unknown")
    for lang, n in hits.items():
        out = out.when(n == most, lang)
    return df.select(key, out.alias("language"))


def text_coverage(df: DataFrame, text: str) -> DataFrame:
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(text).alias("n_not_null"), F.count_if(~blank).alias("n_with_text"), F.round(F.count_if(~blank) / F.count(F.lit(1)), 6).alias("share"))


# ---- checks of written texts ---------------------------------------------------------------------
RAW_NAME = r"(img_emb_|text_emb_)\d+"
#: Wording that names each class, absent parts, and pet types.
CLASS_WORDS = {
    0: ["same-day", "same day", "immediately"], 1: ["1 week", "one week", "within a week", "7 days"], 2: ["1 month", "one month", "within a month", "30 days"],
    3: ["1-3 months", "one to three months", "1 to 3 months"], 4: ["not adopted", "100+ days", "100 days", "over 100"],
}
ABOUT_TEXT = ["description content", "text pattern", "description pattern", "write-up", "listing text", "text-based", "semantic pattern", "wording of the listing"]
ABOUT_IMAGE = ["photo quality", "image pattern", "visual pattern", "photo content", "image quality", "picture quality"]
TEXT_ABSENT = ["no description", "no text", "without a description", "no description content", "missing description", "description was not", "no listing text"]
IMAGE_ABSENT = ["no photos", "no images", "without photos", "photos were not", "missing photos"]
PET_WORDS = {"dog": ["dog", "puppy", "pup", "canine"], "cat": ["cat", "kitten", "kitty", "feline"]}


def has_any(c: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def explanation_reason(text: str, predicted: str) -> Column:
    """Why an explanation is rejected, by the first rule that fails; null if it is accepted."""
    t = F.trim(F.col(text))
    low, cls = F.lower(t), F.col(predicted)
    right = reduce(lambda a, b: a | b, [(cls == c) & has_any(low, w) for c, w in CLASS_WORDS.items()])
    wrong = reduce(lambda a, b: a | b, [(cls != c) & has_any(low, w) for c, w in CLASS_WORDS.items()])
    return F.when(F.coalesce(t, F.lit("")) == "", "empty").when(t.rlike(RAW_NAME), "raw name").when(F.length(t) < 50, "too short").when(wrong & ~right, "different class")


def description_reason(text: str, pet: str, least: int = 100, most: int = 400) -> Column:
    t = F.trim(F.col(text))
    low, n = F.lower(t), F.size(words(t))
    named = reduce(lambda a, b: a | b, [(F.lower(pet) == p) & has_any(low, w) for p, w in PET_WORDS.items()])
    return F.when(F.coalesce(t, F.lit("")) == "", "empty").when(t.rlike(RAW_NAME), "raw name").when(n < least, "too short").when(n > most, "too long").when((F.coalesce(F.col(pet), F.lit("")) != "") & ~F.coalesce(named, F.lit(False)), "pet type missing")


def absent_mentions(text: str, has_text: str, has_image: str) -> Column:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.when(~F.col(has_text) & has_any(low, ABOUT_TEXT), "text").when(~F.col(has_image) & has_any(low, ABOUT_IMAGE), "image")


def contradiction(text: str, text_share: Column, image_share: Column, has_text: Column, has_image: Column) -> Column:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.when(has_text & (text_share > 0.3) & has_any(low, TEXT_ABSENT), "text").when(has_image & (image_share > 0.3) & has_any(low, IMAGE_ABSENT), "image")
