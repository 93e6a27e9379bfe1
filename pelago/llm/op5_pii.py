"""Personal data: fixed patterns, and span classifiers trained by weak supervision.

Base spans (email, ip, card, phone) come from exact patterns. Further candidates are runs of
letters, digits and a few signs that carry digits, and bank numbers printed in groups of four. For each learned kind ("secret": credentials;
"account": bank and identity numbers) three labelers vote on each candidate: a regex labeler on its
shape, a gazetteer labeler on known prefixes, country codes and key words, and a context labeler on
what stands before it. The counts of the vote patterns over all documents, a table of at most
27 * 27 rows, feed one expectation-maximisation over the classes (none, and each kind), which
estimates how every labeler votes on every class: what speaks for one kind so speaks against the
other. Its posteriors are the soft targets of a logistic span classifier for each kind, fitted on a
bounded sample of distinct candidates. Candidates that a classifier accepts are added as spans of its kind, of the
likelier one if both do.

Defined results: a null or empty text has no spans; repeated rows are scanned alike; a kind that no
candidate has two labelers for has no classifier; without candidates only base spans are given; an
empty table gives an empty table; other columns are not read by find_spans() and pass through
redact().
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, table, written

#: The order of kinds at equal starts; the last two are the classifiers' own.
KINDS = ("email", "ip", "card", "phone", "secret", "account")
LEARNED = KINDS[4:]
#: Candidates that the classifier may be fitted on, its feature bins, and its threshold.
SAMPLE_ROWS, BINS, THRESHOLD = 4000, 512, 0.5
PRIOR_ROUNDS = 60

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Greedy runs are possessive: a later start inside a run that failed would fail as well.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/=-]{8,}+")
_PRINTED = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")
#: The gazetteer. Words that name a credential, and how issued tokens start.
SECRET_WORDS = frozenset(
    "password passwd pwd passphrase passcode pass pin token secret apikey api_key api_token access_key access_token auth auth_token authorization bearer client_secret credential credentials key private_key secret_key session_key signing_key webhook_secret refresh_token ssh_key encryption_key passwort kennwort geheimnis schluessel contrasena clave secreto motdepasse passe cle jeton".split()
)
SECRET_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "hf_", "npm_", "pypi-", "pk_live_", "pk_test_", "rk_live_", "sk-", "sk_live_", "sk_test_", "shpat_", "xoxa-", "xoxb-", "xoxp-", "ya29", "eyJ")
#: Words that name a bank or identity number, and the length of a bank number by country.
ACCOUNT_WORDS = frozenset("account acct iban bic ssn sin nin nif nie dni passport visa_no license licence taxid tax_id tin vat social_security national_id konto kontonummer ausweis steuernummer compte passeport cuenta pasaporte".split())
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24, "SK": 24}
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_IDENTITY = re.compile(r"[A-Z]{1,2}[0-9]{6,9}[A-Z]?|[0-9]{8}[A-Z]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    floor = 0
    while at >= 0:
        floor = max(floor, end)
        local = at - len(text[floor:at].rstrip(_LOCAL)) - floor
        if local and (m := _DOMAIN.match(text, at + 1)):
            yield at - local, m.end()
            end = m.end()
        floor = at + 1
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind as listed."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _clear(spans: Iterator[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans that touch none of taken; both by start."""
    i = 0
    for s, e in spans:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i == len(taken) or taken[i][0] >= e:  # by start: if this one lies behind, all others do
            yield s, e


def _printed(text: str) -> Iterator[tuple[int, int]]:
    """Bank numbers in groups of four, as long as their country has them if the groups end there."""
    m = _PRINTED.search(text)
    while m:
        n = IBAN_LENGTH.get(m[0][:2], 0)
        s, e = m.span()
        end = s + n + (n - 1) // 4  # a space stands before every fourth character but the first
        if n and end < e and text[end] == " ":
            e = end
        yield s, e
        m = _PRINTED.search(text, e)


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs with a digit, and printed bank numbers, that no base span touches."""
    if not _DIGIT.search(text):
        return []
    base = [(s, e) for _, s, e in taken]
    printed = list(_clear(_printed(text), base))
    runs = ((m.start(), m.end() - len(m[0]) + len(m[0].rstrip("=/+-_"))) for m in _CANDIDATE.finditer(text))
    return sorted([*printed, *_clear(runs, sorted(base + printed))])


def _value(text: str, s: int, e: int) -> tuple[str, str, str]:
    """The candidate without the spaces of a printed number, its key if it has the form key=value, and
    the 24 characters before it."""
    run, before = text[s:e].replace(" ", ""), text[max(0, s - 24) : s]
    key, eq, value = run.partition("=")
    return (value, key.lower(), before) if eq and value else (run, "", before)


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def votes(text: str, s: int, e: int) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """For each learned kind the votes of the regex, gazetteer and context labelers: 1 for, 0 against, 2 abstains."""
    value, key, before = _value(text, s, e)
    digits = sum(c in "0123456789" for c in value)
    word = (re.findall(r"[^\W\d]+", before)[-1:] or [""])[0].lower()
    named = bool(key) or bool(re.search(r"[=:]\s*[\"']?$", before))

    if re.fullmatch(r"[0-9a-f]{16,}|[A-Z0-9]{16,}|[A-Za-z0-9_-]{24,}", value) and 2 <= digits < len(value):
        shape = 1
    else:
        shape = 0 if digits < 2 or len(value) < 10 else 2
    gazetteer = 1 if value.startswith(SECRET_PREFIXES) or key in SECRET_WORDS or word in SECRET_WORDS else (0 if value.isdigit() else 2)
    context = 1 if named else (0 if re.search(r"[A-Za-z]\s$", before) and digits < 4 else 2)
    secret = (shape, gazetteer, context)

    plain = value.replace("-", "")
    iban = bool(_IBAN.fullmatch(plain))
    shape = 1 if iban and mod97(plain) or _SSN.fullmatch(value) or _IDENTITY.fullmatch(value) else (0 if digits < 5 or len(value) > 34 else 2)
    gazetteer = 1 if iban and IBAN_LENGTH.get(plain[:2]) == len(plain) or key in ACCOUNT_WORDS or word in ACCOUNT_WORDS else (0 if key in SECRET_WORDS or word in SECRET_WORDS else 2)
    context = 1 if named or re.search(r"\b(?:no|nr|number|nummer|num)\b[.:]?\s*$", before, re.I) else (0 if digits < 5 else 2)
    return secret, (shape, gazetteer, context)


def features(text: str, s: int, e: int) -> list[int]:
    """Hashed bins of shape, length, character mix and context."""
    value, key, before = _value(text, s, e)
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", value))))
    digits = sum(c in "0123456789" for c in value)
    named = [
        f"len{min(len(value) // 4, 16)}", f"mix{10 * digits // max(1, len(value))}", f"head{value[:4]}", f"key{key}", f"shape{shape[:6]}",
        f"before{before[-3:]}", f"word{(re.findall(r'[A-Za-z_]+', before) or [''])[-1].lower()}", f"hex{bool(re.fullmatch('[0-9a-f]+', value))}",
        f"upper{bool(re.fullmatch('[A-Z0-9]+', value))}", f"turns{min(len(shape) // 3, 8)}",
    ]
    return [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") % BINS for x in named]


def shares(votes: np.ndarray, prior: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The probability of each class for each row of votes."""
    like = np.log(prior) + sum(np.log(t[:, votes[:, j]]).T for j, t in enumerate(tables))
    q = np.exp(like - like.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


def em_kinds(patterns: list[tuple[tuple[int, ...], int]], kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Priors of the classes and the labelers' tables P(vote | class) from counts of vote patterns.

    Class 0 is no personal data, the others are the kinds, of which a candidate has one at most; a
    pattern has the votes of equally many labelers for each kind, kind by kind."""
    v = np.array([p for p, _ in patterns])
    c = np.array([k for _, k in patterns], float)
    n = v.shape[1]
    prior = np.full(kinds + 1, 1 / (kinds + 1))
    tables = np.empty((n, kinds + 1, 3))  # labeler, class, vote
    tables[:] = (0.45, 0.1, 0.45)
    tables[np.arange(n), np.arange(n) * kinds // n + 1] = (0.15, 0.5, 0.35)
    for _ in range(PRIOR_ROUNDS):
        q = shares(v, prior, tables) * c[:, None]
        prior = np.clip(q.sum(0) / c.sum(), 0.01, 0.99)
        prior /= prior.sum()
        for j in range(n):
            t = np.stack([np.bincount(v[:, j], w, 3) for w in q.T]) + 0.5
            tables[j] = t / t.sum(1, keepdims=True)
    return prior, tables


def em(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, np.ndarray]:
    """em_kinds() for one kind: its prior and the tables."""
    prior, tables = em_kinds(patterns, 1)
    return float(prior[1]), tables


def posterior(vote: tuple[int, ...], prior: float, tables: np.ndarray) -> float:
    return float(shares(np.array([vote]), np.array([1 - prior, prior]), tables)[0, 1])


def classifier(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights over the feature bins for soft targets; the last one is the bias."""
    w, b, seen = np.zeros(BINS), 0.0, np.full(BINS, 1e-8)
    for _ in range(200):
        err = (1 / (1 + np.exp(-np.clip(w[x].sum(1) + b, -30, 30))) - y) / len(y)
        g = np.bincount(x.ravel(), np.repeat(err, x.shape[1]), BINS) + 1e-4 * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
        b -= 0.3 * float(err.sum())
    return np.append(w, b)


def _digits(code: int) -> tuple[int, int, int]:
    """The three votes that a number below 27 stands for."""
    return code // 9, code // 3 % 3, code % 3


def fit(documents: DataFrame) -> dict[str, np.ndarray] | None:
    """Weights of each kind's classifier; None without any."""
    with scratch(documents.sparkSession):
        return _fit(documents)


def _fit(documents: DataFrame) -> dict[str, np.ndarray] | None:
    def listed(batches):
        for _, texts in slices(batches, "text"):
            rows: list[tuple] = []
            for raw in texts:
                if not re.search(rb"[0-9]", raw):
                    continue
                text = raw.decode("utf-8", "replace")
                for s, e in candidates(text, base_spans(text)):
                    value = text[max(0, s - 24) : e].encode()
                    codes = [9 * a + 3 * b + c for a, b, c in votes(text, s, e)]
                    rows.append((*codes, int.from_bytes(hashlib.blake2b(value, digest_size=7).digest(), "little"), features(text, s, e)))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], pa.int32()) for i in range(len(LEARNED))), pa.array([r[-2] for r in rows], pa.int64()), pa.array([r[-1] for r in rows], pa.list_(pa.int32()))],
                [*LEARNED, "h", "bins"],
            )

    found = written(documents.select("text").mapInArrow(listed, ", ".join(f"{k} int" for k in LEARNED) + ", h long, bins array<int>"), "candidates")
    patterns = [(tuple(_digits(r[k]) for k in LEARNED), r["count"]) for r in found.groupBy(*LEARNED).count().collect()]  # at most 27 * 27 rows
    kinds = [i for i in range(len(LEARNED)) if any(v[i].count(1) >= 2 for v, _ in patterns)]
    if not kinds:
        return None
    counts: dict[tuple, int] = {}
    for votes_of, n in patterns:
        vote = sum((votes_of[i] for i in kinds), ())
        counts[vote] = counts.get(vote, 0) + n
    prior, tables = em_kinds(sorted(counts.items()), len(kinds))
    distinct = found.select("h").distinct().count()  # copies must not thin the sample
    share = min(1.0, 8 * SAMPLE_ROWS / distinct)  # what each task sends stays small
    sample = found.where(F.col("h") <= int(share * (1 << 56))).dropDuplicates(["h"]).orderBy("h").limit(SAMPLE_ROWS).collect()
    x = np.array([r["bins"] for r in sample])
    y = shares(np.array([sum((_digits(r[LEARNED[i]]) for i in kinds), ()) for r in sample]), prior, tables)
    return {LEARNED[i]: classifier(x, y[:, 1 + j]) for j, i in enumerate(kinds)}


def all_spans(text: str, weights: dict[str, np.ndarray] | None) -> tuple[list, list]:
    base = base_spans(text)
    more = []
    if weights is not None:
        least = math.log(THRESHOLD / (1 - THRESHOLD))
        for s, e in candidates(text, base):
            bins = features(text, s, e)
            score, kind = max((w[bins].sum() + w[-1], k) for k, w in weights.items())
            if score > least:
                more.append((kind, s if " " in text[s:e] else e - len(_value(text, s, e)[0]), e))
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_spans(documents: DataFrame, weights: dict[str, np.ndarray] | None) -> DataFrame:
    """One row per document with the counts, the digest of the base spans and all spans."""

    def run(batches):
        empty = hashlib.sha256(b"").hexdigest()
        for batch, texts in slices(batches, "text"):
            counts, digests, spans = [], [], []
            for raw in texts:
                base, every = [], []
                if re.search(rb"[0-9@]", raw):
                    base, every = all_spans(raw.decode("utf-8", "replace"), weights)
                kinds = [k for k, _, _ in base]
                counts.append([kinds.count(k) for k in KINDS[:4]])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest() if base else empty)
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(digests), pa.array(spans)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redacted(text: str, weights: dict[str, np.ndarray] | None) -> str:
    out, at = [], 0
    for kind, s, e in all_spans(text, weights)[1]:
        if e <= at:
            continue
        out += [text[at : max(s, at)], f"[{kind.upper()}]"] if s >= at else []
        at = e
    return "".join((*out, text[at:]))


def redact(documents: DataFrame) -> DataFrame:
    """The same rows; every span found is replaced by its kind, and n_chars follows if it is there."""
    weights = fit(documents)

    def run(batches):
        for batch, texts in slices(batches, "text"):
            i = batch.schema.get_field_index("text")
            old = batch.column(i).to_pylist()
            new = [t if t is None or not re.search(rb"[0-9@]", raw) else redacted(t, weights) for t, raw in zip(old, texts, strict=True)]
            columns = list(batch.columns)
            columns[i] = pa.array(new, batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = documents.mapInArrow(run, documents.schema)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return find_spans(documents, fit(documents))
