"""Language identification by interpolated Kneser-Ney character models.

A text is read as lower-case letters, everything between them being one space. Four neighbouring
characters of 16 bits make a gram of 64 bits, so a gram's ending and its context are bit operations
on columns. Spark counts the grams of every training document, and joins of the counts with their
own groups give the Kneser-Ney estimates: counts at order 4, numbers of different preceding
characters below, one discount for each language and order. The model keeps, for each language and
order, a sorted array of gram hashes with the discounted shares, and one of context hashes with what
is left for the next lower order.

The predicted language has the lowest cross-entropy per character. One of eight training documents,
by a hash of the id, is kept out of the counts: from their margins Spark makes a histogram, on which
the score (how likely the prediction is right) is fitted, and from which the rejection takes its
limits: the least score whose texts are right in 99 of 100 cases, and for each length of text the
cross-entropy beyond which it reads like none of the languages.

The counts grow with the input, and no gram is left out. A model of at most ENTRIES grams is held in
memory by every task. A larger one stays a table: joins with the grams of the documents at hand give
the bits of each in every language, the most frequent of these grams (ENTRIES numbers at most) go to
the tasks, which add them up, and the others are joined by gram and summed by document.

Defined results: a null text, and one without letters, is `und` with score 0; without any usable
training document every text is; a text that all languages fit alike goes to the first by name; a
document without lang or doc_id is not learned from; repeated rows are counted and scored each; an
empty table gives an empty table; further columns are not read. A text beyond PIECE bytes is scored
in pieces cut at spaces, so that a task's memory doesn't grow with it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import outlives, scratch, slices, table, written
from .textvec import Texts, U, mix

#: Characters of a gram (16 bits each), and most grams, over all languages, that a task holds.
ORDER, ENTRIES = 4, 1 << 21
#: Bytes of text worked on at once, and grams that a task holds before it sends them on.
PIECE, HELD = 1 << 21, 1 << 20
#: What an unseen character gets: one of all 16-bit ones.
UNIFORM = 1 / 65536
#: Cells of the calibration histogram, each of this width on the scale of log1p(bits of margin).
CELLS, WIDTH = 64, 0.25
#: Share of right predictions that the rejection asks for, and standard deviations of the cross-entropy that it grants.
PRECISION, DEVIATIONS = 0.99, 6.0
UNKNOWN = "und"
_SEEDS = [U(0x9E3779B97F4A7C15 * k & (2**64 - 1)) for k in range(1, 2 * ORDER + 1)]


@cache
def _letters() -> np.ndarray:
    """The lower-case letter of each 16-bit code point; 32 where there is none."""
    return np.array([ord(chr(c).lower()[0]) & 0xFFFF if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint16)


def _folded(points: np.ndarray) -> np.ndarray:
    """Code points as 16-bit letters; letters beyond 16 bits share the private area."""
    out = _letters()[points & np.uint32(0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        c = chr(int(points[i]))
        out[i] = 0xE000 + ord(c.lower()[0]) % 6400 if c.isalpha() else 32
    return out


def pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The texts in pieces of about PIECE bytes at most, and the text of each piece."""
    if all(len(t) <= PIECE for t in texts):
        return texts, np.arange(len(texts))
    out, owner = [], []
    for i, t in enumerate(texts):
        start = 0
        while True:
            end = len(t)
            if end - start > PIECE:
                end = t.rfind(b" ", start + 1, start + PIECE)
                if end < 0:
                    end = start + PIECE
                    while t[end] & 0xC0 == 0x80:  # inside a character
                        end -= 1
            out.append(t[start:end])
            owner.append(i)
            start = end
            if start >= len(t):
                break
    return out, np.array(owner)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts in order, and how many each text has. Before a text stand spaces; a
    text without letters has no gram."""
    points, starts = Texts(texts).characters()
    c = _folded(points)
    keep = (c != 32) | (np.concatenate(([32], c[:-1])) != 32)
    c = c[keep].astype(U)
    first = np.concatenate(([0], np.cumsum(keep)))[starts]
    sizes = np.diff(first)
    code = c.copy()
    for j in range(1, ORDER):
        before = np.concatenate((np.full(j, 32, U), c[:-j]))[: len(c)]
        for i in range(j):  # the first characters of a text have spaces before them
            at = first[:-1][sizes > i] + i
            before[at] = 32
        code |= before << U(16 * j)
    return code, sizes


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate(codes)
    order = np.argsort(code)
    code, n = code[order], np.concatenate(counts)[order]
    at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[at], np.add.reduceat(n, at)


def gram_counts(documents: DataFrame) -> DataFrame:
    """(lang, gram, n) of documents (lang, text): counts over all of them."""

    def send(held):
        for lang, (codes, counts) in held.items():
            code, n = _merged(codes, counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    def run(batches):
        held, size = {}, 0
        for batch, texts in slices(batches, "text", PIECE):
            langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist())
            for lang in np.unique(langs).tolist():
                parts, _ = pieces([texts[i] for i in np.flatnonzero(langs == lang)])
                for i in range(0, len(parts), 4096):
                    code, _ = grams(parts[i : i + 4096])
                    if len(code):
                        codes, counts = held.setdefault(lang, ([], []))
                        code, n = np.unique(code, return_counts=True)
                        codes.append(code)
                        counts.append(n)
                        size += len(code)
            if size > HELD:
                for lang, (codes, counts) in held.items():
                    code, n = _merged(codes, counts)
                    held[lang] = ([code], [n])
                size = sum(len(codes[0]) for codes, _ in held.values())
                if size > HELD // 2:
                    yield from send(held)
                    held, size = {}, 0
        yield from send(held)

    sent = documents.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return sent.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, k, gram, n, share, left) for every order k: the discounted share of a gram in its context, and
    what that context leaves to the order below."""
    level, out = counts, None
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # in how many different ways the gram is preceded
            level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        rows = level.withColumn("context", F.shiftrightunsigned("gram", 16))
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = rows.groupBy("lang").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("discount"))
        total = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        shares = rows.join(total, ["lang", "context"]).join(discount, "lang")
        left = F.greatest(F.lit(1e-6), F.col("discount") * F.col("kinds") / F.col("total"))
        shares = shares.select("lang", F.lit(k).alias("k"), "gram", "n", ((F.col("n") - F.col("discount")) / F.col("total")).alias("share"), left.alias("left"))
        out = shares if out is None else out.unionByName(shares)
    return out


def _hashed(grams: np.ndarray, seed: U) -> np.ndarray:
    return mix(grams ^ seed)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], other)


@dataclass
class CharModel:
    """One language: for each order the sorted hashes of its grams with their shares, and of its
    contexts with what they leave to the order below."""

    shares: list[tuple[np.ndarray, np.ndarray]]
    left: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, k: np.ndarray, gram: np.ndarray, share: np.ndarray) -> CharModel:
        shares, left = [], []
        for order in range(1, ORDER + 1):
            g, s = gram[k == order], share[k == order]
            keys = _hashed(g, _SEEDS[order - 1])
            by = np.argsort(keys)
            shares.append((keys[by], s[by].astype(np.float32)))
            contexts, where = np.unique(g >> U(16), return_inverse=True)
            keys = _hashed(contexts, _SEEDS[ORDER + order - 1])
            by = np.argsort(keys)
            rest = np.maximum(1e-6, 1.0 - np.bincount(where, weights=s, minlength=len(contexts)))
            left.append((keys[by], rest[by].astype(np.float32)))
        return cls(shares, left)


def _levels(code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each order, from 1: hashes of the different grams and of their contexts, and for each the
    place of its ending in the order below."""
    kinds = [code]
    for k in range(ORDER - 1, 0, -1):
        kinds.append(np.unique(kinds[-1] & U((1 << 16 * k) - 1)))
    kinds.reverse()
    out = []
    for k, g in enumerate(kinds, 1):
        below = np.searchsorted(kinds[k - 2], g & U((1 << 16 * (k - 1)) - 1)) if k > 1 else None
        out.append((_hashed(g, _SEEDS[k - 1]), _hashed(g >> U(16), _SEEDS[ORDER + k - 1]), below))
    return out


def bits(model: CharModel, levels) -> np.ndarray:
    """Bits of each gram's last character after its context."""
    p = None
    for k, (own, context, below) in enumerate(levels):
        lower = np.full(len(own), UNIFORM) if p is None else p[below]
        p = _lookup(*model.shares[k], own, 0.0) + _lookup(*model.left[k], context, 1.0) * lower
    return -np.log2(p)


@dataclass
class Identifier:
    """Models by language, and the calibration of their predictions. A model of more than ENTRIES grams is the
    table `whole` of kneser_ney() instead, and is used by identify()."""

    languages: list[str]
    models: list[CharModel]
    slope: float = 1.0
    offset: float = 0.0
    least_score: float = 0.0
    limits: dict[int, float] = field(default_factory=dict)  # by binary logarithm of the number of characters
    whole: DataFrame | None = None

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and bits per character by text and language."""
        if self.whole is not None:
            raise ValueError("this model is a table: use identify()")
        parts, owner = pieces(texts)
        n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.models)))
        start = 0
        while start < len(parts):  # parts of about PIECE bytes together
            end, size = start + 1, len(parts[start])
            while end < len(parts) and size + len(parts[end]) <= PIECE:
                size += len(parts[end])
                end += 1
            code, sizes = grams(parts[start:end])
            np.add.at(n, owner[start:end], sizes)
            if len(code) and self.models:
                kinds = np.unique(code)
                where = np.searchsorted(kinds, code)
                levels = _levels(kinds)
                edges = np.concatenate(([0], np.cumsum(sizes)))
                for m, model in enumerate(self.models):
                    sums = np.concatenate(([0.0], np.cumsum(bits(model, levels)[where])))
                    np.add.at(total[:, m], owner[start:end], sums[edges[1:]] - sums[edges[:-1]])
            start = end
        return n, total / np.maximum(n, 1)[:, None]

    def predict(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """By text: n (characters), best (number of the language, or -1), entropy, evidence, score, rejected."""
        return self.judged(*self.entropies(texts))

    def judged(self, n: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
        """The same from characters and bits per character."""
        if not self.languages:
            none = np.zeros(len(n))
            return {"n": n, "best": np.full(len(n), -1), "entropy": none, "evidence": none, "score": none, "rejected": np.ones(len(n), bool)}
        h = np.round(h, 9)  # sums over a slice differ in their last digits with the slice
        best = np.where(n > 0, h.argmin(axis=1), -1)
        two = np.partition(h, 1, axis=1)[:, :2] if len(self.languages) > 1 else np.column_stack((h[:, 0], h[:, 0] + 16.0))
        evidence = np.log1p((two[:, 1] - two[:, 0]) * n)
        score = np.where(n > 0, 1 / (1 + np.exp(-(self.slope * evidence + self.offset))), 0.0)
        limit = np.array([self.limits.get(int(x), math.inf) for x in np.frexp(n)[1]])
        return {"n": n, "best": best, "entropy": two[:, 0], "evidence": evidence, "score": np.round(score, 6), "rejected": (n == 0) | (score < self.least_score) | (two[:, 0] > limit)}


def crc(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string"))


def _by_language(rows: DataFrame, key: str, value: str, languages: list[str]) -> DataFrame:
    """(key, and the value by language as an array with nulls), in the precision that a model in memory has."""
    cells = [F.max(F.when(F.col("lang") == x, F.col(value).cast("float").cast("double"))) for x in languages]
    return rows.groupBy(key).agg(F.array(*cells).alias(value))


def gram_bits(seen: DataFrame, shares: DataFrame, languages: list[str]) -> DataFrame:
    """(gram, bits by language as an array) for the different grams of seen (gram), from kneser_ney() in full."""
    kinds, out = {ORDER: seen.select("gram")}, None
    for k in range(ORDER - 1, 0, -1):
        kinds[k] = kinds[k + 1].select(F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")).distinct()
    for k in range(1, ORDER + 1):
        level = shares.where(F.col("k") == k).withColumn("context", F.shiftrightunsigned("gram", 16))
        rows = kinds[k].withColumn("context", F.shiftrightunsigned("gram", 16))
        rows = rows.join(_by_language(level, "gram", "share", languages), "gram", "left").join(_by_language(level, "context", "left", languages), "context", "left")
        if out is None:
            lower = [F.lit(UNIFORM)] * len(languages)
        else:
            below = out.select(F.col("gram").alias("ending"), F.col("p").alias("lower"))
            rows = rows.join(below, F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)) == F.col("ending"))
            lower = [F.get("lower", F.lit(i)) for i in range(len(languages))]
        p = [F.coalesce(F.get("share", F.lit(i)), F.lit(0.0)) + F.coalesce(F.get("left", F.lit(i)), F.lit(1.0)) * x for i, x in enumerate(lower)]
        out = rows.select("gram", F.array(*p).alias("p"))
    return out.select("gram", F.array(*[-F.log2(F.get("p", F.lit(i))) for i in range(len(languages))]).alias("bits"))


def whole_entropies(documents: DataFrame, model: Identifier, keep: str) -> DataFrame:
    """(keep, n, h) by row of documents (keep, text): characters, and bits per character by language as an
    array, from a model that is a table. The result is stored."""
    size = range(len(model.languages))
    band = F.floor(8 * F.log2("n"))  # at most 512 bands of frequency
    with scratch(documents.sparkSession):
        seen = written(gram_counts(documents.select(F.lit("").alias("lang"), "text")).select("gram", "n"), "seen")
        bits_of = written(gram_bits(seen, model.whole, model.languages), "bits")
        most, kept, least = ENTRIES // len(size), 0, None
        for r in seen.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
            kept += r["count"]
            if kept > most:
                break
            least = r["band"]
        often = seen.where(band >= least) if least is not None else seen.where("false")
        head = often.join(bits_of, "gram").select("gram", *[F.get("bits", F.lit(i)) for i in size]).toArrow()  # at most ENTRIES numbers
        grams_, *columns = (c.to_numpy() for c in head.columns)
        order = np.argsort(grams_)
        shared = documents.sparkSession.sparkContext.broadcast((grams_[order], np.array([c[order] for c in columns])))
        rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(keep).alias("keep"), "text")
        kind = dict(rows.dtypes)["keep"]

        def run(batches):
            known, values = shared.value
            for batch, texts in slices(batches, "text", PIECE):
                ids = batch.column(0).to_numpy()
                parts, owner = pieces(texts)
                n, total = np.zeros(len(texts), np.int64), np.zeros((len(values), len(texts)))
                start = 0
                while start < len(parts):  # parts of about PIECE bytes together
                    end, held = start + 1, len(parts[start])
                    while end < len(parts) and held + len(parts[end]) <= PIECE:
                        held += len(parts[end])
                        end += 1
                    code, sizes = grams(parts[start:end])
                    np.add.at(n, owner[start:end], sizes)
                    of, code = np.repeat(owner[start:end], sizes), code.view(np.int64)
                    at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
                    found = known[at] == code if len(known) else np.zeros(len(code), bool)
                    for m, v in enumerate(values):
                        if len(v):
                            total[m] += np.bincount(of[found], weights=v[at[found]], minlength=len(texts))
                    by = np.lexsort((code[~found], of[~found]))
                    of, code = of[~found][by], code[~found][by]
                    edge = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (code[1:] != code[:-1])))) if len(of) else np.zeros(0, np.int64)
                    times = np.diff(np.append(edge, len(of)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[of[edge]]), pa.nulls(len(edge), batch.schema.field(1).type), pa.array(code[edge]), pa.array(times.astype(np.int64)), pa.nulls(len(edge), pa.list_(pa.float64()))],
                        ["row", "keep", "gram", "n", "h"],
                    )
                    start = end
                sums = pa.array(total.T.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.nulls(len(n), pa.int64()), pa.array(n), sums], ["row", "keep", "gram", "n", "h"])

        parts = written(rows.mapInArrow(run, f"row bigint, keep {kind}, gram bigint, n bigint, h array<double>"), "parts")
        rest = parts.where("gram is not null").join(bits_of, "gram").groupBy("row").agg(*[F.sum(F.col("n") * F.get("bits", F.lit(i))).alias(f"r{i}") for i in size])
        h = [(F.get("h", F.lit(i)) + F.coalesce(f"r{i}", F.lit(0.0))) / F.greatest("n", F.lit(1)) for i in size]
        return outlives(parts.where("gram is null").join(rest, "row", "left").select(F.col("keep").alias(keep), "n", F.array(*h).alias("h")), "entropies")


def _predictions(documents: DataFrame, model: Identifier, keep: str, make, schema: str) -> DataFrame:
    """make(the column keep, predictions) of documents (keep, text), batch by batch, whichever way the model is held."""
    shared = documents.sparkSession.sparkContext.broadcast(replace(model, whole=None))

    def by_text(batches):
        for batch, texts in slices(batches, "text", PIECE):
            yield make(batch.column(0), shared.value.predict(texts))

    def by_sums(batches):
        for batch in batches:
            h = batch.column(2).flatten().to_numpy().reshape(len(batch), len(shared.value.languages))
            yield make(batch.column(0), shared.value.judged(batch.column(1).to_numpy(), h))

    documents = documents.select(keep, "text")
    return documents.mapInArrow(by_text, schema) if model.whole is None else whole_entropies(documents, model, keep).mapInArrow(by_sums, schema)


def fit(documents: DataFrame) -> Identifier:
    """The models and their calibration from documents (doc_id, text, lang), all of which are learned from."""
    spark = documents.sparkSession
    rows = documents.where("lang is not null and doc_id is not null and text is not null")
    aside = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(8)) == 0
    with scratch(spark):
        counts = written(gram_counts(rows.where(~aside)), "grams")
        shares = written(kneser_ney(counts), "shares")
        if shares.count() > ENTRIES:
            languages = sorted(r["lang"] for r in shares.select("lang").distinct().collect())
            return calibrated(Identifier(languages, [], whole=outlives(shares, "model")), rows.where(aside))
        entries = shares.select("lang", "k", "gram", "share").toArrow()  # at most ENTRIES rows
    lang = entries["lang"].combine_chunks().dictionary_encode() if len(entries) else None
    languages = sorted(lang.dictionary.to_pylist()) if lang is not None else []
    k, gram, share = (entries[c].to_numpy() for c in ("k", "gram", "share"))
    models = []
    for name in languages:
        own = lang.indices.to_numpy() == lang.dictionary.to_pylist().index(name)
        models.append(CharModel.of(k[own], gram[own].view(U), share[own]))
    found = Identifier(languages, models)
    return calibrated(found, rows.where(aside)) if models else found


def calibrated(model: Identifier, documents: DataFrame) -> Identifier:
    """The model with score and limits fitted on sums over all the given documents."""
    names = np.array(model.languages)

    def cell(lang, p):
        some = p["best"] >= 0
        right = names[p["best"][some]] == np.array(lang.to_pylist(), object)[some]
        at = np.minimum(p["evidence"][some] / WIDTH, CELLS - 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.frexp(p["n"][some])[1].astype(np.int32)), pa.array(right), pa.array(p["entropy"][some])], ["cell", "length", "right", "entropy"])

    cells = _predictions(documents, model, "lang", cell, "cell int, length int, right boolean, entropy double")
    h = F.when(F.col("right"), F.col("entropy"))
    sums = cells.groupBy("cell", "length").agg(F.count_if("right").alias("right"), F.count(F.lit(1)).alias("n"), F.sum(h).alias("h"), F.sum(h * h).alias("hh")).collect()  # at most 64 x 64 rows
    hit, n = np.zeros(CELLS), np.zeros(CELLS)
    by_length: dict[int, np.ndarray] = {}
    for r in sums:
        hit[r["cell"]] += r["right"]
        n[r["cell"]] += r["n"]
        by_length[r["length"]] = by_length.get(r["length"], np.zeros(3)) + [r["right"], r["h"] or 0.0, r["hh"] or 0.0]
    model.slope, model.offset = logistic((np.arange(CELLS) + 0.5) * WIDTH, hit, n)
    above, right = np.cumsum(n[::-1])[::-1], np.cumsum(hit[::-1])[::-1]
    good = np.flatnonzero((above > 0) & (right >= PRECISION * above))
    if len(good):
        model.least_score = float(1 / (1 + np.exp(-(model.slope * good[0] * WIDTH + model.offset))))
    for length, (m, s, ss) in by_length.items():
        if m >= 2:
            mean = s / m
            model.limits[length] = float(mean + DEVIATIONS * math.sqrt(max(0.0, ss / m - mean * mean)))
    return model


def logistic(x: np.ndarray, hit: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and offset of the logistic curve through the cells, with half a right and half
    a wrong case added at both ends so that it exists."""
    x, hit, n = np.concatenate((x, [x[0], x[-1]])), np.concatenate((hit, [0.5, 0.5])), np.concatenate((n, [1.0, 1.0]))
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(x * (hit - n * p)).sum(), (hit - n * p).sum()])
        m = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(m, g)
        step /= max(1.0, np.abs(step).max() / 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(a)), float(b)


def identify(documents: DataFrame, model: Identifier, reject: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, cross_entropy). With reject, rejected texts are `und`;
    otherwise only those without letters."""
    names = np.array([*model.languages, UNKNOWN])

    def named(doc_id, p):
        best = np.where(p["rejected"], -1, p["best"]) if reject else p["best"]
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array(names[best].tolist(), pa.string()), pa.array(p["score"]), pa.array(p["rejected"]), pa.array(np.round(p["entropy"], 6))],
            ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"],
        )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _predictions(rows, model, "doc_id", named, "doc_id bigint, lang_pred string, score double, rejected boolean, cross_entropy double")


def held_out() -> Column:
    return F.coalesce(crc() % 4 == 2, F.lit(False))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    with scratch(spark):
        model = fit(documents.where(~held_out()))
        found = identify(documents, model, reject=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
        return found if model.whole is None else outlives(found, "languages")
