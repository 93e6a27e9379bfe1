"""Periodic runs, ranked search and language identification against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelago.llm import op11_periodic_runs as op11
from pelago.llm import op12_ranked_search as op12
from pelago.llm import op13_language_id as op13
from pelago.llm.common import table

SPACED = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "a a a a a a"), (5, "a a a a a a"), (6, "a b a b a b a b a"), (7, " ".join(f"w{i % 977}" for i in range(20_000))),
    (8, "12 34 -- 56"), (9, "Größe 日本 😀\x0bx\x1cy y y y y y"), (None, "no id no id no id no id"), (10, "x" * 50_000), (11, "abc " * 7), (40, "ABC abc abc abc"), (60, "𝒳𝒴 letters beyond"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3, "text")
    return rows.withColumns({"lang": F.lit("en"), "runs": F.lit(1), "score": F.lit("mine"), "item": F.lit(0), "rank": F.lit(7), "term": F.lit("t")})


# ---- runs -----------------------------------------------------------------------------------------
def plain_runs(w):
    """(start, length, period) by definition: every maximal stretch of every period, smallest periods only."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and all(any(w[k] != w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.add((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(SPACED, text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.choice([0, 3, 6, 7, 12, 30, 80]))]
            if w and rng.random() < 0.6:
                a, p = rng.randrange(len(w)), rng.randint(1, 7)
                w = w[:a] + (w[a : a + p] * 60)[: rng.randint(1, 60)] + w[a:]
            docs.append(w)
        assert [[tuple(r) for r in x.tolist()] for x in op11.slice_runs(docs)] == [plain_runs(w) for w in docs]


def test_suffix_tree_extensions():
    rng = random.Random(6)
    for n, k in ((40, 1), (90, 2), (300, 3), (300, 40)):
        s = [1 + rng.randrange(k) for _ in range(n)] + [0]
        tree = op11.SuffixTree(s)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(500)]
        i, j = (np.array(x) for x in zip(*[(a, b) for a, b in pairs if a != b], strict=True))
        lce = [next(d for d in range(n + 1) if s[a + d : a + d + 1] != s[b + d : b + d + 1]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert tree.extension(i, j).tolist() == lce
        assert np.argsort(tree.rank).tolist() == sorted(range(n + 1), key=lambda a: s[a:])
        turned = np.array([0, *range(k, 0, -1)])
        assert np.argsort(tree.ranks(turned)).tolist() == sorted(range(n + 1), key=lambda a: [turned[x] for x in s[a:]])


def test_runs_query(spark, sf_dir, odd):
    found = op11.op11_periodic_runs(spark, sf_dir).collect()
    texts = dict(table(spark, sf_dir, "documents", "doc_id", "text").collect())
    assert {r[0] for r in found} == set(texts)
    short = [r for r in found if len((texts[r[0]] or "").split()) < 800]
    assert len(short) > 100 and any(r["n_runs"] for r in short)
    for r in short:
        assert tuple(r) == plain_row(r[0], texts[r[0]])
    rows = op11.periodic_runs(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r["n_words"] < 1000:
            w = next(re.findall(SPACED, t or "") for i, t in ODD if i == r["doc_id"])
            assert [tuple(x) for x in r["runs"]] == plain_runs(w)
    by_id = {r["doc_id"]: r for r in rows}
    assert [tuple(x) for x in by_id[7]["runs"]] == [(0, 20_000, 977)] and len(by_id[7]["collapsed"].split()) == 977
    assert by_id[5]["collapsed"] == "a" and by_id[1]["collapsed"] == "" and by_id[1]["n_words"] == 0
    assert op11.periodic_runs(odd.where("1 = 0")).count() == 0


# ---- search ---------------------------------------------------------------------------------------
def lowered(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    """Every score by the contract's formula, in Python's whole numbers."""
    bags = [(i, Counter(lowered(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = {}
    for item, text in items.items():
        scored = []
        for i, b, size in bags:
            m = 100 - 90 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(lowered(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out[item] = [(r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return {i: rows for i, rows in out.items() if rows}


def found_by_item(df):
    out = defaultdict(list)
    for r in df.orderBy("item_id", "rank").collect():
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return dict(out)


@pytest.mark.parametrize("rare, docs_in_block", [(64, 4096), (2, 7), (1, 50), (10**9, 3)])
def test_search_is_exact(spark, monkeypatch, rare, docs_in_block):
    """Few and many pair lists, one and many blocks; ties, repeated rows, terms of every document."""
    monkeypatch.setattr(op12, "RARE", rare)
    monkeypatch.setattr(op12, "BLOCK_DOCS", docs_in_block)
    rng = random.Random(rare + docs_in_block)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (1 + j) for j in range(60)], k=rng.randint(1, 40))) + " all") for i in range(150)]
    docs += [docs[3], docs[4], (None, docs[5][1]), (999, None), (998, "- ;")]
    items = {j: " ".join(rng.sample(words, rng.randint(1, 25))) for j in range(12)} | {20: "all ALL", 21: None, 22: "nowhere", 23: docs[9][1]}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for k in (1, 5, 400):
        assert found_by_item(op12.search(d, q, k)) == plain_search(docs, items, k)


def test_search_groups_and_odd_rows(spark, monkeypatch, odd):
    items = {1: "A letters", 2: "日本 größe abc", 3: "x y id", 4: ""}
    q = spark.createDataFrame(list(items.items()), "item_id int, text string").withColumn("score", F.lit(1))
    whole = found_by_item(op12.search(odd, q, 3))
    assert whole == plain_search(ODD, items, 3)
    monkeypatch.setattr(op12, "ITEMS", 2)
    assert found_by_item(op12.search(odd, q, 3)) == whole
    # rows that share an id are one item
    twice = spark.createDataFrame([(1, "A"), (1, "letters"), (2, "日本 größe abc"), (3, "x y"), (3, "id")], "item_id int, text string")
    assert found_by_item(op12.search(odd, twice, 3)) == whole
    assert op12.search(odd.where("1 = 0"), q, 3).count() == 0
    assert op12.search(odd, q.where("1 = 0"), 3).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_are_bounds(spark, sf_dir):
    """No document's score from a unit's terms is above the unit's bound, and pairs tighten some bounds."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    _, terms = next(op12._groups(items))
    vocabulary = {w: t for t, w in enumerate(sorted({w for words in terms for w in words}))}
    blocks = op12.index(docs, vocabulary).persist()
    df = {r[0]: r[1] for r in blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy("p.terms").agg(F.sum("p.sizes")).collect()}
    n, total = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).collect()[0]
    group = op12.Items([[vocabulary[w] for w in words] for words in terms], len(vocabulary), df, n)
    rows = op12.impacts(blocks.select("docs", "terms", "sizes", "places", "lengths", "counts"), group, n, total, 10).collect()
    tighter = 0
    for r in rows:
        row = {k: np.array(v) for k, v in r.asDict().items()}
        block = op12.Searcher({k: v.astype(np.int64) for k, v in row.items()}, group)
        for i in range(len(terms)):
            bound, _, _ = block.bounds(i)
            a, b, _ = group.units[i]
            for u in range(len(a)):
                score, most = np.zeros(len(row["docs"]), np.int64), 0
                for j in (a[u], b[u]):
                    if j < len(group.terms[i]):
                        span = block.post.span(group.terms[i][j])
                        score[row["places"][span]] += row["impacts"][span]
                        most += int(row["impacts"][span].max(initial=0))
                assert score.max(initial=0) <= bound[u] <= most
                tighter += bound[u] < most
    assert tighter
    blocks.unpersist()


# ---- languages ------------------------------------------------------------------------------------
def plain_model(texts):
    """Interpolated Kneser-Ney of order 4 over dictionaries: a function of context and character."""
    grams = Counter()
    for t in texts:
        s = "   " + re.sub(r"\s+", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in t)).lstrip() + " "
        s = s[:3] + s[3:].replace("  ", " ")
        grams.update(s[i - 3 : i + 1] for i in range(3, len(s)) if s[3:].strip())
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    p = {}
    for k, counts in levels.items():
        ones, twos = (sum(c == x for c in counts.values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total, kinds = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        p[k] = (counts, d, total, kinds)

    def prob(g):
        if not g:
            return 1 / 65536
        counts, d, total, kinds = p[len(g)]
        lower, h = prob(g[1:]), g[:-1]
        return lower if h not in total else max(counts[g] - d, 0) / total[h] + d * kinds[h] / total[h] * lower

    return prob


TRAIN = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), ("the dog and the hen", "en"), ("ein Haus, ein Baum!", "de"), ("123", "en"), ("it is a house", "en"), ("Öl über Äpfel", "de")] * 3)]


def test_models_are_kneser_ney(spark):
    shares = op13.kneser_ney(op13.gram_counts(spark.createDataFrame(TRAIN, "doc_id long, text string, lang string").repartition(3))).toPandas()
    for lang in ("en", "de"):
        own = shares[shares["lang"] == lang]
        model = op13.CharModel.of(own["k"].to_numpy(), own["gram"].to_numpy().view(np.uint64), own["share"].to_numpy())
        prob = plain_model([t for _, t, x in TRAIN if x == lang])
        for text in ("the house über", "xyz the Öl", "ein"):
            code, sizes = op13.grams([text.encode()])
            kinds = np.unique(code)
            got = op13.bits(model, op13._levels(kinds))[np.searchsorted(kinds, code)]
            s = "   " + text.lower() + " "
            want = [-math.log2(prob(s[i - 3 : i + 1])) for i in range(3, len(s))]
            assert sizes.tolist() == [len(want)] and np.allclose(got, want, rtol=1e-4)
        # one distribution for each context: all characters that the language has, and the rest by the uniform share
        known = sorted({chr(int(g)) for g in own["gram"][own["k"] == 1]})
        for h in ("the", "  d", "qqq"):
            assert sum(prob(h + c) for c in known) + (65536 - len(known)) * prob(h + "一") == pytest.approx(1)


def test_language_query(spark, sf_dir):
    rows = op13.op13_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents", "doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    out = [r for r in rows if r["held_out"] and r["lang"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len(out) > 20 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)


def test_language_odd_rows_and_rejection(spark, sf_dir, odd, monkeypatch):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = op13.fit(docs)
    got = op13.identify(odd, model, reject=False).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 8}
    # text that is like none of the languages is rejected, the languages' own texts are not
    noise = " ".join("".join(random.Random(i).choices("qxzjkvw", k=9)) for i in range(300))
    far = spark.createDataFrame([(1, noise), (2, None)], "doc_id long, text string")
    assert [r["lang_pred"] for r in op13.identify(far, model).orderBy("doc_id").collect()] == ["und", "und"]
    own = op13.identify(docs, model)
    assert own.where("rejected").count() <= 0.03 * own.count()
    # pieces: nearly the same bits, and the same language
    long = [" ".join([ODD[9][1], noise, "the and of with that"] * 20).encode(), "ä".encode() * 5000]
    n, h = model.entropies(long)
    monkeypatch.setattr(op13, "PIECE", 701)
    m, g = model.entropies(long)
    assert m.tolist() == pytest.approx(n.tolist(), rel=0.02) and np.allclose(h, g, rtol=0.02)
    # nothing to learn from
    for empty in (docs.where("1 = 0"), docs.withColumn("lang", F.lit(None).cast("string"))):
        none = op13.fit(empty)
        assert none.languages == [] and {r["lang_pred"] for r in op13.identify(odd, none, reject=False).collect()} == {"und"}
    assert op13.identify(odd.where("1 = 0"), model).count() == 0


def test_model_size_is_bounded(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    monkeypatch.setattr(op13, "ENTRIES", 3000)
    small = op13.fit(docs)
    assert sum(len(keys) for m in small.models for keys, _ in m.shares) <= 3000
    right = op13.identify(docs, small, reject=False).join(docs.select("doc_id", "lang"), "doc_id").where("lang = lang_pred").count()
    assert right >= 0.9 * docs.where("lang is not null").count()


def test_model_beyond_memory_gives_the_same(spark, sf_dir, odd, monkeypatch):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    texts = docs.unionByName(odd.select("doc_id", "text").withColumn("lang", F.lit(None).cast("string")))

    def found(model):
        rows = op13.identify(texts, model).collect()
        return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["cross_entropy"], r["score"], r["lang_pred"], r["rejected"]) for r in rows)

    model = op13.fit(docs)
    want, query = found(model), sorted(op13.op13_language_id(spark, sf_dir).collect())
    assert model.whole is None
    for entries, piece in ((3000, op13.PIECE), (3, 701)):  # some grams in the tasks, and none; whole texts, and pieces of them
        monkeypatch.setattr(op13, "PIECE", piece)
        if piece == 701:
            model = op13.fit(docs)
            want = found(model)
        monkeypatch.setattr(op13, "ENTRIES", entries)
        large = op13.fit(docs)
        assert large.whole is not None and large.languages == model.languages
        assert large.whole.count() == sum(len(keys) for m in model.models for keys, _ in m.shares)
        got = found(large)
        assert [(*r[:2], *r[4:]) for r in got] == [(*r[:2], *r[4:]) for r in want]
        assert np.allclose([r[2:4] for r in got], [r[2:4] for r in want], atol=1e-5)
        if piece != 701:
            rows = sorted(op13.op13_language_id(spark, sf_dir).collect())
            assert [r[:3] for r in rows] == [r[:3] for r in query] and np.allclose([(r["score"], r["cross_entropy"]) for r in rows], [(r["score"], r["cross_entropy"]) for r in query], atol=1e-5)
        monkeypatch.setattr(op13, "ENTRIES", 1 << 21)
