"""Near-dedup where doc_ids repeat, against a brute-force version that knows rows, not ids."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pelago.llm import op4_minhash as op4
from pelago.llm.common import join_hot, written
from tests.llm import brute


def classes_of(rows, k, percent):
    """For each row, the set of the rows that it is linked with, itself included."""
    sets = [brute.shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return [[j for j in range(len(rows)) if root(j) == root(i)] for i in range(len(rows))], sets


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    a, b = words(rng, 40), words(rng, 40)
    out = [(1, a), (5, a), (5, b), (7, [*a, "z"]), (8, [*b, "z"]), (9, a), (9, a), (9, b)]
    for _ in range(30):
        w = words(rng, 60)
        shared = rng.randrange(6)
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(60)] = "edit"
            out.append((100 + shared, v))
    return [(i, " ".join(w)) for i, w in out] + [(3, None), (3, ""), (None, "x y z"), (None, "x y z"), (4, "  ")]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_repeated_ids_lose_no_link_and_no_row(spark, rows, k, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text")
    groups, sets = classes_of(rows, k, percent)
    want = []
    for i, (doc, _) in enumerate(rows):
        least = doc if doc is None or not sets[i] else min(rows[j][0] for j in groups[i] if rows[j][0] is not None)
        want.append((str(doc), len(sets[i]), str(least), doc is None or doc == least))
    got = [(str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in op4.near_components(df, k, percent).collect()]
    assert sorted(got) == sorted(want)

    named = df.withColumns({"_drop": F.lit("a"), "kept": F.lit("b"), "_doc_id": F.lit(1), "_t1": F.lit(2), "_t1_kept": F.lit(3), "cls": F.lit(4)})
    out = op4.drop_near(named, k, percent)
    assert out.columns == named.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert all((r["_drop"], r["kept"], r["_doc_id"], r["_t1"], r["_t1_kept"], r["cls"]) == ("a", "b", 1, 2, 3, 4) for r in out.collect())
    seen = [sorted({i for i, x in enumerate(rows) if x == y}) for y in left]
    alone = [x for i, x in enumerate(rows) if x[0] is None or not sets[i]]
    assert sorted(map(str, (y for y in left if y in alone))) == sorted(map(str, alone))
    kept = [tuple(groups[s[0]]) for s, y in zip(seen, left, strict=True) if y not in alone]
    every = {tuple(g) for i, g in enumerate(groups) if rows[i] not in alone}
    assert sorted(kept) == sorted(every)
    for g, y in zip(kept, (y for y in left if y not in alone), strict=True):
        assert y[0] == min(rows[j][0] for j in g if rows[j][0] is not None)


def test_classes_that_share_a_doc_id_stay_apart(spark):
    rng = random.Random(1)
    a, b = " ".join(words(rng, 40)), " ".join(words(rng, 40))
    df = spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in op4.drop_near(df).collect()) == [(1, a), (5, b)]


def test_join_hot_equals_join(spark):
    many = written(spark.range(60_000).select((F.col("id") % 3000 * (F.col("id") % 2)).alias("k"), "id"), "many")
    one = written(many.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k % 5 < 3"), "one")
    want = many.join(one.drop("n"), "k")
    got = join_hot(many, one, ["k"], "n")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def collided(k):
    """Signatures whose sums are all zero, so that only the sizes tell sets apart."""
    run = SIGNATURES(k)

    def blind(batches):
        for b in run(batches):
            zero = pa.array([0] * len(b), pa.int64())
            yield pa.RecordBatch.from_arrays([zero if c in ("s1", "s2") else b.column(c) for c in b.schema.names], schema=b.schema)

    return blind


SIGNATURES = op4._signatures


def test_sums_that_collide_join_no_texts(spark, rows, monkeypatch):
    monkeypatch.setattr(op4, "_signatures", collided)
    cyclic = [(200 + n, " ".join("abcd"[i % 4] for i in range(n))) for n in (20, 21, 30)]  # one set, three sequences
    case = [*rows, *cyclic]
    groups, sets = classes_of(case, 3, 85)
    want = [(str(doc), len(s), str(doc if doc is None or not s else min(case[j][0] for j in g if case[j][0] is not None))) for (doc, _), g, s in zip(case, groups, sets, strict=True)]
    got = op4.near_components(spark.createDataFrame(case, "doc_id long, text string"), 3, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(want)
    assert {r.component_id for r in got if r.doc_id in (200 + 20, 200 + 21, 200 + 30)} == {220}


def test_blocks_bring_every_two_rows_of_a_list_together_once(spark, monkeypatch):
    monkeypatch.setattr(op4, "BLOCK", 7)
    rows = spark.range(60).select((F.col("id") % 50 < 45).cast("int").alias("shingle"), F.col("id").alias("cls"))
    rows = rows.join(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("g")), "shingle")
    dealt = op4.in_blocks(rows)
    one, other = dealt.withColumnsRenamed({"cls": "a", "block": "x"}), dealt.withColumnsRenamed({"cls": "b", "block": "y"})
    met = one.join(other, ["shingle", "lower", "upper"]).where("a < b and (lower = upper or x <> y)").select("a", "b")
    got = sorted(map(tuple, met.collect()))
    lists = {}
    for r in rows.collect():
        lists.setdefault(r.shingle, []).append(r.cls)
    assert got == sorted(p for m in lists.values() for p in itertools.combinations(sorted(m), 2))


def test_lists_of_one_hot_shingle_lose_no_link(spark, monkeypatch):
    """Sets that share their rarest shingles, in several components: the second filter in small blocks."""
    monkeypatch.setattr(op4, "BLOCK", 3)
    rng = random.Random(9)
    common, case = words(rng, 60), []
    for i in range(90):
        v = list(common)
        for _ in range(rng.randrange(1, 4)):
            v[rng.randrange(60)] = f"edit{rng.randrange(12)}"
        case.append((i, " ".join(v)))
    groups, _ = classes_of(case, 3, 85)
    got = {r.doc_id: r.component_id for r in op4.near_components(spark.createDataFrame(case, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: min(g) for i, g in enumerate(groups)}
