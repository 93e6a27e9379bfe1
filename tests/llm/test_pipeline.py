import re

from pyspark.sql import functions as F

import corpus_pipeline
from pelago.llm import op1_quality_rules as op1
from tests.llm import brute

SECRET = re.compile(r'token = "([0-9a-f]{40})"')


def redacted(text):
    spans = brute.personal(text) + [("secret", m.start(1), m.end(1)) for m in SECRET.finditer(text)]
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], [*brute.ORDER, "secret"].index(x[0]))):
        if e > at:
            out += [text[at : max(s, at)], f"[{kind.upper()}]"] if s >= at else []
            at = e
    return "".join((*out, text[at:]))


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, {}
    verdicts = {r.doc_id: r.kept for r in op1.op1_quality_rules(spark, sf_dir).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = texts or {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(texts)
        if name == "quality rules":
            assert texts == {i: t for i, t in before.items() if verdicts[i]}
        elif name == "exact dedup":
            assert texts == {i: t for i, t in before.items() if i == max(j for j, u in before.items() if u == t)}
        elif name == "MinHash near-dedup":
            root = brute.components(before, 5, 80)
            assert texts == {i: t for i, t in before.items() if root[i] == i}
        else:
            assert texts == {i: redacted(t) for i, t in before.items()}
    assert not any(brute.personal(t) for t in texts.values())
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == texts.keys()


def test_run_gives_pieces(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_odd_documents_pass_through(spark, sf_dir):
    long = " ".join(f"word{i % 37} of{i % 11} text{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, "short"), (None, long), (4, "a b " * 30), (4, "a b " * 30), (5, long), (5, long), (6, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "_kept": F.lit("mine"), "_row": F.lit(1), "_t1": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[1:]:
        before = docs.count()
        docs = stage(spark, docs, sf_dir)
        if name == "exact dedup":
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(2, ""), (3, "short"), (4, "a b " * 30), (5, long), (6, long + " end")]
        elif name != "packing":
            assert 0 < docs.count() <= before
    assert {r.doc_id for r in docs.collect()} >= {3, 4, 5}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
