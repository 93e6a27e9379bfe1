import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pelago.llm import op1_quality_rules as op1
from pelago.llm import op2_sentencepiece as op2
from pelago.llm import op3_html as op3
from pelago.llm import op4_minhash as op4
from pelago.llm import op5_pii as op5
from pelago.llm import op6_packing as op6
from pelago.llm import op7_exact_dedup as op7
from pelago.llm import op8_quality_classifier as op8
from pelago.llm import op9_line_dedup as op9
from pelago.llm import op10_license_scan as op10
from pelago.llm.common import table
from pelago.llm.textvec import Texts
from tests.llm import brute

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "two words"), (6, "two words"), (7, LONG), (8, LONG), (9, "a\n\nb  c\n"), (10, "Größe 日本 😀\x0bx\x1cy"),
    (11, "mail a.b@c-d.example.org, 10.0.0.1 4111 1111 1111 1111 +1 (415) 555-0100. All rights reserved."), (11, "mail a.b@c-d.example.org, 10.0.0.1 4111 1111 1111 1111 +1 (415) 555-0100. All rights reserved."),
    (None, "no id"), (12, "<p>&amp;</p>"), (13, "x" * 50_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3, "text")
    return rows.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "kept": F.lit("mine"), "rep": F.lit(1), "n": F.lit(2), "text_sha256x": F.lit(3)})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels", "doc_id", "quality")


ALL = {
    "op1": lambda d: op1.scored(d, None), "op2": op2.encode, "op4": lambda d: op4.near_components(d, 3, 85), "op4_drop": op4.drop_near, "op5": lambda d: op5.find_spans(d, op5.fit(d)),
    "op5_redact": op5.redact, "op6": op6.pack, "op7": op7.mark_duplicates, "op7_drop": op7.drop_duplicates, "op8": lambda d: op8.scored(d, None), "op9": op9.drop_repeated_lines, "op10": op10.scan,
}


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_and_empty_tables(odd, name):
    out = ALL[name](odd)
    n = out.count()
    if name in ("op1", "op2", "op4", "op5", "op5_redact", "op7", "op8", "op9", "op10"):
        assert n == len(ODD)
    elif name == "op6":
        assert {r["doc_id"] for r in out.collect()} == {i for i, _ in ODD}
    else:
        assert 0 < n < len(ODD)
    assert ALL[name](odd.where("doc_id = -1")).count() == 0


def test_training_on_odd_tables(spark, odd):
    some = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    for d, l in ((odd, some), (odd, some.where("false")), (odd.where("false"), some)):
        assert op1.scored(d, op1.fit(d, l)).count() == d.count()
        assert op8.scored(d, op8.fit(d, l)).count() == d.count()


def test_op1_base_counts_and_separation(spark, sf_dir, docs, texts):
    sample = [t for _, t in ODD] + list(texts.values())[:80]
    got = op1.base_counts(Texts([(t or "").encode() for t in sample]))
    assert [tuple(int(v[i]) for v in got.values()) for i in range(len(sample))] == [brute.base_counts(t) for t in sample]
    out = {r["doc_id"]: r for r in op1.op1_quality_rules(spark, sf_dir).collect()}
    for i, t in texts.items():
        n, _, _, _, repeat = brute.base_counts(t)
        assert out[i]["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (out[i]["base_failed"] and out[i]["kept"])


def test_op2_equals_the_library_and_round_trips(spark, odd, texts):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sample = [*texts.values(), *(t or "" for _, t in ODD), " a", "a ", "a   b", "\t\n", "<0x0A> <s>", "zz😀 𝒳"]
    m = op2.model(None)
    assert [x.tolist() for x in m.encode(sample)] == sp.encode(sample)
    assert all(m.decode(x) == t for x, t in zip(m.encode(sample), sample, strict=True))
    rng = random.Random(2)
    long = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "etaoinshrdlu", "xé日0123456789", "a") for n in (63, 64, 65, 200, 3000)]
    assert [x.tolist() for x in m.encode(long)] == sp.encode(long)
    began = time.perf_counter()
    word = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(200_000))
    assert m.encode([word])[0].tolist() == sp.encode(word) and time.perf_counter() - began < 20
    pieces = op2.encode(odd)
    back = {r["doc_id"]: r["text"] for r in op2.decode(pieces).collect()}
    assert all(back[i] == (t or "") for i, t in ODD)


PAGE = """<html><head><title>T</title></head><body><nav class=menu><ul><li><a href=/>Home</a><li><a href=/x>About</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><div id="content"><h1>Big &amp; small</h1><p>First&nbsp;paragraph of   the story, with
<b>bold text and a <a href=x>link</a> in it.<p>Second one. It has &lt;tags&gt; &#233; and more words than the first.<script>var x = "<p>no</p>";</script></p>
<!-- <p>hidden</p> --><p>Third paragraph of the story, which goes on for a while and then ends.</p></div>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this one a lot, thanks for writing it.</p></div></section>
<form><p>Search this site</p><input name=q></form><footer>&copy; 2024 Someone</footer></body></html>"""


def test_op3_articles_and_an_unseen_layout(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    trees = op3.fit(pages)
    import html as entities

    got = {r["page_id"]: r for r in op3.extract(pages, trees).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>plain"), (5, "u", "a < b"), (6, "u", "<div>" * 3000 + "x")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("other"))
    out = {r["page_id"]: r["text"] for r in op3.extract(odd, trees).collect()}
    assert out[1].startswith("Big & small\n\nFirst paragraph of the story, with bold text and a link in it.\n\nSecond one. It has <tags> é and")
    assert "cookies" not in out[1] and "liked" not in out[1] and "Someone" not in out[1] and "Search" not in out[1]
    assert out[2] == out[3] == ""
    assert op3.extract(odd.where("false"), trees).count() == 0
    assert op3.fit(odd.where("page_id > 1")) is None
    assert op3.extract(odd, None).count() == len(rows)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>x</title><body><article><p>One <b>two</b></p></article>", ["One two"]),
        ("<head><title>x<p>One", ["One"]),
        ("<header><button>Menu</header><article><p>One</p></article><button>OK</button>", ["One"]),
        ("<div><button>Menu<article><p>One</p></article><p>Two</div>", ["One", "Two"]),
        ("<select><option>1<option>2</select><p>One<iframe src=x></p><p>Two<p>Three", ["One", "Two", "Three"]),
        ("<p>One<svg><g><title>t</title></g></svg> two <object><div><p>no</p></div></object>three</p>", ["One two three"]),
        ("<template><p>no</p></template><p>One<script>'<p>no</p>'</script> two", ["One two"]),
    ],
)
def test_op3_open_silent_elements_cut_nothing_off(page, want):
    assert [x.text for x in op3.parse(page)[1]] == want


@pytest.mark.parametrize("piece", ["<a ", "<a \"<b '", "</script ", "<!x ", "<blockquote>", "<a \"x\" ", "<a b='", "<a =\"<b ='", "<!--!", "<![CDATA[", "<a b=\">\" c='", "<svg ", "<object>", "<p><table>", "</section>", "<title>", "<li>"])
def test_op3_reads_hostile_pages_in_linear_time(piece):
    began = time.perf_counter()
    nodes, _ = op3.parse("<script>x</script>" + piece * (1_000_000 // len(piece)) + "\">'>")
    assert nodes and time.perf_counter() - began < 10


def test_op3_tags_that_never_end_are_text():
    assert [x.text for x in op3.parse("<p>One < two <b")[1]] == ["One < two <b"]
    assert [x.text for x in op3.parse("<p title='a>b' id=\"x>\">One</p><a \"<p>Two</p>")[1]] == ["One", "Two"]  # the quote belongs to a name


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p data-x=it's>First para.</p><p>Second don't drop.</p><p>Third.</p>", ["First para.", "Second don't drop.", "Third."]),
        ("<p class=a'b>One</p><p>Two don't</p>", ["One", "Two don't"]),
        ('<p title=5">First</p><p>Second "x"</p>', ["First", 'Second "x"']),
        ("<p>a</p><!--><p>b</p><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><!---><p>b</p>", ["a", "b"]),
        ("<p>a</p><!-- x --!><p>b</p><!-- y > z --><p>c</p>", ["a", "b", "c"]),
        ("<p>One <![CDATA[ a > b ]]>two</p>", ["One two"]),
        ("<p>One <![CDATA[ a > two</p>", ["One two"]),
        ("<p>Energy <math><mi>E</mi> <mo>=</mo> <mi>mc</mi></math> is.</p>", ["Energy E = mc is."]),
        ("<p a = 'x>y' b=\"1\"c='>'>One</p>", ["One"]),
        ("<p =\"x>y\">One</p>", ['y">One']),
        ("<p a=b='c>One</p><p d='e>f'>Two</p>", ["One", "Two"]),
        ("<a href=x?y=\"1\">One</a><p/a=\">\">Two", ["One", "Two"]),
        ("<p a=>One</p><p a= \">\" b>Two", ["One", "Two"]),
        ("<p>One</p><p title='>Two</p><p>Three", ["One", "Two", "Three"]),
    ],
)
def test_op3_tokenizes_tags_by_the_rules(page, want):
    assert [x.text for x in op3.parse(page)[1]] == want


def test_op3_attributes_as_a_state_machine_has_them():
    """The tag's end against the attribute states of the HTML standard, one character at a time."""

    def plain(html, at):
        state, quote = "before name", ""
        for i in range(at, len(html)):
            c = html[i]
            if state == "quoted":
                if c == quote:
                    state = "before name"
            elif c == ">":
                return i + 1
            elif state == "before name":
                state = state if c in " /" else "name"
            elif state == "name":
                state = "after name" if c == " " else "before name" if c == "/" else "before value" if c == "=" else state
            elif state == "after name":
                state = state if c == " " else "before name" if c == "/" else "before value" if c == "=" else "name"
            elif state == "before value":
                if c in "\"'":
                    state, quote = "quoted", c
                elif c != " ":
                    state = "unquoted"
            elif c == " ":
                state = "before name"
        return html.find(">", at) + 1 or -1

    rng = random.Random(11)
    for _ in range(20_000):
        html = "".join(rng.choice("a=\"'> /") for _ in range(rng.randint(0, 14)))
        assert op3.Reader(html).end(0) == plain(html, 0), html


def test_op3_siblings_of_long_lists():
    nodes, _ = op3.parse("<ul>" + "<li>a</li>" * 300 + "</ul>")
    x = op3.features(nodes)[[n.tag == "li" for n in nodes]]
    assert (x[:, 21] == 300).all() and np.allclose(x[:, 9], np.arange(300) / 300)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_op4_equals_brute_force(spark, texts, k, percent):
    rng = random.Random(k)
    words = [f"v{i}" for i in range(400)]
    rows = {i: t for i, t in list(texts.items())[:120]}
    base = [rng.choice(words) for _ in range(120)]
    for i in range(150):  # one large group of near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows[100_000 + i] = " ".join(w)
    for i in range(40):
        rows[200_000 + i] = " ".join(base[: rng.randint(1, 12)])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in op4.near_components(df, k, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == brute.components(rows, k, percent)
    assert all(r["n_shingles"] == len(brute.shingles(rows[i], k)) and r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_op5_base_spans_and_votes(texts):
    rng = random.Random(5)
    fuzz = ["".join(rng.choice("12.@a-+ %(4b9") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    for t in [*fuzz, *texts.values(), *(t or "" for _, t in ODD)]:
        assert op5.base_spans(t) == brute.personal(t)
    for t in ("1" * 100_000, "a." * 50_000, "a-" * 50_000 + "@", "+1" * 30_000, "1." * 50_000):
        op5.candidates(t, op5.base_spans(t))
    secret = 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"'
    assert op5.votes(secret, 9, 49)[0] == (1, 1, 1)


def test_op5_adds_secrets_and_keeps_base(spark, docs, texts):
    sf = "/root/testdata/sf0.01"
    out = op5.op5_pii(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents", "doc_id", "text").collect()}
    assert any("secret" in r["spans"] for r in out)
    for r in out:
        base = {f"{k}:{s}:{e}" for k, s, e in brute.personal(texts[r["doc_id"]])}
        assert base <= set(r["spans"].split(",")) | {""}
    assert not any(brute.personal(r["text"]) for r in op5.redact(docs).collect())


def test_op5_copies_do_not_thin_the_sample(spark):
    once = spark.createDataFrame([(i, f"token = {i * 7919:08x}beb58b8af6") for i in range(8)], "doc_id long, text string")
    rare = op5.fit(once)
    assert rare.keys() == {"secret"}
    rare = rare["secret"]
    assert np.abs(rare).sum() > 0
    many = op5.fit(once.join(spark.range(25_000).select(F.col("id").alias("copy"))).repartition(8, "copy"))["secret"]
    assert ((many != 0) == (rare != 0)).all()  # the bins of all eight


def test_op6_pieces_are_whole_and_little_is_padded(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = op6.op6_packing(spark, sf_dir).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert docs.keys() == texts.keys()
    for i, pieces in docs.items():
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = tokens = 0
    for pieces in sequences.values():
        n = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == n and r["length"] > 0
            n += r["length"]
        assert n <= 1024
        tokens += n
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding < 0.02 * tokens


def test_op6_word_cache_only_for_single_spaces():
    import public_tokenizers

    e = op6.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a\n\n\nb\tc\td", "a  b\tc", "a\n\nb\u3000c", "a b\nc", "", "\n", "x <|endoftext|> y", "x<|endoftext|>y z", "it's a 'quote' 3rd", "\u00e9t\u00e9 \u65e5\u672c 'll"]
    end = np.array([op6.END_ID], "<u4").tobytes()
    assert e.encode([t.encode() for t in odd]) == [e.whole(t) + end for t in odd]
    assert np.frombuffer(e.encode([b"x <|endoftext|> y"])[0], "<u4").tolist() == [87, 220, 50256, 331, op6.END_ID]


def test_op6_ids_over_all_white_space():
    """Random texts over every kind of space, long words and added tokens against the named tokenizer."""
    import public_tokenizers

    e = op6.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u200b", "\u2060", "\ufeff"]
    rng = random.Random(2)
    texts = ["a\n\u00a0\u00a0b", "a \u00a0b", "\u2003a b\u2003"]
    for _ in range(20_000):
        kinds = [" ", "\n", *rng.sample(spaces, 2)]
        texts.append("".join(rng.choice(["a", "it's", "Größe", "12", ".", "日本", " ", " ", "\n", rng.choice(kinds)]) for _ in range(rng.randint(1, 12))))
    end = np.array([op6.END_ID], "<u4").tobytes()
    assert e.encode([t.encode() for t in texts]) == [i.tobytes() + end for i in e.batch(texts)]


def test_word_caches_are_bounded_by_bytes(monkeypatch):
    """Paragraphs without spaces are not kept, and a full cache is given up; ids stay the library's."""
    import public_tokenizers

    rng = random.Random(3)
    long = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)) for _ in range(60)]
    short = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(30)]
    e, m = op6.encoder(public_tokenizers.path("byte_bpe_50k.json")), op2.model(None)
    end = np.array([op6.END_ID], "<u4").tobytes()
    monkeypatch.setattr(op6, "CACHE", 50_000)
    monkeypatch.setattr(op2, "CACHE", 50_000)
    for _ in range(2):
        for part in (long, short[:15], short[15:]):
            assert e.encode([t.encode() for t in part]) == [i.tobytes() + end for i in e.batch(part)]
            first = [i.tolist() for i in m.encode(part)]
            assert first == [i.tolist() for t in part for i in m.encode([t])]
            assert all(len(w) <= op6.LONG for w in [*e.inner, *e.first]) and all(len(w) <= op2.LONG for w in m.cache)
    assert e.held[0] < 50_000 + 260 * 3000 and sum(map(len, e.inner)) <= e.held[0]
    assert m.held < 50_000 + 260 * 3000 and sum(map(len, m.cache)) <= m.held


def test_op6_cuts_elsewhere_only_where_no_boundary_is_near():
    ids = np.zeros(5000, np.int64)
    sentence = np.zeros(2, bool)
    sentence[1] = True
    ids[[99, 899, 4399]] = 1
    places, cost = op6.cut_places(ids, np.array([2000]), sentence)
    natural = {0: 0, 100: op6.SENTENCE_CUT, 900: op6.SENTENCE_CUT, 2000: 0, 4400: op6.SENTENCE_CUT, 5000: 0}
    grid = {*range(900 + op6.GRID, 2000, op6.GRID), *range(2000 + op6.GRID, 4400, op6.GRID)}
    assert dict(zip(places.tolist(), cost.tolist(), strict=True)) == natural | dict.fromkeys(grid, op6.INNER_CUT)
    assert np.diff(places).max() <= op6.SEQUENCE


def test_op7_equals_sql(spark, sf_dir):
    got = op7.op7_exact_dedup(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = db.sql(op7.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert (got == want[got.columns]).all().all()


def test_op7_one_row_of_each_group_stays(odd):
    out = op7.drop_duplicates(odd)
    assert out.columns == odd.columns
    assert out.groupBy(F.coalesce("text", F.lit(""))).count().where("count > 1").count() == 0
    assert out.count() == len({t or "" for _, t in ODD})


def test_op8_held_out_accuracy(spark, docs):
    sf = "/root/testdata/sf0.01"
    out = op8.op8_quality_classifier(spark, sf).join(labels(spark, sf), "doc_id").where("held_out").toPandas()
    good, bad = out.score[out.quality == 1].to_numpy(), out.score[out.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert ((out.score >= 0) & (out.score <= 1)).all() and (out.predicted == (out.score >= 0.3)).all()


def test_op9_equals_brute_force(spark, texts):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 30)))
    pool = [line() for _ in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else line() for _ in range(rng.randint(1, 15)))) for i in range(60)]
    rows += [(1000 + i, t) for i, t in list(texts.items())[:60]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.line_dedup(rows, op9.MIN_WORDS)
    got = {r["doc_id"]: r for r in op9.drop_repeated_lines(df).collect()}
    assert any(want.values())
    for i, t in rows:
        lines = t.split("\n")
        assert got[i]["n_lines"] == len(lines) and got[i]["n_removed"] == len(want[i])
        assert got[i]["text"] == "\n".join(x for p, x in enumerate(lines) if p not in want[i])


def test_op10_places_and_templates(spark, odd, texts):
    extra = ["CC-BY, cc by; General Public\nLicense", "Licensed under the Apache License, Version 2.0.", "licensed under apache license 2.0", "licensed under the apache licence version 2.0",
             "Copyright (c) 2020 Some One. All rights reserved", "copyright c all rights reserved", "cc", "all rights"]
    rows = [(i, t) for i, t in enumerate([*texts.values(), *extra])]
    out = {r["doc_id"]: r for r in op10.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.phrases(t)
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    got = [out[len(texts) + i]["labels"] for i in range(len(extra))]
    assert got == ["cc-by,gpl", "apache-2.0", "apache-2.0", "", "copyright-notice,reserved", "reserved", "", ""]
