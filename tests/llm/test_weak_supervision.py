"""The weak supervision of op5: labelers, expectation-maximisation, and what the classifiers find."""

import math
import random
import re

import numpy as np
import pytest

from pelago.llm import op5_pii as op5
from pelago.llm.common import table


def plain_em(patterns, rounds):
    """The same estimates row by row, without arrays."""
    rows = [v for v, n in patterns for _ in range(n)]
    labelers = range(len(rows[0]))
    prior = 0.5
    p = {(j, k): list(t) for j in labelers for k, t in ((1, (0.15, 0.5, 0.35)), (0, (0.45, 0.1, 0.45)))}
    for _ in range(rounds):
        q = []
        for v in rows:
            yes, no = prior, 1 - prior
            for j in labelers:
                yes, no = yes * p[j, 1][v[j]], no * p[j, 0][v[j]]
            q.append(yes / (yes + no))
        prior = min(0.99, max(0.01, sum(q) / len(q)))
        for j in labelers:
            for k in (0, 1):
                w = [0.5] * 3
                for v, x in zip(rows, q, strict=True):
                    w[v[j]] += x if k else 1 - x
                p[j, k] = [x / sum(w) for x in w]
    return prior, p


def test_em_equals_a_plain_version_and_finds_reliabilities():
    patterns = [((1, 1, 1), 30), ((1, 2, 1), 12), ((0, 2, 0), 80), ((2, 0, 0), 25), ((1, 0, 0), 4)]
    prior, tables = op5.em(patterns)
    want, p = plain_em(patterns, op5.PRIOR_ROUNDS)
    assert math.isclose(prior, want, rel_tol=1e-6)
    for (j, k), t in p.items():
        assert np.allclose(tables[j, k], t, rtol=1e-6)

    rng = random.Random(5)  # three labelers of known reliability, a quarter of the rows positive
    counts = {}
    for _ in range(20_000):
        y = rng.random() < 0.25
        v = tuple(int(y) if rng.random() < good else int(not y) for good in (0.95, 0.85, 0.75))
        counts[v] = counts.get(v, 0) + 1
    prior, tables = op5.em(sorted(counts.items()))
    assert abs(prior - 0.25) < 0.03
    assert np.allclose([tables[j, 1, 1] for j in range(3)], (0.95, 0.85, 0.75), atol=0.04)
    assert op5.posterior((1, 1, 1), prior, tables) > 0.9 > 0.1 > op5.posterior((0, 0, 0), prior, tables)


def test_labelers_of_accounts():
    for text, want in [("IBAN: DE89370400440532013000", (1, 1, 1)), ("my ssn 078-05-1120 ok", (1, 1, 2)), ("passport no. X1234567", (1, 2, 1)), ("grew by 12345678 units", (2, 2, 2)), ("token = AB12345678cd", (2, 0, 1))]:
        (s, e), *_ = op5.candidates(text, op5.base_spans(text))
        assert op5.votes(text, s, e)[1] == want, text


def iban(rng, country="DE", n=18):
    """A bank number of a country with n characters after the check digits, all of them digits."""
    body = "".join(rng.choice("0123456789") for _ in range(n))
    code = "".join(str(int(c, 36)) for c in country)
    return f"{country}{98 - int(body + code + '00') % 97:02d}{body}"


def printed(number, by=" "):
    return by.join(number[i : i + 4] for i in range(0, len(number), 4))


def test_bank_numbers_in_groups_are_candidates():
    texts = {
        "IBAN: [DE89 3704 0044 0532 0130 00] bitte": 1,
        "to [GB82 WEST 1234 5698 7654 32], or [AT61 1904 3002 3457 3201] PLUS MORE": 2,
        "[AT61 1904 3002 3457 3201] [AT61 1904 3002 3457 3201] x": 2,
        "iban=[DE89 3704 0044 0532 0130 00]": 1,
        "[DE89-3704-0044-0532-0130-00]": 1,
        "see AB12 CD34 or DE89 3704 0044x": 0,
        "XDE89 3704 0044 0532 0130 00": 0,
    }
    for marked, n in texts.items():
        text, want = "", []
        for part in re.split(r"(\[[^]]*\])", marked):
            if part.startswith("["):
                want.append((len(text), len(text) + len(part) - 2))
            text += part.strip("[]")
        assert len(want) == n
        found = op5.candidates(text, op5.base_spans(text))
        assert found == want, marked
        for s, e in found:
            assert op5.votes(text, s, e)[1][:2] == (1, 1), marked
    text = "a card 4111 1111 1111 1111 and +49 30 1234 5678, DE89 3704 0044 0532 0130 00 " * 3
    free = op5.candidates(text, op5.base_spans(text))
    base = op5.base_spans(text)
    assert len(base) == 6 and len(free) == 3
    assert all(e <= other or end <= s for s, e in free for _, other, end in base)


@pytest.mark.parametrize("text", ["token = 'abc12345678'", "x12345678"])
def test_few_distinct_candidates(spark, text):
    docs = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    assert op5.find_spans(docs, op5.fit(docs)).count() == 20


def test_accounts_and_secrets_are_told_apart(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        body = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(body + "131400") % 97
        rows.append((3 * i, f"please use IBAN: DE{check:02d}{body} for it"))
        rows.append((3 * i + 1, f"the token = {rng.getrandbits(160):040x} is old"))
        rows.append((3 * i + 2, f"about {rng.randrange(10**7, 10**8)} of the room-{i:06d} were there"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in op5.find_spans(docs, op5.fit(docs)).collect()}
    kinds = [[re.sub(":.*", "", x) for x in out[i].split(",") if x] for i in range(900)]
    assert sum(k == ["account"] for k in kinds[0::3]) >= 295
    assert sum(k == ["secret"] for k in kinds[1::3]) >= 295
    assert sum(k == [] for k in kinds[2::3]) >= 295


def test_precision_and_recall_over_several_forms(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    spread = lambda n: some(n - 4) + rng.choice("abc") + rng.choice("XYZ") + some(2, "0123456789")
    forms = {
        "grouped iban": lambda: ("account", "Please pay to IBAN ", printed(iban(rng)), " by Friday."),
        "grouped, named": lambda: ("account", "our iban: ", printed(iban(rng, "ES", 20)), ", thanks"),
        "plain iban": lambda: ("account", "konto ", iban(rng, "AT", 16), " ist neu"),
        "dashed iban": lambda: ("account", "IBAN: ", printed(iban(rng, "CH", 17), "-"), "."),
        "ssn": lambda: ("account", "the ssn ", f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", " was given"),
        "assigned": lambda: ("secret", "password=", spread(28), " # old"),
        "quoted": lambda: ("secret", 'api_key: "', spread(32), '" here'),
        "prefixed": lambda: ("secret", "we saw ", "ghp_" + spread(36), " in a log"),
        "hex": lambda: ("secret", "secret = ", f"{rng.getrandbits(160):040x}", " again"),
    }
    plain = [
        lambda: f"about {rng.randrange(10**7, 10**8)} of the room-{rng.randrange(10**6):06d} were there",
        lambda: f"In {rng.randrange(1900, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)} the chapter-{rng.randrange(10, 99)} was read",
        lambda: f"model AB{rng.randrange(10, 99)} with the part {rng.randrange(1000, 9999)} and version-{rng.randrange(10)}-{rng.randrange(10)}",
    ]
    rows, want, form_of = [], {}, {}
    for i in range(1800):
        if i % 2:
            rows.append((i, plain[i // 2 % len(plain)]()))
            continue
        name = list(forms)[i // 2 % len(forms)]
        kind, before, value, after = forms[name]()
        while op5.base_spans(before + value + after):  # digits that pass as a card by chance
            kind, before, value, after = forms[name]()
        rows.append((i, before + value + after))
        want[i], form_of[i] = f"{kind}:{len(before)}:{len(before) + len(value)}", name
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in op5.find_spans(docs, op5.fit(docs)).collect()}
    hits = {f: [out[i] == w for i, w in want.items() if form_of[i] == f] for f in forms}
    shares = {f: sum(h) / len(h) for f, h in hits.items()}
    assert min(shares.values()) >= 0.9 and sum(map(sum, hits.values())) >= 0.97 * len(want), shares
    false = [t for i, t in rows if i % 2 and out[i]]
    assert len(false) <= 0.02 * len(rows), false[:5]


def test_precision_and_recall_of_secrets(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r.spans for r in op5.find_spans(docs, op5.fit(docs)).collect()}
    want = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    got = {(i, int(s), int(e)) for i, x in out.items() for k, s, e in (y.split(":") for y in x.split(",") if y) if k in op5.LEARNED}
    assert len(want) > 10
    assert len(got & want) >= 0.99 * len(want) and len(got & want) >= 0.95 * len(got)
