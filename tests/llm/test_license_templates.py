"""The token automata against regular expressions over words, and whole licence texts."""

import random
import re

import pytest

from pelago.llm import op10_license_scan as op10


def expression(template):
    """The template as a regular expression over words that each end with a space."""
    out = []
    for part in re.findall(r"<<[^<>]*>>|[^\s<>]+", template):
        if part == "<<optional>>":
            out.append("(?:")
        elif part == "<</optional>>":
            out.append(")?")
        elif part.startswith("<<any:"):
            out.append(r"(?:\S+ ){%s,%s}" % tuple(part[6:-2].split(":")))
        else:
            out.append(re.escape(part) + " ")
    return re.compile("".join(out))


def test_automata_equal_regular_expressions():
    rng = random.Random(10)

    def template(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.25 and depth:
                parts.append(f"<<optional>>{template(depth - 1)}<</optional>>")
            elif kind < 0.4:
                low = rng.randint(0, 2)
                parts.append(f"<<any:{low}:{low + rng.randint(0, 2)}>>")
            else:
                parts.append(rng.choice("abc"))
        return " ".join(parts)

    accepted = 0
    for _ in range(400):
        t = "a b " + template(2)
        automaton, pattern = op10.Automaton(t), expression(t)
        for _ in range(20):
            words = ["a", "b", *(rng.choice("abc") for _ in range(rng.randint(0, 8)))]
            want = bool(pattern.match("".join(w + " " for w in words)))
            assert automaton.run(words, 0)[0] == want, (t, words)
            accepted += want
    assert accepted > 500


def filled(template, keep):
    """A text of the template with or without its optional regions."""
    t = re.sub(r"<<any:(\d+):\d+>>", lambda m: " ".join(["Acme"] * max(1, int(m[1]))), template)
    inner = r"<<optional>>([^<]*)<</optional>>"
    while re.search(inner, t):
        t = re.sub(inner, r" \1 " if keep else " ", t)
    return " ".join(t.split())


@pytest.mark.parametrize("keep", [True, False])
def test_every_template_is_found_and_needs_its_last_word(spark, keep):
    rows, labels = [], list(op10.TEMPLATES)
    for i, label in enumerate(labels):
        text = filled(op10.TEMPLATES[label], keep)
        rows += [(2 * i, f"Header line.\n{text.upper()}!\nMore."), (2 * i + 1, text.rpartition(" ")[0])]
    out = {r.doc_id: r for r in op10.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(labels):
        assert label in out[2 * i].labels.split(",") and out[2 * i].score == 1.0, label
        if not op10.TEMPLATES[label].rstrip().endswith(">>"):
            assert label not in out[2 * i + 1].labels.split(","), label
    wrong = filled(op10.TEMPLATES["mit-license"], keep).replace("without restriction", "with restriction")
    r = op10.scan(spark.createDataFrame([(1, wrong)], "doc_id long, text string")).first()
    assert "mit-license" not in r.labels.split(",") and "mit-text" in r.labels.split(",")
