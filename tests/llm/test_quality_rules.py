"""Every quality rule on both sides of its threshold, and documents that it must not take."""

import random

import pytest

from tests.conftest import SF
from tests.llm.test_operators import frame
from tools.check import connect
from vigilgrid.llm import quality

RNG = random.Random(6)


def prose(n, stops=20):
    """n distinct-looking words, a share of them stop words."""
    return [RNG.choice(["the", "of", "and"]) if i % (100 // stops) == 0 else f"word{RNG.randint(0, 10**6)}" for i in range(n)]


def lines(n, repeated):
    """n words of text, of which ``repeated`` are copies of a line of one word, between lines of prose."""
    body = prose(n - repeated - 1)
    cuts = [body[k * len(body) // repeated:(k + 1) * len(body) // repeated] for k in range(repeated)]
    return "menu\n" + "\nmenu\n".join(" ".join(c) for c in cuts) + "\nmenu"


CASES = [  # rule, text that passes, text that fails
    ("word length", " ".join(prose(100)), " ".join(["a"] + [f"{c}" for c in "the of"] + [random.Random(i).choice("abcdefgh") for i in range(97)])),
    ("symbols by word", " ".join(prose(100)) + " " + "#" * 20, " ".join(prose(100)) + " " + "#" * 22),
    ("exclamations by word", " ".join(prose(99)) + " " + "!" * 30, " ".join(prose(99)) + " " + "!" * 31),
    ("capitals by letter", " ".join(prose(60)) + " " + "X" * 200, " ".join(prose(60)) + " " + "X" * 900),
    ("stop words by word", " ".join(["the", "of"] + [f"only{i}" for i in range(98)]), " ".join(["the"] + [f"only{i}" for i in range(99)])),
    ("repeated lines by word", lines(100, 30), lines(100, 31))]


def verdicts(spark, texts):
    rows = quality.judged(frame(spark, list(enumerate(texts)))).collect()
    return {r.row.doc_id: (r.base_failed, r.kept) for r in rows}


def test_every_rule_on_both_sides(spark):
    got = verdicts(spark, [t for _, *pair in CASES for t in pair])
    assert {name for name, *_ in CASES} == {r.name for r in quality.RULES}
    for k, (name, *_) in enumerate(CASES):
        assert got[2 * k] == (False, True), name
        assert name == "word length" or got[2 * k + 1] == (False, False), name
    assert not got[1][1]


@pytest.mark.parametrize("body", [60, 200, 900])
def test_a_line_at_both_ends_is_no_fault(spark, body):
    text = "Company newsletter of the week\n" + " ".join(prose(body)) + "\nCompany newsletter of the week"
    assert verdicts(spark, [text])[0] == (False, True)


def test_no_labelled_good_document_falls_to_repeated_lines(spark):
    con = connect(SF.replace("0.001", "0.01"))
    others = tuple(r for r in quality.RULES if r.name != "repeated lines by word")
    found = con.execute(f"SELECT count(*) FROM ({quality.sql('documents')}) a JOIN ({quality.sql('documents', rules=others)}) b USING (doc_id) "
                        "JOIN labels USING (doc_id) WHERE b.kept AND NOT a.kept AND quality = 1").fetchone()[0]
    assert found == 0
