"""License scans against a brute force over words, and on nulls, empties, repeats and clashing columns."""

import random
import re

import pytest

from pagewarden.llm import licenses

DOCS = "doc_id long, text string, row string, i string, label string, n_words int"
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = [(label, text.split()) for label, text in licenses.PHRASES]


def cut(text):
    return TOKEN.findall((text or "").translate(LOWER))


def places(text):
    w = cut(text)
    return [(i, label) for i in range(len(w)) for label, v in PHRASES if w[i : i + len(v)] == v]


def brute(doc_id, text):
    at = places(text)
    return doc_id, len(cut(text)), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", 1) for r in rows], DOCS)
    return [tuple(x) for x in licenses.summary(df).collect()]


def test_phrases_equal_brute_force(spark):
    r = random.Random(2)
    some = "CC by general public License all rights reserved of the cc-by x2 é\u212a. , \n - _ all All".split(" ")
    rows = [(i, "".join(r.choice(some) + r.choice([" ", "-", "\t\n", "; ", ""]) for _ in range(r.randrange(60)))) for i in range(150)]
    got = run(spark, rows)
    assert sorted(x[:6] for x in got) == sorted(brute(*x) for x in rows)
    assert all(set(x[5].split(",")) - {""} <= set(x[6].split(",")) and 0 <= x[7] <= 1 and (x[7] == 1) >= (x[2] > 0) for x in got)
    assert sum(x[2] for x in got) > 100


def labels(spark, text):
    (x,) = run(spark, [(1, text)])
    return x[6], x[7]


def test_notices(spark):
    prose = " ".join(f"word{i}" for i in range(300))
    for label, text in licenses.NOTICES:
        found, score = labels(spark, f"{prose} {text.upper()}. {prose}")
        assert label in found.split(",") and score == 1
    permission = next(t for label, t in licenses.NOTICES if t.startswith("Permission is hereby granted, free"))
    # words put in, left out and changed move the rest to neighbouring diagonals
    w = permission.split()
    altered = " ".join([*w[:9], "really", *w[9:16], *w[17:]])
    found, score = labels(spark, f"{prose} {altered} {prose}")
    assert found == "mit" and 0.75 <= score < 1
    # pieces far apart, or the same words in another order, are no notice
    assert labels(spark, f"{' '.join(w[:12])} {prose} {' '.join(w[12:])}") == ("", 0.0)
    shuffled = w[:]
    random.Random(1).shuffle(shuffled)
    assert labels(spark, " ".join(shuffled)) == ("", 0.0)
    assert labels(spark, prose) == ("", 0.0)


def test_spans_of_repeated_notices(spark):
    _, mit = next((k, t) for k, t in licenses.NOTICES if t.startswith("Released"))
    text = f"{mit} and then {mit}. {'x ' * 50}{mit}"
    every, found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    at = sorted((x["first_word"], x["end_word"]) for x in found.filter("label = 'mit'").collect())
    assert at == [(0, 5), (7, 12), (62, 67)]


def test_odd_rows(spark):
    long = "all rights reserved cc by " * 60_000
    rows = [(None, None), (None, "cc by"), (1, ""), (1, "-- \n"), (1, "cc"), (1, "cc by"), (1, "cc by"), (2, "by"), (3, long), (4, "cc\u212ay cc b\u212a C\u212a by \u212acc by"), (5, "general public"), (6, "cc\x7fby a_b 10l")]
    got = run(spark, rows)
    assert sorted((x[:6] for x in got), key=str) == sorted((brute(*x) for x in rows), key=str)
    assert run(spark, []) == []


def test_templates_are_checked(spark):
    with pytest.raises(ValueError):
        licenses.templates(spark, [("x", "four words are many")], [])
    with pytest.raises(ValueError):
        licenses.templates(spark, [], [("x", "one")])


def test_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    licenses.summary(df.select("doc_id", "text").filter("doc_id > 0")).explain()
    assert not re.search("Python|Pandas|Arrow|MapPartitions|ScanRDD", capsys.readouterr().out)
