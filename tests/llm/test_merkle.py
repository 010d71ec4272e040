"""The Merkle manifest against plain loops, and on nulls, empties, repeats and clashing columns."""

import hashlib
import random
import zlib

import pytest

from pagewarden.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, proof int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """The root, and the siblings of each node with their side."""
    paths, at, level = [[] for _ in nodes], [*range(len(nodes))], nodes
    while len(level) > 1:
        for path, i in zip(paths, at):
            if (i ^ 1) < len(level):
                path.append((level[i ^ 1], i % 2 == 1))
            else:
                path.append((None, i % 2 == 1))
        at = [i // 2 for i in at]
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def fold(x, path):
    for sibling, left in path:
        x = H(x) if sibling is None else H(sibling, x) if left else H(x, sibling)
    return x


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(*r)))
    names = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    below = {g: climb([x for _, x in groups[g]]) for g in names}
    root, crown = climb([below[g][0] for g in names])
    out = []
    for g, high in zip(names, crown):
        for (r, x), path in zip(groups[g], below[g][1]):
            path = path + high
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            back = fold(leaf(*r[:4], r[4] + 1) if changed else x, path)
            out.append((r[0], x, below[g][0], root, H(*[s for s, _ in path if s]), back, back == root))
    return out


def run(spark, rows, bits):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    out = merkle.verified(df, bits)
    return [tuple(x) for x in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


@pytest.mark.parametrize("bits", [1, 3, merkle.BITS])
def test_equals_plain_loops(spark, bits):
    r = random.Random(bits)
    langs = ["en"] * 60 + ["de", "é", "z" * 30, "", None]
    rows = [(i * 3, "x" * r.randrange(50), r.choice(langs), r.choice(["a", None]), r.choice([None, i])) for i in range(140)]
    want = brute(rows)
    assert sorted(run(spark, rows, bits), key=str) == sorted(want, key=str)
    assert 0 < sum(not w[-1] for w in want) < len(want)


def test_odd_rows(spark):
    """Repeated rows and ids, null ids and texts, one very long text, values that look like null or like another's length."""
    rows = [(7, None, None, None, None), (7, None, None, None, None), (7, "", "", "", 0), (None, "-", "-", "-", 1), (None, "a", "en", "s", 2), (5, "y" * 3_000_000, "en", "s", 3_000_000), (5, "z", "en", "s", 1), (6, "1:a", "en", "1:", 3)]
    assert sorted(run(spark, rows, 1), key=str) == sorted(brute(rows), key=str)
    assert run(spark, [], 2) == []
    assert run(spark, rows[-1:], 2) == brute(rows[-1:])  # the leaf is the root, the proof is empty


def test_proofs_show_each_change(spark):
    """Any other value in any field gives another root with the original's siblings."""
    rows = [(i, f"text {i}", "en", "s", i) for i in range(20)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    for x in merkle.manifest(df, bits=2).collect():
        path = [(s["hash"], s["left"]) for s in x["proof"]]
        i = x["doc_id"]
        assert fold(leaf(*rows[i]), path) == x["root"]
        for changed in ((i, f"text {i} ", "en", "s", i), (i, None, "en", "s", i), (i, f"text {i}", "e", "ns", i)):
            assert fold(leaf(*changed), path) != x["root"]
