"""Verdicts by the prefix tree against a plain matcher over all rules."""

import random
import re

from pagewarden.sources import robots as rb


def fits(pattern, path):
    """* is any run of characters, a final $ the end, else what follows may be anything."""
    anchored, stem = pattern.endswith("$"), pattern[:-1] if pattern.endswith("$") else pattern
    ends = {0}  # how much of the path the pattern so far can have taken
    for c in stem:
        ends = {k for e in ends for k in range(e, len(path) + 1)} if c == "*" else {e + 1 for e in ends if path[e : e + 1] == c}
    return len(path) in ends if anchored else bool(ends)


def allowed(rules, path):
    best = max(((len(p.encode()), a) for a, p in rules if fits(p, path)), default=(0, True))
    return best[1]


def run(spark, rules, paths):
    """rules: host to (allow, pattern)."""
    body = {h: "User-agent: *\n" + "".join(f"{'Allow' if a else 'Disallow'}: {p}\n" for a, p in x) for h, x in rules.items()}
    files = spark.createDataFrame([*body.items()], "host string, body string")
    urls = spark.createDataFrame([(h, p) for h in rules for p in paths], "host string, path string")
    return rb.verdicts(rb.robots_rules(files), urls, spark.createDataFrame([("MyBot",)], "agent string"))


def test_equals_a_plain_matcher(spark):
    r = random.Random(4)
    some = lambda n: "".join(r.choice("ab/é.*$%_\\") if r.random() < 0.3 else r.choice("ab/") for _ in range(r.randrange(n)))
    rules = {f"h{i}": [(r.random() < 0.5, "/" + some(9) + r.choice(["", "", "$", "*", "*abab", "*ba/ab$"])) for _ in range(r.randrange(12))] for i in range(40)}
    paths = ["/" + some(14).replace("*", "") for _ in range(60)] + ["/", "/aé", "/ab" * 400]
    got = {(x["host"], x["path"]): x["allowed"] for x in run(spark, rules, paths).collect()}
    assert got == {(h, p): allowed(rules[h], p) for h in rules for p in paths}
    assert 0 < sum(got.values()) < len(got)


def test_ten_thousand_rules_of_a_host(spark, capsys):
    """A path meets the rules on its way down the tree, not all of its host's, and no regular expression."""
    rules = [(i % 3 == 0, f"/dir{i}/") for i in range(6000)] + [(i % 2 == 0, f"/*/item{i}-x$") for i in range(4000)] + [(False, "/")]
    paths = [f"/dir{i * 7}/page{i}" for i in range(900)] + [f"/s{i}/item{i * 5}-x" for i in range(900)]
    df = run(spark, {"big.example": rules}, paths)
    got = {x["path"]: x["allowed"] for x in df.collect()}
    for k, i in ((0, 3), (0, 4), (900, 3), (900, 4)):
        assert got[paths[k + i]] == allowed(rules, paths[k + i])
    assert all(got[f"/dir{i * 7}/page{i}"] == (i * 7 % 3 == 0 and i * 7 < 6000) for i in range(900))
    assert all(got[f"/s{i}/item{i * 5}-x"] == (i * 5 % 2 == 0 and i * 5 < 4000) for i in range(900))
    parsed = rb.robots_rules(spark.createDataFrame([("big.example", "User-agent: *\n" + "".join(f"{'Allow' if a else 'Disallow'}: {p}\n" for a, p in rules))], "host string, body string"))
    asked = spark.createDataFrame([("big.example", 0, p) for p in paths], "host string, group_no int, path string")
    hits = rb.trie(parsed).count(), rb.matched(asked, parsed).count()
    assert hits == (10_001, 1800)
    capsys.readouterr()
    df.explain()
    assert not re.search("RLIKE|NestedLoopJoin BuildRight, Inner|Cartesian", capsys.readouterr().out)


def test_patterns_without_slash_and_empty_ones(spark):
    rules = {"a": [(False, "x")], "b": [(False, "")], "c": [(True, "")], "d": [(False, "*.php$")], "e": []}
    got = {(x["host"], x["path"]): x["allowed"] for x in run(spark, rules, ["/x1", "/y.php", "/y.php?z"]).collect()}
    assert got == {(h, p): (h, p) not in {("a", "/x1"), ("d", "/y.php")} for h in rules for p in ["/x1", "/y.php", "/y.php?z"]}
