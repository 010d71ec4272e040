"""The trigram index against a plain scan, and how much it reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import substring
from pagewarden.sources.storage import Store
from pagewarden.staging import stage


def built(spark, texts, tmp_path):
    numbered = substring.numbered(spark.createDataFrame([(t,) for t in texts], "url string"), "url")
    numbered.write.partitionBy("shelf").parquet(str(tmp_path / "texts"))
    rows = spark.read.schema(numbered.schema).parquet(str(tmp_path / "texts"))
    return rows, stage(substring.postings(rows), "grams")


def scan(spark, texts, needle):
    df = spark.createDataFrame([(t,) for t in texts], "t string").distinct()
    return sorted(r["t"] for r in df.filter(F.col("t").ilike(f"%{needle}%")).collect())


@pytest.mark.parametrize("segment, shelf", [(8, 2), (substring.SEGMENT, substring.SHELF)])
def test_equals_a_scan(spark, tmp_path, monkeypatch, segment, shelf):
    monkeypatch.setattr(substring, "SEGMENT", segment)
    monkeypatch.setattr(substring, "SHELF", shelf)
    r = random.Random(segment)
    texts = ["https://" + "".join(r.choice("abÄ/%_.") for _ in range(r.randrange(20))) for _ in range(300)] + [None, "", "a", "ab", "abc", "ABC", "x" * 5000, "aaa" * 400]
    rows, lists = built(spark, texts + texts[:50], tmp_path)
    assert rows.count() == len({*texts} - {None})
    for needle in ["aab", "AÄB", "b%a/", "a_b_", "ab", "_", "", "s://", "zzz", "a%zzz", "aaaa", "bab%aba%Äb", "ttps://%abab", r"a\%b", "xxxxxx"]:
        assert sorted(x["text"] for x in substring.search(rows, lists, needle).collect()) == scan(spark, texts, needle), needle


def test_empty(spark, tmp_path):
    rows, lists = built(spark, [], tmp_path)
    assert lists.count() == 0 and substring.search(rows, lists, "abc").count() == 0 and substring.search(rows, lists, "").count() == 0


def test_reads_little(spark, tmp_path, monkeypatch, capsys):
    """A rare part of 20,000 URLs leaves few to compare and few shelves to read; lists are bounded."""
    monkeypatch.setattr(substring, "SEGMENT", 512)
    monkeypatch.setattr(substring, "SHELF", 4)
    texts = [f"https://host{i % 50}.example/dir{i}/page-{i * 7919 % 20011}" for i in range(20_000)]
    rows, lists = built(spark, texts, tmp_path)
    assert lists.agg(F.max("n")).first()[0] <= 512 and lists.filter("gram = 'htt'").count() > 20
    for needle in ("host7.example/dir1957/", "page-123", "dir77_77"):
        n = substring.candidates(lists, needle).select(F.explode("ids")).count()
        want = scan(spark, texts, needle)
        assert len(want) <= n < 400
        assert sorted(x["text"] for x in substring.search(rows, lists, needle).collect()) == want
    substring.search(rows, lists, "host7.example/dir1957/").explain("formatted")
    assert re.search(r"PartitionFilters: \[.*shelf#\d+L? (=|IN|INSET) ", capsys.readouterr().out)
    assert lists.filter(F.col("gram").isin(["dir"])).count() < 0.1 * lists.count()


def test_findings_of_a_compacted_session(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    issue = lambda i, code: (f"https://e.com/Dir{i % 40}/x{i}", code, "links", 2 + i % 2)
    rows = spark.createDataFrame([issue(i, c) for i in range(200) for c in ("A", "B")], "url string, code string, category string, severity int")
    store.append("s", "0", {"issues": rows})
    parts = ["dir7/", "dir1_/x1", "/X19", "x%9", "nothing", "r3"]
    plain = [sorted(map(tuple, store.issues("s", code="A", url_part=p, limit=500).drop("crawl_id").collect())) for p in parts]
    store.compact("s")
    assert store.names("s") == ["issues"] and store.table("url_texts", "s").count() == 200
    assert [sorted(map(tuple, store.issues("s", code="A", url_part=p, limit=500).drop("crawl_id").collect())) for p in parts] == plain
    assert [len(p) for p in plain] == [store.count_issues("s", code="A", url_part=p) for p in parts] and sum(map(len, plain)) > 50
    store.append("s", "1", {"issues": rows.limit(0).unionByName(spark.createDataFrame([("https://e.com/dir7/new", "A", "links", 1)], rows.schema))})
    assert store.count_issues("s", code="A", url_part="dir7/") == len(plain[0]) + 1  # what came since isn't in the index
