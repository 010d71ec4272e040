"""JSON-LD by variants against the walk a value at a time."""

import json
import random
import re

import pytest

from pagewarden.sources import jsonld, jsonld_sql

KEYS = ["@type", "@graph", "offers", "price", "lowPrice", "availability", "author", "creator", "datePublished", "DateModified", "name", "x y", "it's"]
TYPES = ["Product", "product", "Article", "Organization", "Place", "Thing", ["BlogPosting", "Thing"], [], [3], None, 7, {"a": 1}]
DATES = ["2024-01-02", " 2024-01-02 ", "2024-13-02", "2024-01-02T10:00:00Z", "2024-01-02\n", "soon", 2024, None]
ODD = [
    "", "  \n ", "null", "3", '"Product"', "[]", "{}", '{"@type":"A"} x', "1],[2", '1,"end"],[2', '{"@type":"A"},{"@type":"B"}', '{"a":NaN}', '{"@type":"A","@type":"Product"}', "[1,2", '{"a":1,}', "{'@type':'A'}", '\ufeff{"@type":"A"}',
    ' {"@type":"A"} ', '{"@graph":[]}', '{"@graph":[[{"@type":"A"},4],{"@graph":[{"@type":"B"}],"@type":"C"}],"@type":"D"}', '{"@graph":{"@type":"A"}}', '{"@type":"Product","offers":[{"@graph":[{"price":null}]}],"availability":null}', "[" * 7 + '{"@type":"Deep"}' + "]" * 7,
]


def value(r, depth=0):
    if depth > 4 or r.random() < 0.2:
        return r.choice([1, "x", None, True, 1.5, r.choice(DATES)])
    if r.random() < 0.3:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {k: r.choice(TYPES) if k == "@type" else r.choice(DATES) if k.lower() in jsonld.DATE_FIELDS and r.random() < 0.8 else value(r, depth + 1) for k in r.sample(KEYS, r.randrange(1, 7))}


@pytest.fixture(scope="module")
def raws():
    r = random.Random(6)
    return ODD + [json.dumps(value(r)) for _ in range(60)]


def test_equals_the_walk(spark, raws, capsys):
    df = spark.createDataFrame([(i // 3, i, x) for i, x in enumerate(raws)], "page_id long, block int, raw string")
    values = jsonld_sql.parsed(df)
    got = {}
    for x in sorted(jsonld_sql.records(values, ["page_id", "block"]).collect(), key=lambda x: (x["block"], x["path"])):
        got.setdefault(x["block"], []).append({k: x[k] for k in ("schema_type", "raw_json", "is_valid_json", "is_google_eligible")})
    want = {i: found for i, x in enumerate(raws) if (found := jsonld.parse_json_ld(x))}
    assert got == want
    audited = {x["page_id"]: x.asDict() for x in jsonld_sql.audit(values, ["page_id"]).collect()}
    by_page = {}
    for i, found in want.items():
        by_page.setdefault(i // 3, []).extend(found)
    assert audited == {p: {"page_id": p} | jsonld.audit_schemas(found) for p, found in by_page.items()}
    assert all(sum(x[n] for x in audited.values()) for n in jsonld.AUDIT_FIELDS if n != "n_schema_incomplete")
    capsys.readouterr()
    jsonld_sql.audit(values, ["page_id"]).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
    assert jsonld_sql.audit(values.limit(0), ["page_id"]).count() == 0


def test_blocks_of_pages(spark):
    html = """<SCRIPT type="application/ld+json" id=x>{"a":"<script>"}</SCRIPT ><script>var a = "application/ld+json"</script><p>
    <script type='application/ld+json'>[1]</script><script type=application/ld+json>2</script><script id=y type="text/x">3</script><script type="application/ld+json">unclosed"""
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "<script " * 9000), (5, '<script type="application/ld+json">' * 9000)], "page_id long, html string")
    got = sorted((x["page_id"], x["block"], x["raw"]) for x in jsonld_sql.blocks(pages, "html", "page_id").collect())
    assert got == [(1, 0, '{"a":"<script>"}'), (1, 2, "[1]"), (1, 3, "2")]
