"""The graph queries run the operators of the audit, and their nodes grow with the tables."""

import os

import duckdb
import pytest

from pagewarden.operators import graph as g
from pagewarden.operators import graph_rules as gr
from pagewarden.plans import all_queries, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
all_queries()


@pytest.mark.parametrize(
    "name, module, operator",
    [("graph_orphans", gr, "orphans"), ("graph_dead_ends", gr, "architecture"), ("graph_hubs_topk", g, "degrees"), ("hreflang_reciprocity", gr, "hreflang_rules"), ("canonical_loops", g, "canonical_loops"), ("site_link_degrees", g, "build_graph"), ("duplicate_rules", gr, "duplicate_rules")],
)
def test_runs_the_operator(spark, monkeypatch, name, module, operator):
    whole, calls = getattr(module, operator), []
    monkeypatch.setattr(module, operator, lambda *a, **b: calls.append(1) or whole(*a, **b))
    registry.QUERIES[name](spark, SF)
    assert calls


def test_a_node_for_every_key(spark):
    keys = {"orders": ("o_custkey", "o_orderkey"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"), "supplier": ("s_suppkey", "s_suppkey")}
    kinds = {"custkey": set(), "orderkey": set(), "partkey": set(), "suppkey": set()}
    for table, columns in keys.items():
        for c in columns:
            kinds[c[2:]] |= {x for x, in duckdb.sql(f"SELECT DISTINCT {c} FROM '{SF}/{table}.parquet'").fetchall()}
    kinds["custkey"] |= kinds["suppkey"]  # every supplier leads to the customer of its number
    nodes = sum(map(len, kinds.values()))
    assert registry.QUERIES["graph_degrees_whole"](spark, SF).count() == nodes > 997


def test_redirects_longer_than_a_thousand(spark):
    chain, loop = [(i, i + 1) for i in range(1100)], [(5000 + i, 5000 + (i + 1) % 1050) for i in range(1050)] + [(9000, 5000)]
    edges = spark.createDataFrame([(a, b, "redirect") for a, b in chain + loop], "src long, dst long, edge_type string")
    got = {r["start"]: (r["path"], r["is_loop"]) for r in g.redirect_paths(edges).collect()}
    assert len(got) == len(chain) + len(loop)
    assert all(got[i] == (list(range(i, 1101)), False) for i in range(1100))
    assert got[5001] == ([*range(5001, 6050), 5000, 5001], True) and got[9000] == ([9000, *range(5000, 6050), 5000], True)


def test_near_pairs_by_shuffles(spark):
    """The keys of a hash, twenty times its rows, are not broadcast through the driver."""
    from pagewarden.operators import duplicates as dup

    values = [(1 << 59) - 7 * i for i in range(40)] + [5 ^ 1 << i for i in range(0, 60, 3)] + [5, 5, 0]
    hashes = spark.createDataFrame([(i, v, f"n{v}") for i, v in enumerate(values)], "doc_id long, simhash long, name string")
    near = dup.near_pairs(hashes.select("simhash"))
    want = {(a, b, (a ^ b).bit_count()) for a in values for b in values if 0 < a < b and (a ^ b).bit_count() <= 3}
    assert sorted(map(tuple, near.collect())) == sorted(want)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    named = dup.near_pairs(hashes.drop("doc_id"), keep=("name",))
    assert {(r["a"], r["b"], r["name_a"], r["name_b"]) for r in named.collect()} == {(a, b, f"n{a}", f"n{b}") for a, b, _ in want}


def _ranks(nodes, links, rounds, tolerance):
    """PageRank in plain Python."""
    n, out = len(nodes), {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    ranks = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        new = dict.fromkeys(nodes, (0.15 + 0.85 * sum(r for x, r in ranks.items() if x not in out)) / n)
        for a, bs in out.items():
            for b in bs:
                if a in ranks and b in new:
                    new[b] += 0.85 * ranks[a] / len(bs)
        moved, ranks = sum(abs(new[x] - ranks[x]) for x in nodes), new
        if moved < tolerance:
            break
    return {x: r / sum(ranks.values()) for x, r in ranks.items()}


@pytest.mark.parametrize("rounds, tolerance", [(8, 0.0), (60, 1e-3)])
@pytest.mark.parametrize("joined", [False, True])
def test_pagerank_of_closed_and_open_groups(spark, rounds, tolerance, joined, monkeypatch):
    """Small sites on their own are iterated within tasks, others by joins; both as plain Python has it."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(g, "LOCAL", 30)
    links = [(f"{s}/{a}", f"{s}/{b}") for s in "xyz" for a, b in [(0, 1), (1, 0), (1, 2), (1, 2), (3, 1), (2, 4)]] + [("x/1", "x/gone")]
    if joined:
        links += [("w/0", "x/1"), ("w/1", "w/0")] + [(f"big/{i}", f"big/{i * 7 % 25}") for i in range(40)]
    nodes = sorted({x for link in links for x in link} - {"x/gone"} | {"lone/0"})
    edges = spark.createDataFrame([(a, b, "hyperlink", False) for a, b in links], "src string, dst string, edge_type string, is_nofollow boolean")
    got = g.pagerank(spark.createDataFrame([(x,) for x in nodes], "node string"), edges, rounds, tolerance, part=lambda c: F.split(c, "/")[0])
    want = _ranks(nodes, links, rounds, tolerance)
    assert {r["node"]: pytest.approx(r["rank"], rel=1e-9) for r in got.collect()} == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pagewarden_")]


def test_a_round_of_pagerank_writes_little(spark, tmp_path, monkeypatch):
    """Nodes that no path of so many links reaches are not written again."""
    written = []
    whole = g.bucketed
    monkeypatch.setattr(g, "bucketed", lambda df, name, key: written.append((name, (out := whole(df, name, key))[0].count())) or out)
    edges = spark.createDataFrame([(i, i + 1, "hyperlink", False) for i in range(50)], "src long, dst long, edge_type string, is_nofollow boolean")
    nodes = spark.createDataFrame([(i,) for i in range(51)], "node long")
    got = {r["node"]: r["rank"] for r in g.pagerank(nodes, edges, 8, 0.0).collect()}
    assert {x: pytest.approx(r, rel=1e-9) for x, r in got.items()} == _ranks(range(51), [(i, i + 1) for i in range(50)], 8, 0.0)
    assert written == [("shares", 50), ("nodes", 51)] + [("v", 50 - j) for j in range(8)]


def test_small_sites_need_no_join_a_round(spark, monkeypatch):
    """Links within a host: each of the little sites is iterated within a task, and no round writes a table."""
    monkeypatch.setattr(g, "bucketed", lambda *a: pytest.fail("a round by joins"))
    assert registry.QUERIES["case_graph_issues"](spark, SF).filter("code = 'WARN_LOW_INTERNAL_PAGERANK_HUB'").count() > 0


def test_alternates_get_more_tasks_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(gr, "TASK_TAGS", 10, raising=False)
    tags = spark.range(400).selectExpr("concat('p', id % 200) AS page_url", "'x' AS lang_code", "concat('p', (id * 7 + 3) % 200) AS target_url")
    pages = tags.selectExpr("page_url AS url", "200 AS status_code", "cast(NULL AS string) AS canonical_url").distinct()
    found = gr.hreflang_rules(pages, tags).filter("code = 'ERR_HREFLANG_NOT_RECIPROCAL'")
    pairs = [(f"p{i % 200}", f"p{(i * 7 + 3) % 200}") for i in range(400)]
    assert sorted((r["url"], r["related"]) for r in found.collect()) == sorted((a, b) for a, b in pairs if (b, a) not in pairs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 40), REPARTITION_BY_NUM" in plan


def test_architecture_deals_nodes_once(spark, monkeypatch):
    """The ends of all links are shuffled for the degrees alone; pages and ranks take the nodes from their buckets."""
    read = []
    for module, name in ((gr, "architecture"), (g, "pagerank")):
        whole = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a, whole=whole, **b: read.append("l_partkey" in df._jdf.queryExecution().optimizedPlan().toString()) or whole(df, *a, **b))
    found = registry.QUERIES["graph_architecture_whole"](spark, SF)
    assert read == [False, False]
    assert found.count() > 0 and not [t for t in spark.catalog.listTables() if t.name.startswith("pagewarden_")]
