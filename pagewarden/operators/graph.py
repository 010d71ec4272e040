"""The link graph: edges, degrees, PageRank, redirect paths, canonical loops.

Edges are rows (src, dst, edge_type, is_nofollow), a row for each occurrence, so parallel edges count."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import bucketed, stage

# Fixed values of PageRank.
DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
#: Nodes and links that a group has at most to be iterated within a task.
LOCAL = 500


def build_graph(pages: DataFrame, links: DataFrame, sitemap: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes(url, status_code, is_sitemap, depth) and edges, from pages(seq, url, final_url, canonical_url,
    status_code, crawl_depth), links(source_url, target_url, is_internal, is_nofollow) and sitemap(url)."""
    edge = lambda df, a, b, kind, no=F.lit(False): df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("edge_type"), no.alias("is_nofollow"))
    edges = (
        edge(pages.filter("final_url <> url"), "url", "final_url", "redirect")
        .unionByName(edge(pages.filter("canonical_url <> url"), "url", "canonical_url", "canonical"))
        .unionByName(edge(links.filter("is_internal"), "source_url", "target_url", "hyperlink", F.col("is_nofollow")))
    )
    named = lambda df, status, flag, depth, seq: df.select("url", status.cast("int").alias("status_code"), flag.alias("is_sitemap"), depth.cast("int").alias("depth"), seq.cast(pages.schema["seq"].dataType).alias("seq"))
    none = F.lit(None)
    parts = [named(pages, F.col("status_code"), F.lit(False), F.col("crawl_depth"), F.col("seq"))]
    parts += [named(edges.select(F.col(e).alias("url")), F.lit(0), F.lit(False), none, none) for e in ("src", "dst")]
    if sitemap is not None:
        parts.append(named(sitemap, F.lit(0), F.lit(True), none, none))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    last = F.max_by("status_code", F.when(F.col("status_code") != 0, F.struct("seq")))
    return nodes.groupBy("url").agg(F.coalesce(last, F.lit(0)).alias("status_code"), F.max("is_sitemap").alias("is_sitemap"), F.min("depth").alias("depth")), edges


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree over hyperlinks, occurrences and nofollow links counted."""
    # One pass over the edges and one exchange: both ends are rows of the same aggregate.
    ends = edges.filter("edge_type = 'hyperlink'").select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    all_ = ends.unionByName(nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return all_.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


class _Closed:
    """Groups of nodes that no link leaves or enters, each a row of its nodes and links, iterated within tasks: LOCAL bounds
    a group, numpy takes a batch of them at once. Only sums by round reach the driver."""

    def __init__(self, packed: DataFrame):
        self.packed = packed

    @staticmethod
    def _batch(frame):
        size = frame["n"].to_numpy(np.int64)
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        ends = [np.concatenate([x.astype(np.int64) + o for x, o in zip(frame[c], at)]) for c in ("a", "b")]
        out = np.bincount(ends[0], minlength=int(size.sum()))
        share = DAMPING / out[ends[0]]
        known = ends[1] >= np.repeat(at, [len(x) for x in frame["a"]])  # a link to no node has the place -1
        a, b, share = ends[0][known], ends[1][known], share[known]
        return out == 0, lambda r: np.bincount(b, weights=r[a] * share, minlength=len(out))

    def _sums(self, each, rounds: int) -> list[float]:
        batch = self._batch

        def run(frames):
            for f in frames:
                yield pd.DataFrame({"k": range(rounds + 1), "x": each(*batch(f))})

        sums = {r["k"]: r["x"] for r in self.packed.select("n", "a", "b").mapInPandas(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()}
        return [sums.get(k, 0.0) for k in range(rounds + 1)]

    def lost(self, rounds: int) -> list[float]:
        """What nodes without out-links hold after each round if every node starts with 1 and nothing is given to all."""

        def each(ends, step):
            v, out = np.ones(len(ends)), []
            for _ in range(rounds + 1):
                out.append(v[ends].sum())
                v = step(v)
            return out

        return self._sums(each, rounds)

    def moved(self, n: int, base: list[float]) -> list[float]:
        """How far each round moves the ranks. base: what round i gives to each node."""

        def each(ends, step):
            r, out = np.full(len(ends), 1.0 / n), [np.inf]
            for x in base[1:]:
                new = x + step(r)
                out.append(np.abs(new - r).sum())
                r = new
            return out

        return self._sums(each, len(base) - 1)

    def ranks(self, n: int, base: list[float]) -> DataFrame:
        batch = self._batch

        def run(frames):
            for f in frames:
                ends, step = batch(f)
                r = np.full(len(ends), 1.0 / n)
                for x in base[1:]:
                    r = x + step(r)
                yield pd.DataFrame({"node": [x for names in f["nodes"] for x in names], "rank": r})

        kind = self.packed.schema["nodes"].dataType.elementType.simpleString()
        return self.packed.select("n", "a", "b", "nodes").mapInPandas(run, f"node {kind}, rank double")


def _closed(nodes: DataFrame, links: DataFrame, part) -> tuple[_Closed, DataFrame | None, DataFrame | None]:
    """Groups by `part` that are closed and small, and the nodes and links of all others, None if there are none."""
    p, q = part("src"), part("dst")
    end = lambda group, count: F.struct(group.alias("part"), F.lit(count).alias("size"), F.coalesce(p != q, F.lit(True)).alias("open"))
    met = links.select(F.explode(F.array(end(p, 1), end(q, 0))).alias("e")).select("e.*")
    sizes = nodes.select(part("node").alias("part"), F.lit(1).alias("size"), F.lit(False).alias("open")).unionByName(met)
    sizes = stage(sizes.groupBy("part").agg((F.max("open") | (F.sum("size") > LOCAL) | F.col("part").isNull()).alias("open")), "parts")
    local = sizes.filter("NOT open").select("part")
    none = F.lit(None).cast(nodes.schema["node"].dataType)
    rows = nodes.select(part("node").alias("part"), F.col("node").alias("src"), none.alias("dst")).unionByName(links.select(p.alias("part"), "src", "dst"))
    rows = rows.join(local, "part").groupBy("part").agg(F.collect_list(F.when(F.col("dst").isNull(), F.col("src"))).alias("nodes"), F.collect_list(F.when(F.col("dst").isNotNull(), F.struct("src", "dst"))).alias("links"))

    def place(frames):
        for f in frames:
            found = [(names, {x: i for i, x in enumerate(names)}, a, b) for names, a, b in zip(f["nodes"], f["a"], f["b"])]
            kept = [(names, at, [(at[x], at.get(y, -1)) for x, y in zip(a, b) if x in at]) for names, at, a, b in found]
            yield pd.DataFrame({"nodes": [names for names, _, _ in kept], "n": [len(at) for _, at, _ in kept], "a": [[x for x, _ in e] for *_, e in kept], "b": [[y for _, y in e] for *_, e in kept]})

    kind = nodes.schema["node"].dataType.simpleString()
    packed = rows.select("nodes", F.col("links.src").alias("a"), F.col("links.dst").alias("b")).mapInPandas(place, f"nodes array<{kind}>, n int, a array<int>, b array<int>")
    closed = _Closed(stage(packed, "closed"))
    if not sizes.filter("open").limit(1).count():
        return closed, None, None
    outside = lambda df, end: df.join(local.select(F.col("part").alias("p")), part(end) == F.col("p"), "left_anti")
    return closed, stage(outside(nodes, "node"), "nodes"), outside(links, "src")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE, part=None) -> DataFrame:
    """node, rank over followed hyperlinks; nodes without out-links give to all. Ranks sum to 1.

    Parallel edges are one edge with a weight. Links lie in buckets by source and ranks in buckets by node, so a round
    shuffles only what nodes get; the only figures that reach the driver are sums. part: a function of a column's name
    that gives a node's group, such as a host; small groups that no link leaves are iterated within tasks.

    A round gives each node base + DAMPING * what it gets, so ranks after k rounds are the sum over j of
    base[k - j] * v[j] (1 / n for base[0]), where v[0] is 1 everywhere and v[j] what nodes get of v[j - 1]. If rounds are fixed,
    these v are passed on in place of ranks: nodes to which no path of j links leads drop out."""
    nodes = stage(nodes.select("node").distinct(), "nodes")
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    links = edges.filter("edge_type = 'hyperlink' AND NOT is_nofollow").select("src", "dst")
    closed = None
    if part is not None:
        closed, nodes, links = _closed(nodes, links, part)
    held = closed.lost(rounds) if closed else [0.0] * (rounds + 1)
    base, tables = [1.0 / n], []

    def bucket(df, name, key):
        out, table = bucketed(df, name, key)
        tables.append(table)
        return out

    def lost(k, sums):
        return sums[k] / n + sum(base[k - j] * sums[j] for j in range(k))

    def give(x):
        base.append((1 - DAMPING) / n + DAMPING * x / n)

    ranks, summed = None, lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0.0)).alias("x")).first()["x"]
    if nodes is None:
        for k in range(rounds):
            give(lost(k, held))
        if tolerance > 0:
            stop = next((k for k, x in enumerate(closed.moved(n, base)) if x < tolerance), rounds)
            base = base[: stop + 1]
    else:
        # Rows come dealt by source, so weights, their sums and the buckets need one exchange.
        counted = links.repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
        shares = bucket(counted.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("share")), "shares", "src")
        gives = shares.select(F.col("src").alias("node")).distinct().withColumn("gives", F.lit(True))
        nodes = bucket(nodes.join(gives, "node", "left").select("node", F.coalesce("gives", F.lit(False)).alias("gives")), "nodes", "node")
        got_of = lambda df, c: shares.join(df.select(F.col("node").alias("src"), F.col(c).alias("x")), "src").groupBy(F.col("dst").alias("node")).agg((DAMPING * F.sum(F.col("x") * F.col("share"))).alias("got"))
        loose = lambda df, c: summed(df, F.when(~F.col("gives"), F.col(c)))
        if tolerance > 0:
            ranks = nodes.withColumn("rank", F.lit(1.0 / n))
            for k in range(rounds):
                give(lost(k, held) + loose(ranks, "rank"))
                new = ranks.join(got_of(ranks, "rank"), "node", "left").select("node", "gives", (F.lit(base[-1]) + F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
                ranks = bucket(new, "ranks", "node")
                moved = summed(ranks, F.abs(F.col("rank") - F.col("old")))
                ranks = ranks.drop("old")
                if moved < tolerance and (not closed or moved + closed.moved(n, base)[-1] < tolerance):
                    break
        else:
            parts = [nodes.withColumn("v", F.lit(1.0))]
            sums = [held[0] + loose(parts[0], "v")]
            for k in range(rounds):
                give(lost(k, sums))
                # A node that gets nothing isn't written; neither is one outside of nodes.
                v = got_of(parts[-1], "v") if k else shares.groupBy(F.col("dst").alias("node")).agg((DAMPING * F.sum("share")).alias("got"))
                parts.append(bucket(nodes.join(v.filter("got > 0"), "node").select("node", "gives", F.col("got").alias("v")), "v", "node"))
                sums.append(held[k + 1] + loose(parts[-1], "v"))
            each = [p.select("node", (F.lit(base[rounds - j]) * F.col("v")).alias("x")) for j, p in enumerate(parts) if j]
            rest = nodes.select("node", F.lit(0.0).alias("x")).limit(0)
            for p in each:
                rest = rest.unionByName(p)
            rest = rest.groupBy("node").agg(F.sum("x").alias("x"))
            ranks = nodes.join(rest, "node", "left").select("node", (F.lit(base[rounds]) + F.coalesce("x", F.lit(0.0))).alias("rank"))
        ranks = ranks.select("node", "rank")
    if closed:
        own = closed.ranks(n, base)
        ranks = own if ranks is None else ranks.unionByName(own)
    ranks = stage(ranks, "ranks")
    for table in tables:
        ranks.sparkSession.sql(f"DROP TABLE {table}")
    whole = summed(ranks, "rank")
    return ranks.select("node", (F.col("rank") / F.lit(whole)).alias("rank"))


def pagerank_sql(nodes: str, edges: str, rounds: int, digits: int = 8) -> str:
    """The same for DuckDB over tables nodes(node) and edges(src, dst), a fixed number of rounds."""
    ctes = [
        f"n AS MATERIALIZED (SELECT DISTINCT node FROM {nodes})", "c AS (SELECT count(*)::DOUBLE AS c FROM n)",
        f"w AS (SELECT src, dst, count(*)::DOUBLE AS w FROM {edges} GROUP BY src, dst)",
        "s AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w)",
        "r0 AS (SELECT node, node IN (SELECT src FROM s) AS gives, 1 / c AS rank FROM n, c)",
    ]
    for i in range(rounds):
        ctes.append(
            f"r{i + 1} AS MATERIALIZED (SELECT r.node, r.gives, {1 - DAMPING} / c + {DAMPING} * (SELECT coalesce(sum(rank) FILTER (NOT gives), 0) FROM r{i}) / c + {DAMPING} * coalesce(g.got, 0) AS rank"
            f" FROM r{i} AS r CROSS JOIN c LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM s JOIN r{i} ON src = node GROUP BY dst) AS g ON g.dst = r.node)"
        )
    return "WITH " + ",\n".join(ctes) + f" SELECT node, round(rank / (SELECT sum(rank) FROM r{rounds}), {digits}) AS rank FROM r{rounds}"


def redirect_paths(edges: DataFrame) -> DataFrame:
    """start, path, is_loop: from every source of a redirect, the nodes along first redirects until one
    repeats or has none. The first redirect of a node is the one to the least target.

    A round puts behind a path the one that starts where it ends, so that paths double."""
    step = edges.filter("edge_type = 'redirect' AND src <> dst").groupBy("src").agg(F.min("dst").alias("dst"))
    paths = stage(step.select(F.col("src").alias("start"), F.array("src", "dst").alias("path"), F.lit(False).alias("is_loop"), F.lit(False).alias("ended")), "paths")
    while paths.filter("NOT ended").limit(1).count():
        behind = paths.select(F.col("start").alias("at"), F.col("path").alias("more"), F.col("ended").alias("last"))
        met = paths.filter("NOT ended").withColumn("at", F.element_at("path", -1)).join(behind, "at", "left")
        met = met.withColumn("path", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.expr("concat(path, slice(more, 2, size(more)))")))
        # Nodes after the first that repeats have all been seen: the distinct ones come before it.
        met = met.withColumn("n", F.size(F.array_distinct("path"))).withColumn("is_loop", F.col("n") < F.size("path"))
        new = met.select("start", F.expr("slice(path, 1, n + 1)").alias("path"), "is_loop", (F.col("is_loop") | F.col("more").isNull() | F.coalesce("last", F.lit(False))).alias("ended"))
        paths = stage(paths.filter("ended").unionByName(new), "paths")
    return paths.drop("ended")


def redirect_loops(paths: DataFrame) -> DataFrame:
    """cycle, from its least node round to it again; each once."""
    inner = paths.filter("is_loop AND path[0] = path[size(path) - 1]")
    return inner.filter("path[0] = array_min(path)").select(F.col("path").alias("cycle")).distinct()


def redirect_chains(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """start, path of three nodes or more, from sources to which nothing redirects."""
    targets = edges.filter("edge_type = 'redirect' AND src <> dst").select(F.col("dst").alias("start")).distinct()
    seen = F.expr("CASE WHEN is_loop THEN slice(path, 1, size(path) - 1) ELSE path END")
    return paths.join(targets, "start", "left_anti").select("start", seen.alias("path")).filter("size(path) >= 3")


def canonical_loops(edges: DataFrame) -> DataFrame:
    """a, b with a < b whose canonicals name each other."""
    canon = edges.filter("edge_type = 'canonical' AND src <> dst").select("src", "dst").distinct()
    back = canon.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return canon.join(back, ["src", "dst"]).filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
