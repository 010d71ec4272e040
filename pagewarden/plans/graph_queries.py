"""Queries over graphs, duplicates and event streams, on graphs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dialect import DUCK, SPARK
from ..operators import duplicates as dup
from ..operators import graph as g
from ..operators import graph_rules as gr
from ..sources import markup
from ..staging import bucketed
from .registry import load, query, sql_query, views

#: A directed multigraph over part numbers, a row of lineitem an edge.
EDGES = "SELECT l_partkey % 997 AS src, (l_suppkey * 7 + l_linenumber * 13 + l_partkey) % 997 AS dst FROM lineitem"
#: A redirect for every supplier, so chains run into loops.
REDIRECTS = "SELECT s_suppkey AS src, (s_suppkey * s_suppkey + s_nationkey + 1) % 1000 AS dst FROM supplier"
CANONICALS = "SELECT c_custkey AS src, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 3 - 6 * (c_custkey % 2) ELSE c_custkey * 5 % 1009 END AS dst FROM customer"


def _edges(spark: SparkSession, sf_dir: str, sql: str, kind: str) -> DataFrame:
    views(spark, sf_dir, "lineitem", "supplier", "customer")
    return spark.sql(sql).select("src", "dst", F.lit(kind).alias("edge_type"), F.lit(False).alias("is_nofollow"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


@query(
    "graph_degrees",
    lambda: f"SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM ({EDGES}) UNION ALL SELECT dst, 1, 0 FROM ({EDGES})) GROUP BY node",
)
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir, EDGES, "hyperlink")
    return g.degrees(_nodes(edges), edges)


@query("pagerank_fixed", lambda: g.pagerank_sql(f"(SELECT src AS node FROM ({EDGES}) UNION SELECT dst FROM ({EDGES}))", f"({EDGES})", 8))
def pagerank_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir, EDGES, "hyperlink")
    return g.pagerank(_nodes(edges), edges, rounds=8, tolerance=0.0).select("node", F.round("rank", 8).alias("rank"))


@query(
    "redirect_paths",
    lambda: f"""WITH RECURSIVE s AS (SELECT src, min(dst) AS dst FROM ({REDIRECTS}) WHERE src <> dst GROUP BY src),
        p(start, here, path, is_loop) AS (SELECT src, dst, [src, dst], FALSE FROM s UNION ALL
          SELECT p.start, s.dst, list_append(p.path, s.dst), list_contains(p.path, s.dst) FROM p JOIN s ON p.here = s.src WHERE NOT p.is_loop)
        SELECT start, array_to_string(path, '>') AS path, is_loop FROM p WHERE is_loop OR here NOT IN (SELECT src FROM s)""",
)
def redirect_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.redirect_paths(_edges(spark, sf_dir, REDIRECTS, "redirect")).select("start", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "is_loop")


@query(
    "canonical_loops",
    lambda: f"SELECT a.src AS a, a.dst AS b FROM (SELECT DISTINCT src, dst FROM ({CANONICALS}) AS c) AS a JOIN (SELECT DISTINCT src, dst FROM ({CANONICALS}) AS c) AS b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst",
)
def canonical_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.canonical_loops(_edges(spark, sf_dir, CANONICALS, "canonical"))


@query(
    "dup_titles",
    lambda: f"SELECT page_id, primary_id FROM (SELECT page_id, min(page_id) OVER (PARTITION BY title) AS primary_id FROM ({markup.features_sql(DUCK)}) AS f WHERE title IS NOT NULL) AS w WHERE page_id <> primary_id",
)
def dup_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "pages")
    return dup.duplicates(spark.sql(markup.features_sql(SPARK)).select("page_id", "title"), "title").select("page_id", F.col("primary").alias("primary_id"))


@query(
    "dup_content_exact",
    lambda: f"SELECT doc_id, primary_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {tx.clean(DUCK, 'text')}) AS primary_id FROM documents WHERE text IS NOT NULL) AS w WHERE doc_id <> primary_id",
)
def dup_content_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.expr(tx.clean(SPARK, "text")), 256).alias("content"))
    return dup.duplicates(hashed, "content", "doc_id").select("doc_id", F.col("primary").alias("primary_id"))


def _simhash_duck() -> str:
    return f"(SELECT doc_id, {tx.simhash_sums(DUCK, 'h')} AS simhash FROM (SELECT doc_id, {DUCK.hash('token')} AS h FROM (SELECT doc_id, unnest({tx.tokens(DUCK, 'text')}) AS token FROM documents) AS t) AS k GROUP BY doc_id)"


@query("simhash_documents", lambda: f"SELECT doc_id, simhash FROM {_simhash_duck()} AS s")
def simhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.simhashes(load(spark, sf_dir, "documents"), "text")


@query(
    "dup_content_near",
    lambda: f"""WITH s AS MATERIALIZED (SELECT simhash, min(doc_id) AS first_id, count(*) AS n FROM {_simhash_duck()} AS x WHERE simhash <> 0 GROUP BY simhash)
        SELECT a.first_id AS first_a, a.n AS rows_a, b.first_id AS first_b, b.n AS rows_b, bit_count(xor(a.simhash, b.simhash))::INT AS distance
        FROM s AS a JOIN s AS b ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3""",
)
def dup_content_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of simhash classes within three bits, with each class's first document and size."""
    classes = dup.first_of_class(dup.simhashes(load(spark, sf_dir, "documents"), "text")).withColumnRenamed("first_id", "first")
    return dup.near_pairs(classes, keep=("first", "rows")).select("first_a", "rows_a", "first_b", "rows_b", F.col("distance").cast("int").alias("distance"))


@sql_query("broken_internal_links", "lineitem", "supplier")
def broken_internal_links(d):
    """Links whose target answers 404: here suppliers with an id divisible by 9 do."""
    return "SELECT l_orderkey AS source, l_suppkey AS target, count(*) AS links FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 9 = 0 GROUP BY l_orderkey, l_suppkey"


def _urls(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("graph_orphans", lambda: "SELECT url_id FROM (SELECT p_partkey + 100 AS url_id FROM part) AS p ANTI JOIN lineitem ON l_partkey = url_id")
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap entries to which no link leads: every part is linked, so the sitemap is shifted by 100 and ends with some that aren't."""
    sitemap = load(spark, sf_dir, "part").select((F.col("p_partkey") + 100).cast("string").alias("url"))
    edges = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("dst"), F.lit("hyperlink").alias("edge_type"))
    crawled = sitemap.limit(0).withColumn("crawl_depth", F.lit(None).cast("int"))
    return gr.orphans(crawled, sitemap, edges, exhaustive=True).select(F.col("url").cast("long").alias("url_id"))


@query("graph_dead_ends", lambda: f"SELECT DISTINCT dst AS node FROM (SELECT dst + 500 AS dst FROM ({EDGES}) AS e) AS t WHERE dst NOT IN (SELECT src FROM ({EDGES}) AS e WHERE src IS NOT NULL)")
def graph_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir, EDGES, "hyperlink").withColumn("dst", F.col("dst") + 500)
    nodes = _nodes(edges)
    ranks = nodes.limit(0).withColumn("rank", F.lit(0.0))  # dead ends are told by degrees alone
    found = gr.architecture(nodes.select(F.col("node").alias("url"), F.lit(0).alias("crawl_depth")), g.degrees(nodes, edges), ranks)
    return found.filter("code = 'WARN_GRAPH_DEAD_END_PAGE'").select(F.col("url").cast("long").alias("node"))


def _hubs(edges: DataFrame) -> DataFrame:
    return g.degrees(_nodes(edges), edges).filter("out_degree > 0").orderBy(F.desc("out_degree"), "node").limit(15).select("node", "out_degree")


@query("graph_hubs_topk", lambda: f"SELECT src AS node, count(*) AS out_degree FROM ({EDGES}) AS e GROUP BY src ORDER BY out_degree DESC, node LIMIT 15")
def graph_hubs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hubs(_edges(spark, sf_dir, EDGES, "hyperlink"))


def _not_reciprocal(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Alternates that don't point back; all targets count as crawled."""
    views(spark, sf_dir, "orders")
    tags = _urls(spark.sql(sql)).select(F.col("page").alias("page_url"), F.lit("x").alias("lang_code"), F.col("target").alias("target_url"))
    pages = tags.select(F.col("target_url").alias("url")).distinct().select("url", F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("canonical_url"))
    found = gr.hreflang_rules(pages, tags).filter("code = 'ERR_HREFLANG_NOT_RECIPROCAL'")
    return found.select(F.col("url").cast("long").alias("page"), F.col("related").cast("long").alias("target"))


def _not_reciprocal_sql(tags: str) -> str:
    return f"SELECT a.page, a.target FROM ({tags}) AS a ANTI JOIN ({tags}) AS b ON a.page = b.target AND a.target = b.page"


#: A derived relation of pages and targets.
TAGS = "SELECT DISTINCT o_custkey % 211 AS page, o_orderkey % 211 AS target FROM orders"


@query("hreflang_reciprocity", lambda: _not_reciprocal_sql(TAGS))
def hreflang_reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _not_reciprocal(spark, sf_dir, TAGS)


# The same over whole keys, so that nodes grow with the tables. A node's kind is its number % 4: customer, order, part, supplier.

WHOLE_EDGES = """SELECT o_custkey * 4 AS src, o_orderkey * 4 + 1 AS dst FROM orders UNION ALL SELECT l_orderkey * 4 + 1, l_partkey * 4 + 2 FROM lineitem
    UNION ALL SELECT l_partkey * 4 + 2, l_suppkey * 4 + 3 FROM lineitem UNION ALL SELECT s_suppkey * 4 + 3, s_suppkey * 4 FROM supplier"""
#: Chains down to customer 0 or into a loop of two.
WHOLE_REDIRECTS = "SELECT c_custkey AS src, CASE WHEN c_custkey % 4 = 2 THEN c_custkey + 1 WHEN c_custkey % 4 = 3 THEN c_custkey - 1 ELSE CAST((c_custkey - c_custkey % 2) / 2 AS BIGINT) END AS dst FROM customer"
WHOLE_CANONICALS = "SELECT c_custkey AS src, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 3 - 6 * (c_custkey % 2) ELSE c_custkey + 1 END AS dst FROM customer"
#: Customers name their orders; two thirds of the orders name their customer.
WHOLE_TAGS = "SELECT o_custkey * 2 AS page, o_orderkey * 2 + 1 AS target FROM orders UNION ALL SELECT o_orderkey * 2 + 1, o_custkey * 2 FROM orders WHERE o_orderkey % 3 <> 0"
WHOLE_NODES = f"SELECT src AS node FROM ({WHOLE_EDGES}) UNION SELECT dst FROM ({WHOLE_EDGES})"
WHOLE_DEGREES = f"SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM ({WHOLE_EDGES}) UNION ALL SELECT dst, 1, 0 FROM ({WHOLE_EDGES})) GROUP BY node"


def _whole_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return _edges(spark, sf_dir, WHOLE_EDGES, "hyperlink")


@query("graph_degrees_whole", lambda: WHOLE_DEGREES)
def graph_degrees_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _whole_edges(spark, sf_dir)
    return g.degrees(_nodes(edges), edges)


@query("graph_hubs_whole", lambda: f"SELECT src AS node, count(*) AS out_degree FROM ({WHOLE_EDGES}) AS e GROUP BY src ORDER BY out_degree DESC, node LIMIT 15")
def graph_hubs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hubs(_whole_edges(spark, sf_dir))


@query("pagerank_whole", lambda: g.pagerank_sql(f"({WHOLE_NODES})", f"({WHOLE_EDGES})", 8, digits=14))
def pagerank_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _whole_edges(spark, sf_dir)
    return g.pagerank(_nodes(edges), edges, rounds=8, tolerance=0.0).select("node", F.round("rank", 14).alias("rank"))


@query(
    "graph_architecture_whole",
    lambda: f"""WITH a AS (SELECT d.node, in_degree, out_degree, rank FROM ({WHOLE_DEGREES}) AS d JOIN ({g.pagerank_sql(f"({WHOLE_NODES})", f"({WHOLE_EDGES})", 8, digits=14)}) AS r ON d.node = r.node)
        SELECT node::VARCHAR AS url, 'WARN_GRAPH_DEAD_END_PAGE' AS code FROM a WHERE in_degree > 0 AND out_degree = 0
        UNION ALL SELECT node::VARCHAR, 'WARN_GRAPH_HIGH_CRAWL_DEPTH' FROM a WHERE node % 7 > 4
        UNION ALL SELECT node::VARCHAR, 'WARN_LOW_INTERNAL_PAGERANK_HUB' FROM a WHERE out_degree >= 50 AND (rank < 0.0001 OR in_degree <= 1)""",
)
def graph_architecture_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _whole_edges(spark, sf_dir)
    # Degrees name every end of an edge, so these are dealt by node once and all else reads them in their buckets.
    degrees, table = bucketed(g.degrees(edges.select(F.col("src").alias("node")).limit(0), edges), "degrees", "node")
    nodes = degrees.select("node")
    pages = nodes.select(F.col("node").alias("url"), (F.col("node") % 7).cast("int").alias("crawl_depth"))
    ranks = g.pagerank(nodes, edges, rounds=8, tolerance=0.0)
    spark.sql(f"DROP TABLE {table}")  # its files stay until the session ends
    return gr.architecture(pages, degrees, ranks).select("url", "code")


@query(
    "redirect_paths_whole",
    lambda: f"""WITH RECURSIVE s AS (SELECT src, min(dst) AS dst FROM ({WHOLE_REDIRECTS}) WHERE src <> dst GROUP BY src),
        p(start, here, path, is_loop) AS (SELECT src, dst, [src, dst], FALSE FROM s UNION ALL
          SELECT p.start, s.dst, list_append(p.path, s.dst), list_contains(p.path, s.dst) FROM p JOIN s ON p.here = s.src WHERE NOT p.is_loop)
        SELECT start, array_to_string(path, '>') AS path, is_loop FROM p WHERE is_loop OR here NOT IN (SELECT src FROM s)""",
)
def redirect_paths_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.redirect_paths(_edges(spark, sf_dir, WHOLE_REDIRECTS, "redirect")).select("start", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "is_loop")


@query("canonical_loops_whole", lambda: f"SELECT a.src AS a, a.dst AS b FROM ({WHOLE_CANONICALS}) AS a JOIN ({WHOLE_CANONICALS}) AS b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def canonical_loops_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.canonical_loops(_edges(spark, sf_dir, WHOLE_CANONICALS, "canonical"))


@query("hreflang_whole", lambda: _not_reciprocal_sql(WHOLE_TAGS))
def hreflang_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _not_reciprocal(spark, sf_dir, WHOLE_TAGS)


def _links_oracle() -> str:
    links = f"(SELECT source_url, target_url FROM ({markup.links_sql(DUCK)}) AS l WHERE is_internal)"
    return f"""SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source_url AS node, 0 AS i, 1 AS o FROM {links}
        UNION ALL SELECT target_url, 1, 0 FROM {links} UNION ALL SELECT url, 0, 0 FROM pages) GROUP BY node"""


@query("site_link_degrees", _links_oracle)
def site_link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """build_graph over the pages and the links that they have."""
    views(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url", F.col("url").alias("final_url"), none.alias("canonical_url"), F.lit(200).alias("status_code"), F.lit(0).alias("crawl_depth"))
    nodes, edges = g.build_graph(pages, spark.sql(markup.links_sql(SPARK)))
    return g.degrees(nodes.select(F.col("url").alias("node")), edges)


def _duplicates_oracle() -> str:
    found = lambda key, code, where: f"SELECT url, '{code}' AS code, first_value(url) OVER w AS related, seq, first_value(seq) OVER w AS first_seq FROM f WHERE {where} WINDOW w AS (PARTITION BY {key} ORDER BY seq)"
    parts = [
        found("title", "WARN_GRAPH_DUPLICATE_TITLES", "title IS NOT NULL"),
        found("meta_description", "WARN_GRAPH_DUPLICATE_META_DESCS", "meta_description IS NOT NULL"),
        found("html", "WARN_GRAPH_EXACT_DUPLICATE_CONTENT", f"word_count >= {gr.MIN_WORDS}"),
    ]
    features = f"SELECT f.page_id AS seq, f.url, title, meta_description, word_count, p.html FROM ({markup.features_sql(DUCK)}) AS f JOIN pages AS p ON f.page_id = p.page_id"
    return f"WITH f AS ({features}) SELECT url, code, related FROM ({' UNION ALL '.join(f'({x})' for x in parts)}) WHERE seq <> first_seq"


@query("duplicate_rules", _duplicates_oracle)
def duplicate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over titles, descriptions and equal content; near-duplicates have dup_content_near."""
    views(spark, sf_dir, "pages")
    features = spark.sql(markup.features_sql(SPARK)).select(F.col("page_id").alias("seq"), "url", "title", "meta_description", "word_count")
    html = load(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.expr(SPARK.hash("html")).alias("content_hash"))
    return gr.duplicate_rules(features.join(html, "seq").withColumn("simhash", F.lit(0).cast("long"))).select("url", "code", "related")


@sql_query("aimd_window", "events")
def aimd_window(d):
    """Per user, over the last 50 events: error rate and the 95th percentile (nearest rank) of the value."""
    w = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
    values = f"array_sort(collect_list(value) {w})" if d is not DUCK else f"list_sort(list(value) {w})"
    at = "element_at(vs, CAST(ceil(0.95D * n) AS INT))" if d is not DUCK else "vs[CAST(ceil(0.95 * n) AS INT)]"
    return f"SELECT event_id, round(errors / CAST(n AS DOUBLE), 6) AS error_rate, {at} AS p95 FROM (SELECT event_id, count(*) {w} AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) {w} AS errors, {values} AS vs FROM events WHERE value IS NOT NULL) AS x"


@query(
    "event_tumbling",
    lambda: "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query(
    "event_session",
    lambda: """SELECT user_id, session_start, session_end, n FROM (SELECT user_id, s, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM
        (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
        (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events) AS a) AS b GROUP BY user_id, s) AS c""",
)
def event_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.session_window("ts", "30 minutes")
    return load(spark, sf_dir, "events").groupBy("user_id", s.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
