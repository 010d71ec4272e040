"""Graph rules: findings that need more than one page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as ux
from ..functions.dialect import SPARK
from . import duplicates as dup
from . import graph as g

MIN_WORDS = 50
#: Alternates that a task of their joins gets on average at most.
TASK_TAGS = 250_000


def _found(df: DataFrame, url: str, code: str, related=None) -> DataFrame:
    return df.select(F.col(url).cast("string").alias("url"), F.lit(code).alias("code"), (F.lit(None).cast("string") if related is None else related.cast("string")).alias("related"))


def orphans(pages: DataFrame, sitemap: DataFrame, edges: DataFrame, exhaustive: bool) -> DataFrame:
    """Sitemap URLs to which no hyperlink leads. Crawled ones but for the start; others only if all was crawled."""
    content = sitemap.filter(~F.expr(f"({ux.is_asset(SPARK, 'url')} OR lower(url) RLIKE '[.]xml([.]gz)?($|[?])|/sitemap')")).select("url").distinct()
    linked = edges.filter("edge_type = 'hyperlink'").select(F.col("dst").alias("url")).distinct()
    loose = content.join(linked, "url", "left_anti").join(pages.select("url", "crawl_depth"), "url", "left")
    return _found(loose.filter(f"crawl_depth > 0 OR (crawl_depth IS NULL AND {str(bool(exhaustive)).lower()})"), "url", "ALERT_GRAPH_ORPHAN_PAGE")


def hreflang_rules(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """Alternates against their crawled targets: status, canonical, and whether they point back.
    tags(page_url, lang_code, target_url); pages(url, status_code, canonical_url)."""
    # Both joins sort their rows: the more tags, the more tasks, so that what a task holds stays as it is.
    n = max(int(tags.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tags.count() // TASK_TAGS))
    target = pages.select(F.col("url").alias("target_url"), F.col("status_code").alias("t_status"), F.col("canonical_url").alias("t_canonical")).repartition(n, "target_url")
    dealt = lambda df: df.repartition(n, "target_url")
    met = dealt(tags).join(target, "target_url")
    back = tags.select(F.col("page_url").alias("target_url"), F.col("target_url").alias("page_url")).repartition(n, "target_url", "page_url")
    lone = tags.repartition(n, "target_url", "page_url").join(back, ["target_url", "page_url"], "left_anti")
    return (
        _found(met.filter("t_status >= 300"), "page_url", "ERR_HREFLANG_TO_BROKEN_OR_REDIRECT", F.col("target_url"))
        .unionByName(_found(met.filter("t_canonical <> target_url"), "page_url", "ERR_HREFLANG_TO_NON_CANONICAL", F.col("target_url")))
        .unionByName(_found(dealt(lone).join(target, "target_url"), "page_url", "ERR_HREFLANG_NOT_RECIPROCAL", F.col("target_url")))
    )


def architecture(pages: DataFrame, degrees: DataFrame, ranks: DataFrame) -> DataFrame:
    """Dead ends, deep pages and hubs that little leads to."""
    met = pages.select("url", "crawl_depth").join(degrees.withColumnRenamed("node", "url"), "url", "left").join(ranks.withColumnRenamed("node", "url"), "url", "left").fillna(0)
    code = F.array(
        F.when(F.expr("in_degree > 0 AND out_degree = 0"), F.lit("WARN_GRAPH_DEAD_END_PAGE")),
        F.when(F.expr("crawl_depth > 4"), F.lit("WARN_GRAPH_HIGH_CRAWL_DEPTH")),
        F.when(F.expr("out_degree >= 50 AND (rank < 0.0001 OR in_degree <= 1)"), F.lit("WARN_LOW_INTERNAL_PAGERANK_HUB")),
    )
    return met.select("url", F.explode(F.filter(code, lambda c: c.isNotNull())).alias("code"), F.lit(None).cast("string").alias("related"))


def _blank(column: str):
    """A text without white space around it; null if nothing is left."""
    return F.expr(f"nullif(regexp_replace({column}, r'^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', ''), '')")


def duplicate_keys(pages: DataFrame) -> DataFrame:
    """url, code, key: what a page must not share with another, and the code of the finding if it does."""
    keys = {"WARN_GRAPH_EXACT_DUPLICATE_CONTENT": F.when(F.expr(f"word_count >= {MIN_WORDS} AND content_hash <> 0"), F.col("content_hash").cast("string")), "WARN_GRAPH_DUPLICATE_TITLES": _blank("title"), "WARN_GRAPH_DUPLICATE_META_DESCS": _blank("meta_description")}
    each = F.array(*[F.struct(F.lit(code).alias("code"), key.alias("key")) for code, key in keys.items()])
    return pages.select("url", F.explode(F.filter(each, lambda x: x["key"].isNotNull())).alias("x")).select("url", "x.*")


def duplicate_rules(pages: DataFrame, distance: int = dup.DISTANCE) -> DataFrame:
    """Same content, near content, same title, same description; the first page by seq is the primary.
    pages(seq, url, title, meta_description, word_count, content_hash, simhash)."""
    urls = pages.select(F.col("seq"), "url")
    named = lambda found, code: _found(found.join(urls, "seq").join(urls.select(F.col("seq").alias("primary"), F.col("url").alias("first_url")), "primary"), "url", code, F.col("first_url"))
    body = pages.filter(f"word_count >= {MIN_WORDS}")
    out = named(dup.duplicates(body.filter("content_hash <> 0"), "content_hash", "seq"), "WARN_GRAPH_EXACT_DUPLICATE_CONTENT")
    out = out.unionByName(named(dup.duplicates(pages.withColumn("k", _blank("title")), "k", "seq"), "WARN_GRAPH_DUPLICATE_TITLES"))
    out = out.unionByName(named(dup.duplicates(pages.withColumn("k", _blank("meta_description")), "k", "seq"), "WARN_GRAPH_DUPLICATE_META_DESCS"))
    # Exact duplicates are told already: only first pages of a content hash are compared.
    firsts = body.filter("simhash <> 0").groupBy("content_hash").agg(F.min(F.struct("seq", "simhash")).alias("f")).select("f.*")
    classes = dup.first_of_class(firsts, "seq")
    pairs = dup.near_pairs(firsts, distance)
    a, b = (classes.select(F.col("simhash").alias(x), F.col("first_id").alias(f"id_{x}")) for x in ("a", "b"))
    near = pairs.join(a, "a").join(b, "b").select(F.greatest("id_a", "id_b").alias("seq"), F.least("id_a", "id_b").alias("primary"))
    same = firsts.join(classes.filter("rows > 1"), "simhash").filter("seq <> first_id").select("seq", F.col("first_id").alias("primary"))
    return out.unionByName(named(near.unionByName(same), "WARN_GRAPH_NEAR_DUPLICATE_CONTENT"))


def graph_rules(pages: DataFrame, links: DataFrame, tags: DataFrame, sitemap: DataFrame, exhaustive: bool = True) -> DataFrame:
    """url, code, related: every graph finding of a crawl."""
    nodes, edges = g.build_graph(pages, links, sitemap)
    names = nodes.select(F.col("url").alias("node"))
    paths = g.redirect_paths(edges)
    loops = g.redirect_loops(paths).select(F.expr("cycle[0]").alias("url"), F.array_join("cycle", " -> ").alias("r"))
    chains = g.redirect_chains(paths, edges).select(F.col("start").alias("url"), F.array_join("path", " -> ").alias("r"))
    return (
        orphans(pages, sitemap, edges, exhaustive)
        .unionByName(_found(loops, "url", "ERR_GRAPH_REDIRECT_LOOP", F.col("r")))
        .unionByName(_found(chains, "url", "WARN_GRAPH_REDIRECT_CHAIN", F.col("r")))
        .unionByName(_found(g.canonical_loops(edges), "a", "ERR_GRAPH_CANONICAL_LOOP", F.col("b")))
        .unionByName(duplicate_rules(pages))
        .unionByName(architecture(pages, g.degrees(names, edges), g.pagerank(names, edges, part=lambda node: ux.column(ux.host, node))))
        .unionByName(hreflang_rules(pages, tags))
    )
