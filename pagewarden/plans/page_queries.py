"""Queries over pages: URLs, text, parsing, page rules, stored-data queries, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url as ux
from ..functions.dialect import DUCK, SPARK
from ..operators import page_rules as pr
from ..operators import score
from ..operators.catalog import rules_table, values_sql
from ..sources import markup
from ..staging import stage
from .registry import query, sql_query, views


@sql_query("url_normalize", "pages")
def url_normalize(d):
    return f"SELECT page_id, {ux.normalize(d, 'url')} AS normalized, {ux.scheme(d, 'url')} AS scheme, {ux.host(d, 'url')} AS host, {ux.path(d, 'url')} AS path FROM pages"


@sql_query("url_dedup", "pages")
def url_dedup(d):
    return f"SELECT normalized, min(page_id) AS page_id, count(*) AS copies FROM (SELECT page_id, {ux.normalize(d, 'url')} AS normalized FROM pages) AS n GROUP BY normalized"


@sql_query("url_facets", "pages")
def url_facets(d):
    made = "concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'color=red&size=', CAST(page_id % 5 AS STRING), CASE WHEN page_id % 3 = 0 THEN '&sort=price' ELSE '&utm_source=x' END)"
    made = made.replace("STRING", "VARCHAR") if d is DUCK else made
    return f"""SELECT page_id, CAST({ux.content_facets(d, 'u')} AS INT) AS content_facets, CAST({ux.sorting_facets(d, 'u')} AS INT) AS sorting_facets, {ux.is_asset(d, 'u')} AS is_asset,
        {ux.is_pagination_page(d, 'u')} AS is_pagination_page, {ux.is_pagination_number(d, 'u')} AS is_pagination_number, {ux.normalize(d, 'u')} AS normalized
        FROM (SELECT page_id, {d.rep(made, '#[a-z]*', '')} AS u FROM pages) AS m"""


@sql_query("url_importance", "pages")
def url_importance(d):
    return f"SELECT page_id, CAST({ux.importance(d, 'url', 'page_id % 7', 'page_id % 30', 'page_id % 11 = 0')} AS BIGINT) AS importance FROM pages"


@sql_query("word_counts", "documents")
def word_counts(d):
    return f"SELECT doc_id, CAST({tx.word_count(d, 'text')} AS BIGINT) AS words, {d.hash(tx.clean(d, 'text'))} AS content_hash FROM documents"


@sql_query("thin_content", "pages", deal=True)
def thin_content(d):
    return f"SELECT page_id, CAST(words AS INT) AS words, words < 200 AS is_thin FROM (SELECT page_id, {tx.word_count(d, tx.editorial(d, 'html'))} AS words FROM pages) AS w"


@sql_query("pages_parsed", "pages", deal=True)
def pages_parsed(d):
    kept = "page_id, url, title, title_count, h1_primary, h1_count, h2_count, h3_count, meta_description, viewport, robots_flags, canonical_url, n_links, n_empty_anchor, n_generic_anchor, word_count, html_lang, dom_element_count, size_bytes"
    ints = {"title_count", "h1_count", "h2_count", "h3_count", "robots_flags", "n_links", "n_empty_anchor", "n_generic_anchor", "word_count", "dom_element_count"}
    cols = ", ".join(f"CAST({c} AS INT) AS {c}" if c in ints else c for c in kept.split(", "))
    return f"SELECT {cols} FROM ({markup.features_sql(d)}) AS f"


@sql_query("links_extract", "pages", deal=True)
def links_extract(d):
    return markup.links_sql(d)


@sql_query("link_anchor_quality", "pages", deal=True)
def link_anchor_quality(d):
    generic = "(" + ", ".join(f"'{x}'" for x in markup.GENERIC_ANCHORS) + ")"
    return f"""SELECT page_id, count(*) AS links, count(DISTINCT target_url) AS targets, sum(CASE WHEN anchor = '' THEN 1 ELSE 0 END) AS empty_anchors,
        sum(CASE WHEN lower(anchor) IN {generic} THEN 1 ELSE 0 END) AS generic_anchors, sum(CASE WHEN is_internal THEN 1 ELSE 0 END) AS internal_links
        FROM ({markup.links_sql(d)}) AS l GROUP BY page_id"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "pages", deal=True)
    return spark.sql(markup.features_sql(SPARK))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.issues(_features(spark, sf_dir), "page_id", "url")


def _issues_duck() -> str:
    """code, page_id, url, category, severity, title for another engine."""
    return f"""SELECT i.page_id, i.url, i.code, r.category, r.severity, r.title FROM
        (SELECT page_id, url, code, unnest(range(times)) AS n FROM ({pr.findings_sql(DUCK, '(' + markup.features_sql(DUCK) + ') AS f', 'page_id, url')}) AS x) AS i
        JOIN {values_sql()} ON i.code = rules.code""".replace("r.category, r.severity, r.title", "rules.category, rules.severity, rules.title")


@query("page_rule_counts", lambda: f"SELECT code, category, severity, title, count(*) AS findings, count(DISTINCT page_id) AS pages FROM ({_issues_duck()}) AS i GROUP BY ALL")
def page_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).groupBy("code", "category", "severity", "title").agg(F.count("*").alias("findings"), F.countDistinct("page_id").alias("pages"))


@query("page_issues", lambda: f"SELECT page_id, code, category, severity FROM ({_issues_duck()}) AS i")
def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).select("page_id", "code", "category", "severity")


@query(
    "issue_filter_page",
    lambda: f"SELECT page_id, code, severity FROM ({_issues_duck()}) AS i WHERE severity <= 3 AND category = 'title_metadata' AND url ILIKE '%EXAMPLE_%' ORDER BY severity, page_id, code LIMIT 50 OFFSET 10",
)
def issue_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of findings: filters, then order, offset and limit, which are the feature."""
    hits = _issues(spark, sf_dir).filter((F.col("severity") <= 3) & (F.col("category") == "title_metadata") & F.col("url").ilike("%EXAMPLE_%"))
    return hits.orderBy("severity", "page_id", "code").offset(10).limit(50).select("page_id", "code", "severity")


@query("issue_group_by_rule", lambda: f"SELECT severity, code, title, count(*) AS n FROM ({_issues_duck()}) AS i GROUP BY ALL")
def issue_group_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).groupBy("severity", "code", "title").agg(F.count("*").alias("n")).orderBy("severity", F.desc("n"))


@query("issue_cube", lambda: f"SELECT category, severity, count(*) AS n FROM ({_issues_duck()}) AS i GROUP BY CUBE (category, severity)")
def issue_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).cube("category", "severity").agg(F.count("*").alias("n"))


@query("severity_counts", lambda: f"SELECT count_if(severity = 1) AS critical, count_if(severity = 2) AS alert, count_if(severity = 3) AS warning, count_if(severity = 4) AS notice, count_if(severity <= 2) > 0 AS fails FROM ({_issues_duck()}) AS i")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return _issues(spark, sf_dir).agg(n(1).alias("critical"), n(2).alias("alert"), n(3).alias("warning"), n(4).alias("notice"), (F.count_if(F.col("severity") <= 2) > 0).alias("fails"))


@query(
    "top_samples_per_rule",
    lambda: f"SELECT * FROM (SELECT code, page_id, row_number() OVER (PARTITION BY code ORDER BY page_id) AS place, count(*) OVER (PARTITION BY code) AS found FROM ({_issues_duck()}) AS i) AS r WHERE place <= 20",
)
def top_samples_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 pages of each rule, and how many it has. A rule may fire on every page, so the
    limit runs before the exchange and counts are partial first; both read the findings from where they were written."""
    found = stage(_issues(spark, sf_dir).select("code", "page_id"), "found")
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("page_id"))).filter("place <= 20")
    return first.join(F.broadcast(found.groupBy("code").agg(F.count("*").alias("found"))), "code")


@query("health_score", lambda: score.health_sql(f"({_issues_duck()})", "(SELECT count(*) AS n FROM pages)"))
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _features(spark, sf_dir)
    return score.health_score(_issues(spark, sf_dir), features.agg(F.count("*").alias("n")))


@sql_query("host_status_histogram", "pages")
def host_status_histogram(d):
    return f"SELECT {ux.host(d, 'url')} AS host, {markup.ENVELOPE['status_code']} AS status_code, count(*) AS pages FROM pages GROUP BY 1, 2"


@sql_query("status_histogram", "pages")
def status_histogram(d):
    return f"SELECT status_code, count(*) AS pages, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT {markup.ENVELOPE['status_code']} AS status_code FROM pages) AS s GROUP BY status_code"


@sql_query("slowest_pages", "pages")
def slowest_pages(d):
    return f"SELECT page_id, {markup.ENVELOPE['ttfb_ms']} AS ttfb_ms FROM pages ORDER BY ttfb_ms DESC, page_id LIMIT 20"


@query(
    "ttfb_summary",
    lambda: f"SELECT CAST(sum(t) // count(*) AS BIGINT) AS average, CAST(list_sort(list(t))[least(count(*) - 1, CAST(round(count(*) * 0.95) AS BIGINT)) + 1] AS BIGINT) AS p95 FROM (SELECT {markup.ENVELOPE['ttfb_ms']} AS t FROM pages) AS x",
)
def ttfb_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.ttfb_summary(_features(spark, sf_dir).select("ttfb_ms"))


@sql_query("missing_title_or_description", "pages", deal=True)
def missing_title_or_description(d):
    return f"SELECT page_id, url, title IS NULL AS no_title, meta_description IS NULL AS no_description FROM ({markup.features_sql(d)}) AS f WHERE title IS NULL OR meta_description IS NULL"


@sql_query("csv_internal_all", "pages", deal=True)
def csv_internal_all(d):
    indexable = score.indexability("status_code", "robots_flags", "canonical_url", "url", d)
    guard = score.csv_guard(d, "title")
    return f"""SELECT page_id, url, status_code, {score.status_reason('status_code')} AS status, {indexable} AS indexability, {guard} AS title, CAST(length(title) AS INT) AS title_chars,
        h1_primary, CAST(length(h1_primary) AS INT) AS h1_chars, CAST(word_count AS INT) AS word_count, size_bytes, crawl_depth, ttfb_ms, CAST(n_links AS INT) AS n_links FROM ({markup.features_sql(d)}) AS f"""


@query("csv_external_all", lambda: f"""SELECT {ux.normalize(DUCK, 'url')} AS source_url, concat('https://out.example/x?id=', page_id) AS target_url, 'Far away' AS anchor, page_id % 2 = 0 AS is_nofollow FROM pages""")
def csv_external_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to other hosts. The driver's pages have none, so each gets one at its end."""
    views(spark, sf_dir, "pages")
    more = """concat(html, '<a href="https://out.example/x?id=', page_id, '"', CASE WHEN page_id % 2 = 0 THEN ' rel="nofollow"' ELSE '' END, '>Far <b>away</b></a>')"""
    return spark.sql(f"SELECT source_url, target_url, anchor, is_nofollow FROM ({markup.links_sql(SPARK, f'(SELECT page_id, url, {more} AS html FROM pages)')}) AS l WHERE NOT is_internal")


@sql_query("csv_response_codes", "pages")
def csv_response_codes(d):
    s = markup.ENVELOPE["status_code"]
    return f"SELECT page_id, url, s AS status_code, {score.status_reason('s')} AS status, CASE WHEN s BETWEEN 300 AND 399 THEN 'HTTP Redirect' ELSE '' END AS redirect_type FROM (SELECT page_id, url, {s} AS s FROM pages) AS p"
