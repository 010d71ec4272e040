"""A whole audit as one lazy plan: responses to pages, children, findings, graph and score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph_rules as gr
from ..operators import page_rules as pr
from ..operators import score
from ..operators.catalog import rules_table
from ..sources import fetches as fe
from ..sources import html
from ..sources import robots as rb
from ..staging import stage


@dataclass
class Audit:
    """The tables of one audit."""

    pages: DataFrame
    links: DataFrame
    images: DataFrame
    schemas: DataFrame
    hreflangs: DataFrame
    issues: DataFrame
    score: DataFrame


def audit(fetches: DataFrame, sitemap: DataFrame, robots_files: DataFrame | None = None, site_files: DataFrame | None = None, exhaustive: bool = True) -> Audit:
    """fetches in the schema of sources.fetches; sitemap(url); robots_files(host, body); site_files(host, robots_status, llms_status).

    Pages are parsed once and staged, as findings, links and the graph all read them."""
    spark = fetches.sparkSession
    known = sitemap.select("url", F.lit(True).alias("in_sitemap")).distinct()
    parsed = html.parse_pages(fe.prepared(fetches)).join(known, "url", "left").withColumn("is_sitemap_url", F.coalesce("in_sitemap", F.lit(False))).drop("in_sitemap")
    # Where "first" matters it must not depend on timing: the first page is the one whose url sorts first.
    parsed = stage(parsed.withColumn("seq", F.col("url")), "parsed")
    kids = html.children(parsed)
    features = html.features_of(parsed)
    page_issues = pr.findings(features, "url").select("url", "code", F.lit(None).cast("string").alias("related"), F.lit("page").alias("phase"), "detail", F.col("url").alias("source_page_url"))
    pages = parsed.withColumn("final_url", F.coalesce("final_url", "url"))
    found = page_issues.unionByName(gr.graph_rules(pages, kids["links"], kids["hreflangs"], sitemap, exhaustive).withColumns({"phase": F.lit("graph"), "detail": F.col("related"), "source_page_url": F.col("url")}))
    if robots_files is not None and site_files is not None:
        site = rb.site_findings(rb.robots_rules(robots_files), site_files)
        found = found.unionByName(site.select(F.col("host").alias("url"), "code", F.lit(None).cast("string").alias("related"), F.lit("site").alias("phase"), F.concat(F.lit("host "), "host").alias("detail"), F.col("host").alias("source_page_url")))
    issues = stage(pr.described(found, rules_table(spark)), "issues")
    return Audit(parsed, kids["links"], kids["images"], kids["schemas"], kids["hreflangs"], issues, score.health_score(issues, parsed.agg(F.count("*").alias("n"))))


def inspect(fetches: DataFrame, url: str) -> DataFrame:
    """Findings of the page rules for a single page."""
    return pr.issues(html.features_of(html.parse_pages(fe.prepared(fetches.filter(F.col("url") == url)))), "url")
