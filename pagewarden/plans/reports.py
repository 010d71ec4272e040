"""Exports of an audit: CSV files, JSON, Markdown, HTML."""

from __future__ import annotations

import html as entities
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import SPARK
from ..operators import page_rules as pr
from ..operators import score
from ..operators.catalog import SEVERITIES
from ..operators.graph import degrees, pagerank
from ..sources import fetches as fe
from ..sources import html as pages_of
from .audit import Audit


def _guarded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.expr(score.csv_guard(SPARK, f"`{c}`")) for c, t in df.dtypes if t == "string"})


def internal_all(a: Audit) -> DataFrame:
    """A row a page, as the main export lists it."""
    edges = a.links.filter("is_internal").select(F.col("source_url").alias("src"), F.col("target_url").alias("dst"), F.lit("hyperlink").alias("edge_type"))
    d = degrees(a.pages.select(F.col("url").alias("node")), edges).withColumnRenamed("node", "url")
    status, index = score.status_reason("status_code"), score.indexability("status_code", "robots_flags", "canonical_url", "url", SPARK)
    return a.pages.join(d, "url", "left").select(
        "url", "content_type", "status_code", F.expr(status).alias("status"), F.expr(index).alias("indexability"), "title", F.octet_length("title").alias("title_length"), "meta_description", F.octet_length("meta_description").alias("meta_description_length"),
        "h1_primary", F.length("h1_primary").alias("h1_length"), "canonical_url", "word_count", "size_bytes", "ttfb_ms", "crawl_depth", F.coalesce("in_degree", F.lit(0)).alias("inlinks"), F.coalesce("out_degree", F.lit(0)).alias("outlinks"), F.col("page_intent.archetype").alias("archetype"),
    )


def csv_suite(a: Audit, folder: str) -> None:
    """internal_all, issues_all, response_codes, external_all as CSV folders, cells guarded against formulas."""
    s = score.status_reason("status_code")
    redirect = F.when(F.col("status_code").between(300, 399), "HTTP Redirect").when(F.size("redirect_chain") > 0, "Followed Redirect").otherwise("")
    files = {
        "internal_all": internal_all(a),
        "issues_all": a.issues.select("url", "code", "category", F.element_at(F.create_map(*[F.lit(x) for k, v in SEVERITIES.items() for x in (k, v)]), F.col("severity")).alias("severity"), "title", "message", "source_page_url", "related", "phase"),
        "response_codes": a.pages.select("url", "final_url", "status_code", F.expr(s).alias("status"), redirect.alias("redirect_type"), "ttfb_ms"),
        "external_all": a.links.filter("NOT is_internal").select("source_url", "target_url", "anchor_text", "is_nofollow", "is_target_blank"),
    }
    for name, df in files.items():
        _guarded(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


def json_report(a: Audit, folder: str) -> None:
    """Pages with counts of their links instead of the links, issues and the score, as JSON lines."""
    count = lambda inner: F.size(F.filter("links", lambda x: x["is_internal"] == inner))
    a.pages.withColumns({"internal_links": count(F.lit(True)), "external_links": count(F.lit(False))}).drop("links", "body").write.mode("overwrite").json(f"{folder}/pages")
    a.issues.write.mode("overwrite").json(f"{folder}/issues")
    a.score.coalesce(1).write.mode("overwrite").json(f"{folder}/score")


def summary(a: Audit, samples: int = 20, hubs: int = 15) -> dict:
    """What the rendered reports show: counts by status and depth, rules with samples, hubs, TTFB. Bounded by
    rules, statuses, depths and the limits given."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    share = F.round(100 * F.col("count") / F.sum("count").over(Window.partitionBy()), 1)
    by_rule = a.issues.groupBy("severity", "category", "code", "title").agg(F.count("*").alias("n"))
    first = a.issues.select("code", "url").withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("url"))).filter(F.col("r") <= samples)
    edges = a.links.filter("is_internal").select(F.col("source_url").alias("src"), F.col("target_url").alias("dst"), F.lit("hyperlink").alias("edge_type"), "is_nofollow")
    nodes = a.pages.select(F.col("url").alias("node")).union(edges.select("dst")).distinct()
    ranks = a.pages.select(F.col("url").alias("node")).join(pagerank(nodes, edges), "node", "left").fillna(0.0)
    return {
        "score": a.score.first()["score"],
        "pages": a.pages.count(),
        "statuses": rows(a.pages.groupBy("status_code").count().withColumn("share", share).orderBy("status_code")),
        "depths": rows(a.pages.groupBy("crawl_depth").count().orderBy("crawl_depth")),
        "rules": rows(by_rule.orderBy("severity", F.desc("n"), "code")),
        "samples": {r["code"]: r["urls"] for r in first.groupBy("code").agg(F.array_sort(F.collect_list("url")).alias("urls")).collect()},
        "hubs": rows(ranks.orderBy(F.desc("rank"), "node").limit(hubs)),
        "ttfb": rows(score.ttfb_summary(a.pages.select("ttfb_ms"))),
    }


def markdown_report(a: Audit, samples: int = 20) -> str:
    s = summary(a, samples)
    out = ["# Site audit", "", f"Health score: **{s['score']}** of 100, {s['pages']} pages", "", "| Status | Pages | Share |", "| --- | --- | --- |"]
    out += [f"| {r['status_code']} | {r['count']} | {r['share']} % |" for r in s["statuses"]]
    for level, name in SEVERITIES.items():
        some = [r for r in s["rules"] if r["severity"] == level]
        out += ["", f"## {name.capitalize()} ({sum(r['n'] for r in some)})"] if some else []
        for r in some:
            urls = s["samples"].get(r["code"], [])
            out += ["", f"### {r['title']} (`{r['code']}`): {r['n']}", *[f"- {u}" for u in urls]]
            out += [f"- and {r['n'] - len(urls)} more"] if r["n"] > len(urls) else []
    return "\n".join([*out, "", "## Top pages by rank", "", *[f"{i}. {r['node']} ({r['rank']:.6f})" for i, r in enumerate(s["hubs"], 1)]]) + "\n"


def llm_report(a: Audit, groups: int = 10) -> str:
    """A short report for language models: the largest rule groups with three samples, and quick wins."""
    s = summary(a, 3)
    top = sorted(s["rules"], key=lambda r: (r["severity"], -r["n"]))[:groups]
    wins = [r for r in s["rules"] if r["severity"] >= 3][:5]
    lines = [f"- [{SEVERITIES[r['severity']]}] {r['code']}: {r['n']} (e.g. {', '.join(s['samples'].get(r['code'], []))})" for r in top]
    return "\n".join([f"score {s['score']}, pages {s['pages']}", "", "Issues:", *lines, "", "Quick wins:", *[f"- {r['title']}: {r['n']}" for r in wins]]) + "\n"


def html_report(a: Audit, listed: int = 500) -> str:
    """One page without scripts: score, findings by severity, statuses, depths, TTFB, rules with samples, top pages, and
    the `listed` pages with most findings."""
    s, e = summary(a), lambda x: entities.escape(str(x))
    table = lambda rows, cols: "<table><tr>" + "".join(f"<th>{c}</th>" for c in cols) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(r[c])}</td>" for c in cols) + "</tr>" for r in rows) + "</table>"
    rules = "".join(f"<details><summary>{e(SEVERITIES[r['severity']])}: {e(r['title'])} ({r['n']})</summary><ul>{''.join(f'<li>{e(u)}</li>' for u in s['samples'].get(r['code'], []))}</ul></details>" for r in s["rules"])
    levels = [{"severity": name, "findings": sum(r["n"] for r in s["rules"] if r["severity"] == k)} for k, name in SEVERITIES.items()]
    most = max(1, *(x["findings"] for x in levels))
    bars = "".join(f"<p>{e(x['severity'])} <meter max={most} value={x['findings']}></meter> {x['findings']}</p>" for x in levels)
    counts = a.issues.groupBy("url").agg(F.count("*").alias("findings"))
    pages = a.pages.select("url", "status_code", "title", "word_count", "crawl_depth").join(counts, "url", "left").fillna(0, ["findings"]).orderBy(F.desc("findings"), "url").limit(listed).collect()
    parts = {
        "Findings by severity": bars, "Statuses": table(s["statuses"], ["status_code", "count", "share"]), "Depths": table(s["depths"], ["crawl_depth", "count"]), "TTFB": table(s["ttfb"], ["average", "p95"]),
        "Rules": rules, "Top pages by rank": table(s["hubs"], ["node", "rank"]), f"Pages ({len(pages)} of {s['pages']})": table(pages, ["url", "status_code", "title", "word_count", "crawl_depth", "findings"]),
    }
    return f"<!DOCTYPE html><meta charset=utf-8><title>Site audit</title><h1>Health score {s['score']}</h1>" + "".join(f"<h2>{e(k)}</h2>{v}" for k, v in parts.items())


def json_text(a: Audit) -> str:
    return json.dumps(summary(a), default=str, ensure_ascii=False)


def scorecard(a: Audit, rules: int = 6, hubs: int = 5, width: int = 40) -> str:
    """A few lines for a terminal: the score as a bar, TTFB, findings by severity, the most frequent rules, the top pages."""
    s = summary(a, 1, hubs)
    ttfb = s["ttfb"][0] if s["ttfb"] else {"average": None, "p95": None}
    full = round(width * s["score"] / 100)
    levels = {k: sum(r["n"] for r in s["rules"] if r["severity"] == k) for k in SEVERITIES}
    out = [f"Health [{'#' * full}{'.' * (width - full)}] {s['score']}/100", f"{s['pages']} pages, TTFB average {ttfb['average']} ms, p95 {ttfb['p95']} ms", ", ".join(f"{n} {SEVERITIES[k]}" for k, n in levels.items()), "", "Most frequent findings"]
    out += [f"  {r['n']:>8}  {SEVERITIES[r['severity']]:<8}  {r['title']}" for r in sorted(s["rules"], key=lambda r: (-r["n"], r["code"]))[:rules]]
    return "\n".join([*out, "", "Top pages by rank", *[f"  {r['rank']:.6f}  {r['node']}" for r in s["hubs"]]]) + "\n"


def inspection(fetches: DataFrame, url: str) -> str:
    """What is known of one page, as text: its response, head, headings, links, structured data and findings.
    A page that isn't among the responses gives a line that says so; lists are shown by their size."""
    parsed = pages_of.parse_pages(fe.prepared(fetches.filter(F.col("url") == url)))
    page = parsed.limit(1).collect()
    if not page:
        return f"{url}: no response\n"
    row = page[0].asDict(recursive=True)
    show = lambda names: [f"  {n}: {row[n]}" for n in names if row.get(n) not in (None, "", [])]
    sections = {
        "Response": show(["status_code", "content_type", "size_bytes", "ttfb_ms", "crawl_depth"]),
        "Head": show(["title", "meta_description", "canonical_url", "html_lang", "viewport", "robots_flags"]),
        "Content": [*show(["h1_primary", "h1_count", "word_count", "dom_element_count"]), *[f"  h2: {h}" for h in row["h2_headings"][:10]], f"  intent: {row['page_intent']['archetype']}"],
        "Items": [f"  {n}: {len(row[n])}" for n in ("links", "images", "schemas", "hreflangs")],
    }
    found = pr.issues(pages_of.features_of(parsed), "url").select("severity", "code", "title").orderBy("severity", "code").collect()  # at most one a rule
    sections[f"Findings ({len(found)})"] = [f"  [{SEVERITIES[r['severity']]}] {r['code']}: {r['title']}" for r in found]
    return "\n".join([url, *[line for name, lines in sections.items() for line in ("", name, *lines)]]) + "\n"


def json_schema(t: T.DataType, top: bool = True) -> dict:
    """The JSON Schema (2020-12) of rows of a schema, as JSON lines hold them; fields that may be null may be left out."""
    if isinstance(t, T.StructType):
        out = {"type": "object", "properties": {f.name: json_schema(f.dataType, False) for f in t.fields}, "required": [f.name for f in t.fields if not f.nullable]}
    elif isinstance(t, T.ArrayType):
        out = {"type": "array", "items": json_schema(t.elementType, False)}
    elif isinstance(t, T.MapType):
        out = {"type": "object", "additionalProperties": json_schema(t.valueType, False)}
    elif isinstance(t, T.BooleanType):
        out = {"type": "boolean"}
    elif isinstance(t, T.IntegralType):
        out = {"type": "integer"}
    elif isinstance(t, T.NumericType):
        out = {"type": "number"}
    else:
        out = {"type": "string", **({"format": "date-time"} if isinstance(t, T.TimestampType) else {})}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **out} if top else out
