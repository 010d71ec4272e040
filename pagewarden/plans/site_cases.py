"""Queries in which every rule fires: made-up sites, one for each row of `pages`, and what must be found on them.

The driver's pages meet few rules. Here each page_id picks a case (page_id modulo their number): a good page
with one thing changed. Cases go through the parser, the features and the rules of the audit. What is
expected is written down by hand for each case, so the oracles share no expression with the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph_rules as gr
from ..operators import page_rules as pr
from ..operators.catalog import values_sql
from ..sources import fetches as fe
from ..sources import html
from ..sources import robots as rb
from .registry import load, query

URL = "https://site.example/pages/note-{id}"
HEADERS = ("Strict-Transport-Security", "content-security-policy", "X-Frame-Options", "x-content-type-options", "referrer-policy")
PROSE = "soil and seed make the garden grow in season "
GOOD = {
    "url": URL, "status": 200, "size": 9000, "ttfb": 100, "cut": False, "without": "", "lang": ' lang="en"', "title": "<title>A sample page about gardens, number {id}</title>",
    "description": '<meta name="description" content="This sample page tells in some detail how gardens are laid out, planted and kept, number {id}.">',
    "viewport": '<meta name="viewport" content="width=device-width, initial-scale=1">', "canonical": '<link rel="canonical" href="{url}">', "head": "", "h1": "<h1>Notes on garden {id}</h1>",
    "body": f"<p>{PROSE * 25}</p>", "links": '<p><a href="/pages/tools">Garden tools</a></p>', "more": "", "raw": "",
}
_ALT = '<link rel="alternate" hreflang="{}" href="{}">'
_SELF, _DEFAULT = _ALT.format("en", "{url}"), _ALT.format("x-default", "{url}")
_LD = '<script type="application/ld+json">{}</script>'
_PRODUCT = '{"@type":"Product","name":"Spade"%s}'
_OFFER = ',"offers":{"price":"9","availability":"InStock"}'
_IMG = '<img src="/i.png" alt="a spade" width="9" height="9">'
_OG = '<meta property="og:type" content="{}">'
#: What differs from GOOD, and (code, detail) of every finding.
CASES: list[tuple[dict, list[tuple[str, str | None]]]] = [
    ({}, []),
    ({"status": 404}, [("ERR_HTTP_4XX_CLIENT_ERROR", "status 404")]),
    ({"status": 500}, [("ERR_HTTP_5XX_SERVER_ERROR", "status 500")]),
    ({"status": 301}, [("INFO_HTTP_301_PERMANENT_REDIRECT", "status 301")]),
    ({"status": 302}, [("INFO_HTTP_302_TEMPORARY_REDIRECT", "status 302")]),
    ({"status": 308}, [("INFO_HTTP_307_308_REDIRECT", "status 308")]),
    ({"more": "<p>geo.captcha-delivery.com</p>"}, [("ALERT_WAF_BOT_CHALLENGE", "challenge of DataDome")]),
    ({"ttfb": 1801}, [("WARN_SLOW_TTFB", "1801 ms, over 1800")]),
    ({"ttfb": 1800, "size": 1_500_000, "h1": "<h1>" + "h" * 70 + "</h1>"}, []),
    ({"url": URL + "?brand=x&color=red&size=4"}, [("ALERT_FACETED_SPIDER_TRAP", "3 facets in the address, over 2")]),
    ({"title": "<title>Error 404 on this garden site, number {id}</title>", "body": "<p>short words here</p>"}, [("ERR_HTTP_SOFT_404", "status 200 with 9 words that say not found"), ("WARN_CONTENT_THIN", "9 words, under 200")]),
    ({"cut": True}, [("ERR_PERF_EXCESSIVE_HTML_PAYLOAD", "the body was cut off")]),
    ({"size": 3_000_001}, [("ERR_PERF_EXCESSIVE_HTML_PAYLOAD", "3000001 bytes, over 3000000")]),
    ({"size": 3_000_000}, [("WARN_PERF_LARGE_HTML_PAYLOAD", "3000000 bytes, over 1500000")]),
    ({"title": ""}, [("ERR_TITLE_MISSING", None)]),
    ({"raw": "title"}, [("WARN_TITLE_WHITESPACE_PADDED", None)]),
    ({"title": "<title>Twenty nine characters, just.</title>"}, [("WARN_TITLE_TOO_SHORT", "29 characters, under 30")]),
    ({"title": "<title>Sixty-one characters, one too many for the title of the page.</title>"}, [("WARN_TITLE_TOO_LONG", "61 characters, over 60")]),
    ({"title": "<title>A sample page on </title><title>gardens, number {id}</title>"}, [("ERR_TITLE_MULTIPLE", "2 titles")]),
    ({"h1": "<h1>a Sample page about gardens, number {id}</h1>"}, [("WARN_TITLE_SAME_AS_H1", None)]),
    ({"head": '<meta name="keywords" content="spade, rake">'}, [("WARN_META_KEYWORDS_PRESENT", "spade, rake")]),
    ({"description": ""}, [("WARN_META_DESC_MISSING", None)]),
    ({"description": '<meta name="description" content="' + "d" * 69 + '">'}, [("WARN_META_DESC_TOO_SHORT", "69 characters, under 70")]),
    ({"description": '<meta name="description" content="' + "d" * 161 + '">'}, [("WARN_META_DESC_TOO_LONG", "161 characters, over 160")]),
    ({"head": '<meta name="description" content="' + "d" * 100 + '">'}, [("ERR_META_DESC_MULTIPLE", "2 descriptions")]),
    ({"h1": ""}, [("ERR_H1_MISSING", None)]),
    ({"more": "<h1>Another</h1>"}, [("WARN_H1_MULTIPLE", "2 h1 headings")]),
    ({"raw": "h1"}, [("WARN_H1_EMPTY", None)]),
    ({"h1": "<h1>" + "h" * 71 + "</h1>"}, [("WARN_H1_TOO_LONG", "71 characters, over 70")]),
    ({"more": "<h3>Third</h3><h3>level</h3>"}, [("WARN_HEADING_HIERARCHY_SKIPPED", "2 h3 without h2")]),
    ({"more": "<h2>Same</h2><h2>same</h2>"}, [("WARN_DUPLICATE_HEADING_TEXT", None)]),
    # html, head, title, 3 metas or links, body, h1, p, p and a are the other 11 elements
    ({"more": "<i></i>" * 1490}, [("WARN_EXCESSIVE_DOM_DEPTH", "1501 elements, over 1500")]),
    ({"canonical": ""}, [("WARN_CANONICAL_MISSING", None)]),
    ({"canonical": '<link rel="canonical" href="/pages/note-{id}">'}, [("ERR_CANONICAL_RELATIVE", "canonical is " + URL)]),
    ({"head": '<link rel="canonical" href="{url}">'}, [("ERR_CANONICAL_MULTIPLE", "2 canonicals")]),
    ({"canonical": '<link rel="canonical" href="https://site.example/other">'}, [("ALERT_CANONICAL_MISMATCH", "canonical is https://site.example/other")]),
    ({"canonical": '<link rel="canonical" href="https://else.example/x">'}, [("ALERT_CANONICAL_MISMATCH", "canonical is https://else.example/x"), ("ALERT_CANONICAL_CROSS_DOMAIN", "canonical on else.example")]),
    ({"canonical": '<link rel="canonical" href="http://site.example/a">'}, [("ALERT_CANONICAL_MISMATCH", "canonical is http://site.example/a"), ("WARN_CANONICAL_TO_UNVERIFIED_HTTP", "canonical is http://site.example/a")]),
    ({"head": '<meta name="robots" content="noindex">'}, [("ALERT_INDEXING_BLOCKED_NOINDEX", None)]),
    ({"head": '<meta name="robots" content="nofollow">'}, [("WARN_LINK_EQUITY_BLOCKED_NOFOLLOW", None)]),
    ({"head": '<meta name="robots" content="noarchive">'}, [("WARN_NOARCHIVE_PRESENT", None)]),
    ({"head": '<meta name="robots" content="nosnippet">'}, [("WARN_NOSNIPPET_PRESENT", None)]),
    ({"url": URL + "?page=2", "canonical": ""}, [("WARN_PAGINATION_MISSING_CANONICAL", None), ("WARN_CANONICAL_MISSING", None)]),
    ({"url": URL + "?page=2", "head": '<meta name="robots" content="noindex">'}, [("ALERT_PAGINATION_NOINDEX", None), ("ALERT_INDEXING_BLOCKED_NOINDEX", None)]),
    ({"body": '<div id="root"></div>', "links": ""}, [("ALERT_UNRENDERED_SPA_HEURISTIC", None), ("WARN_CONTENT_THIN", "4 words, under 200")]),
    ({"url": "http://site.example/pages/plain-{id}"}, [("ERR_SECURITY_INSECURE_HTTP", None)]),
    ({"without": "Strict-Transport-Security"}, [("WARN_SECURITY_MISSING_HSTS", None)]),
    ({"without": "content-security-policy"}, [("WARN_SECURITY_MISSING_CSP", None)]),
    ({"without": "X-Frame-Options"}, [("WARN_SECURITY_MISSING_X_FRAME_OPTIONS", None)]),
    ({"without": "x-content-type-options"}, [("WARN_SECURITY_MISSING_X_CONTENT_TYPE", None)]),
    ({"without": "referrer-policy"}, [("WARN_SECURITY_MISSING_REFERRER_POLICY", None)]),
    ({"more": '<img src="http://site.example/i.png" alt="a rake" width="9" height="9">'}, [("ERR_SECURITY_MIXED_CONTENT", None)]),
    ({"more": '<form action="http://site.example/f"></form>'}, [("ERR_SECURITY_MIXED_CONTENT", None), ("WARN_SECURITY_INSECURE_FORM", None)]),
    ({"more": '<a href="/b" target="_blank">Tools</a><a href="/c" target="_blank" rel="noopener">Seeds</a>'}, [("WARN_SECURITY_TARGET_BLANK_NO_OPENER", "1 links")]),
    ({"more": '<img src="/i.png" width="9" height="9"><img src="/i.png" alt=" " width="9" height="9">' + _IMG}, [("WARN_IMAGE_MISSING_ALT", "2 images")]),
    ({"more": '<img src="/i.png" alt="a rake" width="9">' + _IMG}, [("WARN_IMAGE_MISSING_DIMENSIONS", "1 images")]),
    ({"raw": "images"}, [("WARN_IMAGE_DATA_URI", "1 images")]),
    ({"more": f'<img src="/i.png" alt="{"a" * 126}" width="9" height="9">' + _IMG}, [("WARN_IMG_ALT_TOO_LONG", "1 images")]),
    ({"viewport": ""}, [("ERR_MOBILE_NO_VIEWPORT", None)]),
    ({"viewport": '<meta name="viewport" content="width=device-width, user-scalable=no">'}, [("WARN_MOBILE_VIEWPORT_NON_SCALABLE", "width=device-width, user-scalable=no")]),
    ({"more": '<a href="/t">Tools</a>' * 249}, []),
    ({"more": '<a href="/t">Tools</a>' * 250}, [("WARN_LINKS_TOO_MANY_ON_PAGE", "251 links, over 250")]),
    ({"more": '<a href="/t"></a><a href="/t">' + _IMG + "</a>"}, [("WARN_LINK_EMPTY_ANCHOR", "1 links")]),
    ({"more": '<a href="/t">Click here</a><a href="/u">read more</a>'}, [("WARN_LINK_SUSPICIOUS_ANCHOR", "2 links")]),
    ({"head": _LD.format("{broken")}, [("ERR_SCHEMA_SYNTAX_ERROR", None)]),
    ({"raw": "schema"}, [("WARN_SCHEMA_MISSING_REQUIRED_FIELDS", None)] * 2),
    ({"head": _LD.format('{"@type":"Event","startDate":"tomorrow","endDate":"2024-05-01"}')}, [("WARN_SCHEMA_INVALID_DATE_FORMAT", None)]),
    ({"head": _LD.format(_PRODUCT % _OFFER) * 2}, [("WARN_SCHEMA_MULTIPLE_PRODUCT_ENTITIES", "2 products")]),
    ({"url": "https://site.example/products/{id}", "head": _OG.format("product")}, [("ERR_PRODUCT_MISSING_SCHEMA", None)]),
    ({"url": "https://site.example/products/{id}", "head": _OG.format("product") + _LD.format(_PRODUCT % "")}, [("WARN_PRODUCT_MISSING_PRICE_OFFER", None), ("WARN_PRODUCT_MISSING_AVAILABILITY", None)]),
    ({"url": "https://site.example/products/{id}", "head": _OG.format("product") + _LD.format(_PRODUCT % _OFFER)}, []),
    ({"url": "https://site.example/blog/{id}", "head": _OG.format("article")}, [("ERR_ARTICLE_MISSING_SCHEMA", None)]),
    ({"url": "https://site.example/blog/{id}", "head": _OG.format("article") + _LD.format('{"@type":"Article"}')}, [("WARN_ARTICLE_MISSING_AUTHOR", None), ("WARN_ARTICLE_MISSING_DATE_PUBLISHED", None)]),
    ({"url": "https://site.example/contact/{id}"}, [("WARN_ORG_MISSING_LOCAL_SCHEMA", None)]),
    ({"body": f"<p>{PROSE * 21}</p>", "h1": "<h1>Eight words are in the heading of this</h1>"}, [("WARN_CONTENT_THIN", "199 words, under 200")]),
    ({"more": "<p>Lorem ipsum dolor</p>"}, [("WARN_LOREM_IPSUM_DETECTED", None)]),
    ({"lang": ""}, [("WARN_HTML_LANG_MISSING", None)]),
    ({"head": _SELF + _DEFAULT + _ALT.format("en-uk", "https://site.example/uk")}, [("ERR_HREFLANG_INVALID_LANG_CODE", None)]),
    ({"head": _SELF + _DEFAULT + _ALT.format("de", "https://anderswo.example/x")}, [("WARN_HREFLANG_CROSS_DOMAIN", None)]),
    ({"head": _DEFAULT.replace("{url}", "https://site.example/d")}, [("ERR_HREFLANG_MISSING_SELF_REFERENCE", "1 alternates")]),
    ({"head": _SELF}, [("WARN_HREFLANG_MISSING_X_DEFAULT", "1 alternates")]),
]


def _page(case: dict) -> tuple:
    c = GOOD | case
    body = f"<!doctype html><html{c['lang']}><head>{c['title']}{c['description']}{c['viewport']}{c['canonical']}{c['head']}</head><body>{c['h1']}{c['body']}{c['links']}{c['more']}</body></html>"
    return c["url"], body.replace("{url}", c["url"]), c["status"], c["size"], c["ttfb"], c["cut"], {h: "x" for h in HEADERS if h != c["without"]}, c["raw"]


def _case(pages: DataFrame, n: int):
    return F.pmod(F.col("page_id"), F.lit(n)).cast("int").alias("case")


def case_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, raw and the columns of a fetch, one row for each row of pages. The cases are broadcast: under a hundred."""
    made = spark.createDataFrame([(i, *_page(c)) for i, (c, _) in enumerate(CASES)], "case int, url string, body string, status_code int, size_bytes long, ttfb_ms int, is_truncated boolean, headers map<string,string>, raw string")
    pages = load(spark, sf_dir, "pages")
    met = pages.select("page_id", _case(pages, len(CASES))).join(F.broadcast(made), "case")
    filled = {c: F.replace(c, F.lit("{id}"), F.col("page_id").cast("string")) for c in ("url", "body")}
    return met.withColumns(filled).withColumns({"final_url": F.col("url"), "content_type": F.lit("text/html"), "redirect_chain": F.array().cast("array<string>"), "crawl_depth": F.lit(0)})


def _expected() -> str:
    """page_id, code, detail, url by hand-written cases."""
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, '{code}', {text(detail)}, {text((GOOD | c)['url'])})" for i, (c, found) in enumerate(CASES) for code, detail in found)
    return f"""SELECT page_id, e.code, replace(e.detail, '{{id}}', CAST(page_id AS VARCHAR)) AS detail, replace(e.url, '{{id}}', CAST(page_id AS VARCHAR)) AS url
        FROM pages JOIN (VALUES {rows}) AS e(n, code, detail, url) ON page_id % {len(CASES)} = e.n"""


@query(
    "case_page_issues",
    lambda: f"""SELECT page_id, x.code, r.category, r.severity, concat_ws(': ', r.title, x.detail) AS message, x.url AS source_page_url
        FROM ({_expected()}) AS x JOIN (SELECT * FROM {values_sql()}) AS r ON x.code = r.code""",
)
def case_page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page rule: parser, features, rules, messages. Four rules can't be reached through the parser, so
    their cases change the features behind it."""
    features = html.features_of(html.parse_pages(fe.prepared(case_pages(spark, sf_dir))))
    raw = lambda kind, column, value: F.when(F.col("raw") == kind, value).otherwise(F.col(column))
    features = features.withColumns({
        "title": raw("title", "title", F.concat(F.lit(" "), "title")), "h1_primary": raw("h1", "h1_primary", F.lit(" ")),
        "n_images_data_uri": raw("images", "n_images_data_uri", F.lit(1)), "n_schema_incomplete": raw("schema", "n_schema_incomplete", F.lit(2)),
    })
    return pr.issues(features, "page_id").select("page_id", "code", "category", "severity", "message", "source_page_url")


@query("case_rule_counts", lambda: f"SELECT code, count(*) AS findings, count(DISTINCT page_id) AS pages FROM ({_expected()}) AS x GROUP BY code")
def case_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and pages of each page rule over the cases."""
    return case_page_issues(spark, sf_dir).groupBy("code").agg(F.count("*").alias("findings"), F.countDistinct("page_id").alias("pages"))


# Graph rules: each row of pages becomes a little site of its own.

#: Pages of a site: name, depth, status, redirect target, canonical, title, description, content hash, simhash bits that differ from the site's.
SITE = [
    ("home", 0, 200, None, None, "t home", "d home", 1, None), ("a", 1, 200, None, None, "same title", "d a", 2, None), ("b", 2, 200, None, None, "same title", "same text", 3, None),
    ("c", 2, 200, None, None, "t c", "same text", 4, None), ("dead", 5, 200, None, None, "t dead", "d dead", 5, None), ("hub", 1, 200, None, None, "t hub", "d hub", 6, None),
    ("copy1", 2, 200, None, None, "t copy1", "d copy1", 7, 0), ("copy2", 2, 200, None, None, "t copy2", "d copy2", 7, 0), ("near", 2, 200, None, None, "t near", "d near", 8, 7),
    ("far", 2, 200, None, None, "t far", "d far", 9, 127),
    ("r1", 2, 301, "r2", None, "t r1", "d r1", 10, None), ("r2", 2, 301, "r3", None, "t r2", "d r2", 11, None), ("r3", 2, 200, None, None, "t r3", "d r3", 12, None),
    ("l1", 2, 302, "l2", None, "t l1", "d l1", 13, None), ("l2", 2, 302, "l1", None, "t l2", "d l2", 14, None), ("k1", 2, 200, None, "k2", "t k1", "d k1", 15, None), ("k2", 2, 200, None, "k1", "t k2", "d k2", 16, None),
    ("lone", 3, 200, None, None, "t lone", "d lone", 17, None), ("de", 2, 200, None, None, "t de", "d de", 18, None), ("fr", 2, 200, None, "c", "t fr", "d fr", 19, None),
]
LINKS = [("home", n) for n, *_ in SITE if n not in ("home", "lone", "dead")] + [(n, "home") for n, *_ in SITE if n not in ("home", "dead", "hub")] + [("a", "dead")] + [("hub", f"x{i % 10}") for i in range(60)] + [(f"x{i}", "home") for i in range(10)]
ALTERNATES = [("home", "de", "de"), ("de", "en", "home"), ("home", "fr", "fr"), ("fr", "en", "home"), ("home", "es", "r1"), ("home", "it", "a")]
MAP = ["home", "a", "lone", "never", "lone.pdf"]
GRAPH_EXPECTED = [
    ("lone", "ALERT_GRAPH_ORPHAN_PAGE", None), ("never", "ALERT_GRAPH_ORPHAN_PAGE", None), ("l1", "ERR_GRAPH_REDIRECT_LOOP", "l1 -> l2 -> l1"), ("r1", "WARN_GRAPH_REDIRECT_CHAIN", "r1 -> r2 -> r3"),
    ("k1", "ERR_GRAPH_CANONICAL_LOOP", "k2"), ("copy2", "WARN_GRAPH_EXACT_DUPLICATE_CONTENT", "copy1"), ("near", "WARN_GRAPH_NEAR_DUPLICATE_CONTENT", "copy1"),
    ("b", "WARN_GRAPH_DUPLICATE_TITLES", "a"), ("c", "WARN_GRAPH_DUPLICATE_META_DESCS", "b"), ("dead", "WARN_GRAPH_DEAD_END_PAGE", None), ("dead", "WARN_GRAPH_HIGH_CRAWL_DEPTH", None),
    ("home", "ERR_HREFLANG_TO_BROKEN_OR_REDIRECT", "r1"), ("home", "ERR_HREFLANG_TO_NON_CANONICAL", "fr"), ("home", "ERR_HREFLANG_NOT_RECIPROCAL", "r1"), ("home", "ERR_HREFLANG_NOT_RECIPROCAL", "a"),
    ("hub", "WARN_LOW_INTERNAL_PAGERANK_HUB", None),
]


def _graph_oracle() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    rows = ", ".join(f"('{a}', '{code}', {text(b)})" for a, code, b in GRAPH_EXPECTED)
    return f"""SELECT page_id, name, code, related FROM pages CROSS JOIN (VALUES {rows}) AS e(name, code, related)"""


@query("case_graph_issues", _graph_oracle)
def case_graph_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every graph rule at once over as many little sites as there are pages. Each site's names and texts carry its page_id."""
    ids = load(spark, sf_dir, "pages").select("page_id")
    of = lambda rows, schema: ids.crossJoin(F.broadcast(spark.createDataFrame(rows, schema)))  # noqa: E731  a few dozen rows
    full = lambda c: F.concat(F.lit("https://s"), "page_id", F.lit(".example/"), c)
    pages = of(SITE, "name string, crawl_depth int, status_code int, goes string, canon string, title string, text string, body int, bits long")
    known = F.conv(F.substring(F.md5(F.concat(F.col("page_id").cast("string"), F.lit("/"), F.coalesce(F.col("bits") * 0, F.col("body")).cast("string"))), 1, 15), 16, 10).cast("long")
    pages = pages.select(
        full("name").alias("url"), full("name").alias("seq"), full(F.coalesce("goes", "name")).alias("final_url"), full(F.coalesce("canon", "name")).alias("canonical_url"), "status_code", "crawl_depth",
        F.concat("title", F.lit(" "), "page_id").alias("title"), F.concat("text", F.lit(" "), "page_id").alias("meta_description"), F.lit(100).alias("word_count"),
        (F.col("page_id") * 100 + F.col("body")).alias("content_hash"), known.bitwiseXOR(F.coalesce("bits", F.lit(0))).alias("simhash"),
    )
    links = of(LINKS, "a string, b string").select(full("a").alias("source_url"), full("b").alias("target_url"), F.lit(True).alias("is_internal"), F.lit(False).alias("is_nofollow"))
    tags = of(ALTERNATES, "a string, lang_code string, b string").select(full("a").alias("page_url"), "lang_code", full("b").alias("target_url"))
    found = gr.graph_rules(pages, links, tags, of([(n,) for n in MAP], "name string").select(full("name").alias("url")))
    return found.select(F.regexp_extract("url", "s([0-9]+)[.]", 1).cast("long").alias("page_id"), F.regexp_extract("url", "[^/]+$", 0).alias("name"), "code", F.regexp_replace("related", "https://s[0-9]+[.]example/", "").alias("related"))


# Rules of a site's files, and of what a browser changes.

ROBOTS = [
    (200, "User-agent: *\nAllow: /\n", 200, []), (200, "User-agent: GPTBot\nDisallow: /\n", 200, ["ALERT_AI_SEARCH_BOTS_BLOCKED"]), (404, "", 404, ["WARN_LLMS_TXT_MISSING"]),
    (503, "", 200, ["ERR_HTTP_5XX_SERVER_ERROR"]), (None, None, None, []), (200, "User-agent: *\nDisallow: /\nUser-agent: CCBot\nAllow: /\n", None, ["ALERT_AI_SEARCH_BOTS_BLOCKED", "WARN_LLMS_TXT_MISSING"]),
]


def _site_oracle() -> str:
    rows = ", ".join(f"({i}, '{code}')" for i, (*_, found) in enumerate(ROBOTS) for code in found)
    return f"SELECT concat('s', page_id, '.example') AS host, code FROM pages JOIN (VALUES {rows}) AS e(n, code) ON page_id % {len(ROBOTS)} = e.n"


@query("case_site_issues", _site_oracle)
def case_site_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of robots.txt and llms.txt."""
    made = spark.createDataFrame([(i, *row[:3]) for i, row in enumerate(ROBOTS)], "case int, robots_status int, body string, llms_status int")
    pages = load(spark, sf_dir, "pages")
    hosts = pages.select(F.concat(F.lit("s"), "page_id", F.lit(".example")).alias("host"), _case(pages, len(ROBOTS))).join(F.broadcast(made), "case")
    return rb.site_findings(rb.robots_rules(hosts.select("host", "body").filter("body IS NOT NULL")), hosts.select("host", "robots_status", "llms_status")).select("host", "code")


#: What the browser makes of a page: changed columns of the rendered one, columns of the served one, codes.
RENDERED = [
    ({}, {}, []), ({"canonical_url": "https://e.example/x"}, {}, ["ERR_JS_DIFF_CANONICAL_ALTERED"]), ({"robots_flags": 1}, {}, ["ERR_JS_DIFF_NOINDEX_INJECTED"]), ({"robots_flags": 1}, {"robots_flags": 3}, []),
    ({"final_url": "https://e.example/moved"}, {}, ["WARN_JS_DIFF_TITLE_META_DESYNC"]), ({"final_url": "https://e.example/moved", "title": "new"}, {}, []), ({"word_count": 49}, {}, ["ALERT_JS_DIFF_VANISHING_CONTENT"]),
    ({"word_count": 50}, {"word_count": 101}, []), ({"n_links": 4}, {"n_links": 0}, ["ALERT_JS_DIFF_LATE_RENDERED_LINKS"]), ({"runtime_errors": ["TypeError"], "word_count": 9}, {"word_count": 12}, ["ERR_JS_DIFF_HYDRATION_CRASH"]),
    ({"runtime_errors": ["TypeError"]}, {}, []),
]
_SHOWN = {"canonical_url": None, "robots_flags": 0, "final_url": "https://e.example/", "title": "old", "meta_description": "text", "word_count": 100, "n_links": 2, "runtime_errors": []}


def _rendered_oracle() -> str:
    rows = ", ".join(f"({i}, '{code}')" for i, (*_, found) in enumerate(RENDERED) for code in found)
    return f"SELECT page_id, code FROM pages JOIN (VALUES {rows}) AS e(n, code) ON page_id % {len(RENDERED)} = e.n"


@query("case_rendered_issues", _rendered_oracle)
def case_rendered_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that compares the served page with the rendered one."""
    schema = "case int, canonical_url string, robots_flags int, final_url string, title string, meta_description string, word_count int, n_links int, runtime_errors array<string>"
    pages = load(spark, sf_dir, "pages")
    named = pages.select(F.col("page_id").cast("string").alias("url"), _case(pages, len(RENDERED)))
    side = lambda k: named.join(F.broadcast(spark.createDataFrame([(i, *(_SHOWN | row[k]).values()) for i, row in enumerate(RENDERED)], schema)), "case")
    return pr.rendered_differences(side(1), side(0)).select(F.col("url").cast("long").alias("page_id"), "code")
