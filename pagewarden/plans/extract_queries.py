"""Queries of parsing and extraction: those that SQL can say have an oracle, the rest are tested."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address
from ..functions import contacts as co
from ..functions import url as ux
from ..functions.dialect import DUCK, SPARK
from ..operators import frontier as fr
from ..operators import page_rules as pr
from ..operators import site
from ..sources import html, markup
from ..sources import jsonld_sql as jl
from ..sources import robots as rb
from .registry import load, query, sql_query


@sql_query("emails_extract", "documents")
def emails_extract(d):
    return f"SELECT doc_id, {d.join('e', ',')} AS emails FROM (SELECT doc_id, {co.emails_sql(d, 'text')} AS e FROM documents) AS x WHERE {d.size('e')} > 0"


def _fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's pages as responses, with the made-up envelope of sources.markup."""
    e = markup.ENVELOPE
    headers = "map_filter(map('strict-transport-security', CASE WHEN page_id % 2 = 0 THEN 'max-age=1' END, 'content-security-policy', CASE WHEN page_id % 3 = 0 THEN 'x' END), (k, v) -> v IS NOT NULL)"
    return load(spark, sf_dir, "pages").selectExpr("page_id", "url", "url AS final_url", f"{e['status_code']} AS status_code", f"{headers} AS headers", "'text/html' AS content_type", "html AS body", "octet_length(html) AS size_bytes", f"{e['ttfb_ms']} AS ttfb_ms", "cast(array() AS array<string>) AS redirect_chain", "false AS is_truncated", f"{e['crawl_depth']} AS crawl_depth", "cast(NULL AS string) AS waf_detected")


@query("pages_full_parse")
def pages_full_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general parser over every page."""
    parsed = html.parse_pages(_fetches(spark, sf_dir))
    return parsed.select("page_id", "url", "title", "h1_primary", "h1_count", "dom_element_count", "word_count", "content_hash", "simhash", F.size("links").alias("n_links"), F.col("page_intent.archetype").alias("archetype"), F.round("page_intent.confidence", 6).alias("confidence"))


@query("page_issues_full_parse")
def page_issues_full_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.issues(html.features_of(html.parse_pages(_fetches(spark, sf_dir))), "page_id").select("page_id", "code", "category", "severity")


@query("contacts_extract")
def contacts_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.with_contacts(load(spark, sf_dir, "documents"), "doc_id", "text")


@query("site_documents")
def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each host of the pages."""
    pages = load(spark, sf_dir, "pages").select(ux.column(ux.host, "url").alias("site"), "url", F.lit("page").alias("kind"), "html")
    out = site.site_documents(site.page_documents(pages))
    return out.select("site", F.size("pages").alias("n_pages"), "needs_rendering", "phones", "emails", "colors")


#: Links of a made-up home page, and which of them are chosen: kind and place.
HOME_LINKS = [("Login", "login", None), ("Our story", "our-story", ("about", 2)), ("Contact", "contact", ("contact", 1)), ("Contact 2", "contact-us", None), ("Shop", "shop", ("catalog", 3)), ("Cake", "products/cake", None)]


@query("page_selection_topk", lambda: "SELECT concat('s', page_id, '.example') AS site, kind, place, concat('https://s', page_id, '.example/', path) AS url FROM pages CROSS JOIN (VALUES " + ", ".join(f"('{path}', '{won[0]}', {won[1]})" for _, path, won in HOME_LINKS if won) + ") AS e(path, kind, place)")
def page_selection_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pages to read of each site: every page_id is one, with the same links on its home page."""
    made = spark.createDataFrame([(i, text, path) for i, (text, path, _) in enumerate(HOME_LINKS)], "seq long, text string, path string")
    site_name = F.concat(F.lit("s"), "page_id", F.lit(".example"))
    links = load(spark, sf_dir, "pages").select("page_id").crossJoin(F.broadcast(made))  # six rows
    links = links.select(site_name.alias("site"), F.concat(F.lit("https://"), site_name, F.lit("/")).alias("home"), "text", F.concat(F.lit("https://"), site_name, F.lit("/"), "path").alias("url"), "seq")
    return site.select_pages(links).select("site", "kind", F.col("place").cast("int").alias("place"), "url")


def _paths(d) -> str:
    q = ux.query(d, "url")
    return f"SELECT DISTINCT {ux.host(d, 'url')} AS host, concat({ux.path(d, 'url')}, CASE WHEN {q} <> '' THEN concat('?', {q}) ELSE '' END) AS path FROM pages"


def _verdict_oracle() -> str:
    # of /fr/1, /fr/ and /*.html$ the longest that matches wins
    own = "NOT path LIKE '/%.html' AND (path LIKE '/fr/1%' OR NOT path LIKE '/fr/%')"
    return f"SELECT host, path, agent, CASE agent WHEN 'GPTBot' THEN FALSE WHEN 'Googlebot' THEN TRUE ELSE {own} END AS allowed FROM ({_paths(DUCK)}) AS p CROSS JOIN (VALUES ('MyBot'), ('GPTBot'), ('Googlebot')) AS a(agent)"


@query("robots_verdict", _verdict_oracle)
def robots_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every page's path and three agents, under one robots file for all hosts."""
    body = "User-agent: *\nDisallow: /fr/\nAllow: /fr/1\nDisallow: /*.html$\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: Googlebot\nDisallow:\n"
    load(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    urls = spark.sql(_paths(SPARK))
    files = urls.select("host").distinct().withColumn("body", F.lit(body))
    agents = spark.createDataFrame([("MyBot",), ("GPTBot",), ("Googlebot",)], "agent string")
    return rb.verdicts(rb.robots_rules(files), urls, agents)


def _many_rules_oracle() -> str:
    return f"""WITH p AS ({_paths(DUCK)}),
        r AS (SELECT host, false AS allow, path[:9] AS body, 'prefix' AS kind, length(path[:9]) AS n FROM p UNION SELECT host, true, path, 'whole', length(path) + 1 FROM p WHERE length(path) % 2 = 0
              UNION SELECT host, length(path) % 3 = 0, path[-7:], 'end', length(path[-7:]) + 3 FROM p UNION SELECT host, length(path) % 5 = 0, path[5:12], 'piece', length(path[5:12]) + 3 FROM p),
        h AS (SELECT p.host, p.path, r.n, r.allow FROM p JOIN r ON p.host = r.host AND CASE r.kind WHEN 'prefix' THEN starts_with(p.path, r.body) WHEN 'whole' THEN p.path = r.body
              WHEN 'end' THEN ends_with(p.path[2:], r.body) ELSE contains(p.path[2:], r.body) END)
        SELECT p.host, p.path, 'MyBot' AS agent, coalesce(arg_max(h.allow, h.n * 2 + h.allow::INT), true) AS allowed FROM p LEFT JOIN h USING (host, path) GROUP BY ALL"""


@query("robots_many_rules", _many_rules_oracle)
def robots_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every page's path where each page of a host adds four rules to its robots file: a prefix, its whole path,
    its end behind a wildcard, and a piece of it between wildcards."""
    load(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    urls = spark.sql(_paths(SPARK))
    n = F.length("path")
    line = lambda allow, *body: F.concat(F.when(allow, "Allow: ").otherwise("Disallow: "), *body)
    lines = F.array(line(F.lit(False), F.substring("path", 1, 9)), F.when(n % 2 == 0, line(F.lit(True), "path", F.lit("$"))), line(n % 3 == 0, F.lit("/*"), F.expr("right(path, 7)"), F.lit("$")), line(n % 5 == 0, F.lit("/*"), F.substring("path", 5, 8), F.lit("*")))
    rules = urls.select("host", F.explode(F.array_compact(lines)).alias("line")).distinct()
    files = rules.groupBy("host").agg(F.concat(F.lit("User-agent: *\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("body"))
    return rb.verdicts(rb.robots_rules(files), urls, spark.createDataFrame([("MyBot",)], "agent string"))


@query(
    "ai_bot_readiness",
    lambda: f"""SELECT host, CASE WHEN length(host) % 2 = 0 THEN 'PerplexityBot' ELSE '' END AS retrieval_blocked, CASE WHEN length(host) % 5 = 0 THEN 'CCBot,GPTBot' ELSE '' END AS training_blocked,
        length(host) % 3 = 0 AS has_llms_txt, CASE WHEN length(host) % 2 = 0 THEN 'HIGH' WHEN length(host) % 3 = 0 THEN 'LOW' ELSE 'MEDIUM' END AS risk
        FROM (SELECT DISTINCT {ux.host(DUCK, 'url')} AS host FROM pages) AS h""",
)
def ai_bot_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bots of AI each host turns away. Robots files depend on the length of the host's name."""
    hosts = load(spark, sf_dir, "pages").select(ux.column(ux.host, "url").alias("host")).distinct()
    parts = [F.when(F.length("host") % n == 0, text).otherwise("") for n, text in ((2, "User-agent: PerplexityBot\nDisallow: /\n\n"), (5, "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\n"))]
    rules = rb.robots_rules(hosts.withColumn("body", F.concat(*parts, F.lit("User-agent: *\nAllow: /\n"))))
    blocked = lambda c: F.array_join(F.array_sort(F.map_keys(F.map_filter(c, lambda k, v: v == "BLOCKED"))), ",")
    out = rb.ai_readiness(rules, hosts.withColumn("has_llms_txt", F.length("host") % 3 == 0))
    return out.select("host", blocked("retrieval").alias("retrieval_blocked"), blocked("training").alias("training_blocked"), "has_llms_txt", "risk")


@query("aimd_control")
def aimd_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate controller over every user's events, read as responses of a host."""
    ms = F.abs(F.col("value") * 10).cast("int")
    status = F.when(F.col("event_type") == "error", 503).otherwise(200)
    return fr.control(load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("seq"), ms.alias("ttfb_ms"), status.alias("status_code")))


def _described(d) -> str:
    """SQL for page_id and html: each page with scripts that describe it, in one of six shapes, behind its own markup."""
    text = "VARCHAR" if d is DUCK else "STRING"
    number = f"CAST(page_id AS {text})"
    node = lambda kind, more="": f"""concat('{{"@type":{kind},"url":"', url, '","sku":', {number}, '{more}}}')"""
    product, article, thing = node('"Product"', ',"offers":[{"lowPrice":3},{"availability":"InStock"}]'), node('["NewsArticle","Thing"]', ',"datePublished":"2024-02-30x"'), node('"WebPage"', ',"author":{"@type":"Person"}')
    block = lambda *parts: "concat('<script type=\"application/ld+json\">', " + ", ".join(parts) + ", '</script >')"
    shapes = [block(product), block("""'{"@graph":['""", article, "',['", thing, "']]}'"), block("'{'", product), block("'['", product, "','", thing, "',7]'"), block("' '"), f"concat({block(thing)}, '<script>x</script>', {block(article)})"]
    return "SELECT page_id, concat(html, CASE page_id % 6 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes)) + " END) AS html FROM pages"


def _records_oracle() -> str:
    found = [(0, "Product", True, True), (1, "NewsArticle", True, True), (1, "WebPage", True, False), (2, "InvalidJson", False, False), (3, "Product", True, True), (3, "WebPage", True, False), (5, "WebPage", True, False), (5, "NewsArticle", True, True)]
    counts = {"n_schema_invalid": (2,), "n_products_valid": (0, 3), "n_products_no_offer": (), "n_products_no_availability": (), "n_articles_valid": (1, 5), "n_articles_no_author": (5,), "n_articles_no_date": (), "n_schema_bad_dates": (1, 1, 5)}
    rows = ", ".join(f"({k}, '{t}', {v}, {g})" for k, t, v, g in found)
    sums = ", ".join("(CASE page_id % 6 " + " ".join(f"WHEN {k} THEN {ks.count(k)}" for k in sorted({*ks})) + f" ELSE 0 END)::INT AS {n}" if ks else f"0 AS {n}" for n, ks in counts.items())
    return f"SELECT page_id, schema_type, is_valid_json, is_google_eligible, {sums} FROM pages JOIN (VALUES {rows}) AS f(k, schema_type, is_valid_json, is_google_eligible) ON page_id % 6 = k"


@query("json_ld_records", _records_oracle)
def json_ld_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed nodes of the scripts that describe each page, and what the rules count of its page."""
    load(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    values = jl.parsed(jl.blocks(spark.sql(_described(SPARK)), "html", "page_id"))
    counts = "n_schema_invalid n_products_valid n_products_no_offer n_products_no_availability n_articles_valid n_articles_no_author n_articles_no_date n_schema_bad_dates".split()
    found = jl.records(values, ["page_id", "block"]).select("page_id", "schema_type", "is_valid_json", "is_google_eligible")
    return found.join(jl.audit(values, ["page_id"]).select("page_id", *counts), "page_id")


# The first address of each restricted stretch of IPv4, and the first after it.
_BOUNDS = [int(n[k]) + k for n in map(ipaddress.ip_network, address.V4) for k in (0, -1)]


def _literal(d) -> str:
    """SQL for page_id and an address literal: a few addresses to either side of a bound, written in one of three ways."""
    bounds = ", ".join(map(str, _BOUNDS))
    bound = f"list_extract([{bounds}], page_id % {len(_BOUNDS)} + 1)" if d is DUCK else f"element_at(array({bounds}), CAST(page_id % {len(_BOUNDS)} AS INT) + 1)"
    whole = f"greatest(0, least(4294967295, {bound} + page_id % 7 - 3))"
    part = lambda i: f"CAST((x {'//' if d is DUCK else 'div'} {256**i}) % 256 AS {'VARCHAR' if d is DUCK else 'STRING'})"
    text = "VARCHAR" if d is DUCK else "STRING"
    low = f"CAST(x % 65536 AS {text})"
    dotted = f"concat({part(3)}, '.', {part(2)}, '.', {part(1)}, '.', {part(0)})"
    return f"SELECT page_id, x, CASE page_id % 3 WHEN 0 THEN {dotted} WHEN 1 THEN CAST(x AS {text}) ELSE concat({part(3)}, '.', {part(2)}, '.', {low}) END AS host FROM (SELECT page_id, CAST({whole} AS BIGINT) AS x FROM pages) AS b"


def _address_oracle() -> str:
    a, b, c = "(x >> 24)", "((x >> 16) & 255)", "((x >> 8) & 255)"
    kept = f"{a} IN (0, 10, 127) OR {a} >= 224 OR {a} = 100 AND {b} BETWEEN 64 AND 127 OR {a} = 169 AND {b} = 254 OR {a} = 172 AND {b} BETWEEN 16 AND 31 OR {a} = 192 AND ({b} = 168 OR {b} = 0 AND {c} = 2) OR {a} = 198 AND {b} = 51 AND {c} = 100 OR {a} = 203 AND {b} = 0 AND {c} = 113"
    return f"SELECT page_id, host, NOT ({kept}) AS may_fetch FROM ({_literal(DUCK)}) AS l"


@query("address_guard", _address_oracle)
def address_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an address beside a bound of a restricted network, one a page, may be fetched."""
    load(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql(_literal(SPARK)).select("page_id", "host", address.public_host(F.col("host")).alias("may_fetch"))
