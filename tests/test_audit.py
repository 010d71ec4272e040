"""Rules, graph, score and whole audits on small made-up sites."""

import json

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import duplicates as dup
from pagewarden.operators import frontier as fr
from pagewarden.operators import graph as g
from pagewarden.operators import graph_rules as gr
from pagewarden.operators import page_rules as pr
from pagewarden.operators import score
from pagewarden.operators import site
from pagewarden.operators.catalog import rules
from pagewarden.plans import reports
from pagewarden.plans.audit import audit, inspect
from pagewarden.sources import fetches as fe
from pagewarden.sources import html
from pagewarden.sources import robots as rb
from pagewarden.sources import sitemap as sm
from pagewarden.sources.storage import Store


def codes(spark, **features):
    row = {k: v for k, v in pr.FEATURES.items()} | features
    df = spark.sql("SELECT " + ", ".join(f"{v} AS {k}" for k, v in row.items()))
    return sorted(r["code"] for r in pr.findings(df, "url").collect())


GOOD = {"url": "'https://e.com/a'", "url_host": "'e.com'", "title": "repeat('t', 40)", "meta_description": "repeat('d', 100)", "h1_primary": "'One'", "h1_count": "1", "h2_count": "1", "canonical_url": "'https://e.com/a'", "canonical_host": "'e.com'", "viewport": "'width=device-width'", "html_lang": "'en'", "word_count": "500", "n_links": "5", **{k: "TRUE" for k in ("has_hsts", "has_csp", "has_x_frame_options", "has_x_content_type", "has_referrer_policy")}}


def test_catalogue():
    known = rules()
    assert len(known) == len({c for c, *_ in known}) == 100
    assert {c for c, _ in pr.page_rules()} <= {c for c, *_ in known}


def test_good_page_is_clean(spark):
    assert codes(spark, **GOOD) == []


@pytest.mark.parametrize(
    "feature,below,at,code",
    [
        ("title", "repeat('t', 30)", "repeat('t', 29)", "WARN_TITLE_TOO_SHORT"), ("title", "repeat('t', 60)", "repeat('t', 61)", "WARN_TITLE_TOO_LONG"),
        ("meta_description", "repeat('d', 70)", "repeat('d', 69)", "WARN_META_DESC_TOO_SHORT"), ("meta_description", "repeat('d', 160)", "repeat('d', 161)", "WARN_META_DESC_TOO_LONG"),
        ("h1_primary", "repeat('h', 70)", "repeat('h', 71)", "WARN_H1_TOO_LONG"), ("word_count", "200", "199", "WARN_CONTENT_THIN"), ("n_links", "250", "251", "WARN_LINKS_TOO_MANY_ON_PAGE"),
        ("dom_element_count", "1500", "1501", "WARN_EXCESSIVE_DOM_DEPTH"), ("ttfb_ms", "1800", "1801", "WARN_SLOW_TTFB"), ("size_bytes", "1500000", "1500001", "WARN_PERF_LARGE_HTML_PAYLOAD"),
        ("size_bytes", "1000", "3000001", "ERR_PERF_EXCESSIVE_HTML_PAYLOAD"), ("status_code", "399", "400", "ERR_HTTP_4XX_CLIENT_ERROR"), ("status_code", "200", "503", "ERR_HTTP_5XX_SERVER_ERROR"),
        ("n_content_facets", "2", "3", "ALERT_FACETED_SPIDER_TRAP"), ("robots_flags", "8", "1", "ALERT_INDEXING_BLOCKED_NOINDEX"), ("robots_flags", "0", "16", "WARN_NOARCHIVE_PRESENT"),
        ("canonical_url", "'https://e.com/A/'", "'https://e.com/b'", "ALERT_CANONICAL_MISMATCH"), ("viewport", "'maximum-scale=10'", "'maximum-scale=1.0'", "WARN_MOBILE_VIEWPORT_NON_SCALABLE"),
        ("html_lang", "'de'", "' '", "WARN_HTML_LANG_MISSING"), ("waf_detected", "CAST(NULL AS STRING)", "'Akamai'", "ALERT_WAF_BOT_CHALLENGE"), ("n_images_long_alt", "0", "1", "WARN_IMG_ALT_TOO_LONG"),
    ],
)
def test_boundaries(spark, feature, below, at, code):
    assert code not in codes(spark, **GOOD | {feature: below})
    assert code in codes(spark, **GOOD | {feature: at})


def test_soft_404_and_counts(spark):
    assert "ERR_HTTP_SOFT_404" in codes(spark, **GOOD | {"title": "'Page Not Found on this long enough title'", "word_count": "149"})
    assert "ERR_HTTP_SOFT_404" not in codes(spark, **GOOD | {"title": "'Page Not Found on this long enough title'", "word_count": "150"})
    assert codes(spark, **GOOD | {"n_schema_bad_dates": "3"}) == ["WARN_SCHEMA_INVALID_DATE_FORMAT"] * 3
    assert "ERR_TITLE_MISSING" in codes(spark, **GOOD | {"title": "'  '"})


def edges(spark, pairs, kind="hyperlink", nofollow=False):
    return spark.createDataFrame([(a, b, kind, nofollow) for a, b in pairs], "src string, dst string, edge_type string, is_nofollow boolean")


def ranks(spark, pairs):
    e = edges(spark, pairs)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return {r["node"]: r["rank"] for r in g.pagerank(nodes, e).collect()}


def test_pagerank(spark):
    ring = ranks(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert all(abs(r - 1 / 3) < 1e-4 for r in ring.values())
    star = ranks(spark, [("l1", "hub"), ("l2", "hub"), ("l3", "hub"), ("hub", "l1")])
    assert star["hub"] > 2 * star["l2"] and abs(sum(star.values()) - 1) < 1e-4
    assert abs(sum(ranks(spark, [("a", "b"), ("a", "b"), ("a", "c")]).values()) - 1) < 1e-9
    empty = spark.createDataFrame([], "node string")
    assert g.pagerank(empty, edges(spark, [])).count() == 0


def test_degrees_count_parallel_edges(spark):
    e = edges(spark, [("a", "b"), ("a", "b"), ("b", "b")])
    got = {r["node"]: (r["in_degree"], r["out_degree"]) for r in g.degrees(e.select(F.col("src").alias("node")).distinct(), e).collect()}
    assert got == {"a": (0, 2), "b": (3, 1)}


def test_redirects_and_canonicals(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("q", "a")], "redirect")
    paths = g.redirect_paths(e)
    assert [r["cycle"] for r in g.redirect_loops(paths).collect()] == [["a", "b", "c", "a"]]
    assert sorted(r["path"] for r in g.redirect_chains(paths, e).collect()) == [["q", "a", "b", "c"], ["x", "y", "z"]]
    c = edges(spark, [("a", "b"), ("b", "a"), ("c", "c"), ("d", "a")], "canonical")
    assert [tuple(r) for r in g.canonical_loops(c).collect()] == [("a", "b")]


def test_health_score(spark):
    issues = spark.createDataFrame([("a", 2)] * 20000, "category string, severity int")
    pages = spark.createDataFrame([(500,)], "n long")
    assert score.health_score(issues, pages).first()["score"] == 65
    more = issues.unionByName(spark.createDataFrame([("b", 1)] * 10000 + [("c", 2)] * 10, "category string, severity int"))
    assert score.health_score(more, pages).first()["score"] == 30
    none = spark.createDataFrame([], "category string, severity int")
    assert score.health_score(none, spark.createDataFrame([(0,)], "n long")).first()["score"] == 100


def test_simhash_banding_loses_no_pair(spark):
    import random

    r = random.Random(1)
    base = [r.getrandbits(60) for _ in range(60)]
    near = [x ^ sum(1 << b for b in r.sample(range(60), k)) for x in base for k in (0, 1, 2, 3, 4)]
    values = sorted(set(base + near))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, simhash long")
    got = {(x["a"], x["b"]) for x in dup.near_pairs(df).collect()}
    assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3}


def test_robots(spark):
    text = "User-agent: *\nDisallow: /*.php$\nAllow: /a\nDisallow: /a/b\n\nUser-agent: Bot # x\nUser-agent: Other\nDisallow:\nCrawl-delay: 2\nSitemap: https://e.com/s.xml"
    rules = rb.robots_rules(spark.createDataFrame([("h", text)], "host string, body string"))
    paths = ["/index.php", "/index.php?query=1", "/index.phps", "/a/b/c", "/a/x"]
    urls = spark.createDataFrame([("h", p) for p in paths] + [("none", "/x")], "host string, path string")
    agents = spark.createDataFrame([("x",), ("MyBot",)], "agent string")
    got = {(r["host"], r["path"], r["agent"]): r["allowed"] for r in rb.verdicts(rules, urls, agents).collect()}
    assert [got["h", p, "x"] for p in paths] == [False, True, True, False, True]
    assert all(got["h", p, "MyBot"] for p in paths) and got["none", "/x", "x"]
    assert rules.filter("crawl_delay = 2").count() == 2 and rules.filter("sitemap IS NOT NULL").count() == 1


def test_ai_readiness(spark):
    rules = rb.robots_rules(spark.createDataFrame([("h", "User-agent: PerplexityBot\nDisallow: /"), ("k", "")], "host string, body string"))
    hosts = spark.createDataFrame([("h", True), ("k", False)], "host string, has_llms_txt boolean")
    got = {r["host"]: r for r in rb.ai_readiness(rules, hosts).collect()}
    assert got["h"]["risk"] == "HIGH" and got["h"]["retrieval"]["PerplexityBot"] == "BLOCKED" and len(got["h"]["training"]) == 7
    assert got["k"]["risk"] == "MEDIUM"
    files = spark.createDataFrame([("h", 200, 404), ("k", 503, 200)], "host string, robots_status int, llms_status int")
    assert sorted((r["host"], r["code"]) for r in rb.site_findings(rules, files).collect()) == [("h", "ALERT_AI_SEARCH_BOTS_BLOCKED"), ("h", "WARN_LLMS_TXT_MISSING"), ("k", "ERR_HTTP_5XX_SERVER_ERROR")]


def test_sitemaps(spark):
    import gzip

    index = b'<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>u1</loc></sitemap></sitemapindex>'
    urls = b'<urlset xmlns:x="http://www.w3.org/1999/xhtml"><url><loc>a</loc><priority>0.5</priority><x:link rel="alternate" hreflang="de" href="b"/></url><url><loc>c</loc></url>'
    files = spark.createDataFrame([("root", bytearray(index)), ("u1", bytearray(gzip.compress(urls))), ("bad", bytearray(b"<!DOCTYPE x><urlset/>"))], "url string, content binary")
    entries = sm.sitemap_entries(files)
    assert sorted(r["loc"] for r in sm.discovered(entries, spark.createDataFrame([("root",)], "url string")).collect()) == ["a", "c"]
    assert entries.filter("loc = 'a'").first()["alternates"][0]["hreflang"] == "de"


def test_discovery(spark):
    sites = spark.createDataFrame([("e.com", "https://e.com"), ("f.com", "https://f.com")], "host string, origin string")
    rules_ = rb.robots_rules(spark.createDataFrame([("e.com", "User-agent: *\nDisallow: /x\nSitemap: https://e.com/maps.xml"), ("f.com", "User-agent: *\nAllow: /")], "host string, body string"))
    roots = sm.sitemap_roots(sites, rules_)
    assert sorted(r["url"] for r in roots.collect()) == ["https://e.com/maps.xml", "https://f.com/sitemap.xml", "https://f.com/sitemap_index.xml", "https://f.com/wp-sitemap.xml"]
    entries = spark.createDataFrame([("https://e.com/maps.xml", True, "https://e.com/m1.xml"), ("https://e.com/m1.xml", False, "https://e.com/a"), ("https://e.com/m1.xml", False, "https://e.com/a"), ("https://e.com/m1.xml", False, "https://e.com/b.pdf"), ("https://e.com/m1.xml", False, "https://g.com/c")], "sitemap_url string, is_index boolean, loc string")
    for most in (0, 5):
        assert [r["url"] for r in sm.discovered_pages(entries, roots, "E.com", most).collect()] == ["https://e.com/a"]


def test_rate_control(spark):
    c = fr.Controller(10)
    c.failure(429)
    assert (c.concurrency, c.delay) == (5, 100)
    c.failure(503)
    assert (c.concurrency, c.delay) == (2, 200)
    for _ in range(55):
        c.success(80)
    assert c.delay < 200 and c.concurrency > 2
    rows = spark.createDataFrame([("h", 1, 50, 429), ("h", 2, 50, 503), ("k", 1, 50, 200)], "host string, seq long, ttfb_ms int, status_code int")
    assert sorted(tuple(r) for r in fr.control(rows).collect()) == [("h", 1, 100, 5), ("h", 2, 200, 2), ("k", 1, 0, 10)]


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b", True), ("b", "c", True), ("c", "d", True), ("a", "x", False)], "source_url string, target_url string, is_internal boolean")
    pages = spark.createDataFrame([(u,) for u in "abcdx"], "url string")
    seeds = spark.createDataFrame([("a",)], "url string")
    seen, whole = fr.crawl(pages, links, seeds)
    assert sorted(tuple(r) for r in seen.collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)] and whole
    seen, whole = fr.crawl(pages, links, seeds, max_depth=1)
    assert seen.count() == 2 and not whole


PAGE = """<!DOCTYPE html><html lang="en"><head><title>{title}</title><meta name="description" content="d">
<link rel="canonical" href="{canonical}"><link rel="alternate" hreflang="de" href="/de"><meta property="og:type" content="article"></head>
<body><nav><a href="/">Home</a></nav><h1>Hello &amp; welcome</h1><p>{body}</p><a href="{link}">here</a><a href="tel:1">t</a><a href="https://other.org/" target="_blank">out</a>
<img src="/i.png" alt=""><script type="application/ld+json">{{"@type":"Product"}}</script></body></html>"""


@pytest.fixture(scope="module")
def crawl(spark):
    page = lambda url, depth=1, status=200, **k: (url, url, status, {"Strict-Transport-Security": "x"}, "text/html", PAGE.format(**{"title": "T", "canonical": url, "body": "word " * 60, "link": "/b"} | k), 1000, 10, [], False, depth)
    rows = [page("https://e.com/", 0), page("https://e.com/b", link="/c"), page("https://e.com/c", 2, body="other " * 70, link="/d"), page("https://e.com/de", 5, 404, canonical="/b", body="x")]
    return spark.createDataFrame(rows, fe.SCHEMA)


def test_parse(spark):
    p = html.parse_html(PAGE.format(title="A &amp; B", canonical="/x#f", body="one two", link="sub?b=1&a=2"), "https://e.com/dir/")
    assert p["title"] == "A & B" and p["canonical_url"] == "https://e.com/x" and p["is_canonical_relative"]
    assert [x["target_url"] for x in p["links"]] == ["https://e.com/", "https://e.com/dir/sub?a=2&b=1", "https://other.org/"]
    assert [x["is_internal"] for x in p["links"]] == [True, True, False] and p["h1_primary"] == "Hello & welcome"
    assert p["images"][0]["alt_text"] == "" and not p["images"][0]["has_dimensions"] and p["hreflangs"][0]["target_url"] == "https://e.com/de"
    assert p["word_count"] == 8 and p["schemas"][0]["schema_type"] == "Product"
    assert html.parse_html("", "https://e.com/")["title"] is None
    assert html.parse_html("<p>a<b>b</p></div><<<a href='x", "https://e.com/")["word_count"] >= 1


def test_whole_audit(spark, crawl, tmp_path):
    sitemap = spark.createDataFrame([("https://e.com/lost",), ("https://e.com/b",)], "url string")
    robots = spark.createDataFrame([("e.com", "User-agent: GPTBot\nDisallow: /")], "host string, body string")
    files = spark.createDataFrame([("e.com", 200, 404)], "host string, robots_status int, llms_status int")
    a = audit(crawl, sitemap, robots, files)
    found = {(r["url"], r["code"]) for r in a.issues.collect()}
    for want in [
        ("https://e.com/de", "ERR_HTTP_4XX_CLIENT_ERROR"), ("https://e.com/de", "ERR_CANONICAL_RELATIVE"), ("https://e.com/", "ERR_HREFLANG_TO_BROKEN_OR_REDIRECT"), ("https://e.com/", "WARN_LINK_SUSPICIOUS_ANCHOR"),
        ("https://e.com/lost", "ALERT_GRAPH_ORPHAN_PAGE"), ("https://e.com/de", "WARN_GRAPH_HIGH_CRAWL_DEPTH"), ("e.com", "ALERT_AI_SEARCH_BOTS_BLOCKED"), ("e.com", "WARN_LLMS_TXT_MISSING"), ("https://e.com/b", "WARN_SECURITY_TARGET_BLANK_NO_OPENER"),
    ]:
        assert want in found, want
    assert ("https://e.com/", "WARN_SECURITY_MISSING_HSTS") not in found
    assert {u for u, c in found if c == "WARN_GRAPH_DUPLICATE_TITLES"} < {"https://e.com/", "https://e.com/b", "https://e.com/c", "https://e.com/de"}
    assert sum(c == "WARN_GRAPH_EXACT_DUPLICATE_CONTENT" for _, c in found) == 1
    assert 0 <= a.score.first()["score"] <= 100

    store = Store(spark, f"file://{tmp_path}/store")
    store.begin("s1", "https://e.com/")
    store.save("s1", a)
    assert store.crawls().first()["status"] == "completed" and store.table("pages", "s1").count() == 4
    assert store.issues("s1", category="links", url_part="E.COM").count() == store.count_issues("s1", category="links", url_part="E.COM") > 0
    assert store.broken_links("s1").count() == 0
    import io

    from pagewarden import mcp

    asked = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "query_issues", "arguments": {"session_id": "s1", "limit": 2}}}, {"method": "note"}, {"id": 4, "method": "nope"}, {"id": 5, "method": "tools/call", "params": {"name": "markdown_report", "arguments": {"session_id": "s1"}}}]
    out = io.StringIO()
    mcp.serve(mcp.Tools(spark, store), [*map(json.dumps, asked), "{"], out)
    replies = list(map(json.loads, out.getvalue().splitlines()))
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, None] and len(replies[1]["result"]["tools"]) == 8
    assert len(json.loads(replies[2]["result"]["content"][0]["text"])["issues"]) == 2 and "error" in replies[3] and "score" in replies[4]["result"]["content"][0]["text"]
    assert store.delete("s1") and not store.delete("nope") and store.crawls().count() == 0

    reports.csv_suite(a, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/internal_all")).count() == 4
    reports.json_report(a, str(tmp_path / "json"))
    text = reports.markdown_report(a)
    assert "Health score" in text and "ERR_HTTP_4XX_CLIENT_ERROR" in text
    assert "<h1>Health score" in reports.html_report(a) and "Quick wins" in reports.llm_report(a)
    json.loads(reports.json_text(a))
    dashboard = reports.html_report(a, 2)
    assert "Pages (2 of 4)" in dashboard and dashboard.count("<meter") == 4 and "https://other.org" not in dashboard
    card = reports.scorecard(a, 3, 2, 20).splitlines()
    assert card[0].startswith("Health [") and len(card[0].split("]")[0]) == 28 and card[1].startswith("4 pages, TTFB average 10 ms, p95 10 ms")
    assert len(card) == 5 + 3 + 2 + 2
    assert inspect(crawl, "https://e.com/").count() > 0
    text = reports.inspection(crawl, "https://e.com/")
    assert "status_code: 200" in text and "links: 3" in text and f"Findings ({inspect(crawl, 'https://e.com/').count()})" in text
    assert reports.inspection(crawl, "https://e.com/none") == "https://e.com/none: no response\n"


def test_json_schema():
    from pyspark.sql import types as T

    t = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.ArrayType(T.StringType())), T.StructField("c", T.MapType(T.StringType(), T.DoubleType())), T.StructField("d", T.StructType([T.StructField("e", T.BooleanType())]))])
    assert reports.json_schema(t) == {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["a"],
        "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}}, "c": {"type": "object", "additionalProperties": {"type": "number"}}, "d": {"type": "object", "properties": {"e": {"type": "boolean"}}, "required": []}},
    }


def test_rendered_differences(spark):
    base = spark.sql("SELECT " + ", ".join(f"{v} AS {k}" for k, v in (pr.FEATURES | GOOD).items()) + ", url AS final_url, array() AS runtime_errors")
    changed = base.withColumns({"canonical_url": F.lit("https://e.com/z"), "robots_flags": F.lit(1), "word_count": F.lit(5), "runtime_errors": F.array(F.lit("x"))})
    got = sorted(r["code"] for r in pr.rendered_differences(base, changed).collect())
    assert got == ["ALERT_JS_DIFF_VANISHING_CONTENT", "ERR_JS_DIFF_CANONICAL_ALTERED", "ERR_JS_DIFF_HYDRATION_CRASH", "ERR_JS_DIFF_NOINDEX_INJECTED"]
    assert pr.rendered_differences(base, base).count() == 0


def test_hubs_and_hreflang(spark):
    pages = spark.createDataFrame([("a", 0), ("b", 5)], "url string, crawl_depth int")
    d = spark.createDataFrame([("a", 1, 50), ("b", 1, 0)], "node string, in_degree long, out_degree long")
    r = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "node string, rank double")
    assert sorted((x["url"], x["code"]) for x in gr.architecture(pages, d, r).collect()) == [("a", "WARN_LOW_INTERNAL_PAGERANK_HUB"), ("b", "WARN_GRAPH_DEAD_END_PAGE"), ("b", "WARN_GRAPH_HIGH_CRAWL_DEPTH")]


def test_waf_and_html(spark):
    rows = [(403, {"cf-ray": "1"}, "Just a moment"), (200, {"x-amzn-waf-action": "c"}, ""), (200, {"set-cookie": "datadome=1"}, ""), (200, {}, "... _abck= ..."), (200, {}, "fine")]
    df = spark.createDataFrame(rows, "status_code int, headers map<string,string>, body string")
    assert [r[0] for r in df.select(F.expr(fe.waf_provider())).collect()] == ["Cloudflare", "AWS WAF", "DataDome", "Akamai", None]
    assert fe.decode_body(b'<meta charset="iso-8859-1">\xe9', None).endswith("é") and fe.decode_body(b"\xef\xbb\xbfx", None) == "x"


def test_site_document(spark):
    home = '<title>Bakery</title><style>h1{color:#ff0000;font-family:Inter}</style><a href="tel:+8801711223344">Call</a><a href="/contact">Contact us</a><a href="mailto:Hi@Bakery.com">m</a><script type="application/ld+json">{"@type":"Bakery","name":"B","telephone":"1","address":{"streetAddress":"S 1","addressCountry":{"name":"BD"}}}</script>'
    pages = spark.createDataFrame([("b.com", "https://b.com/", "home", home), ("b.com", "https://b.com/contact", "contact", "<p>Phone: 01711-223344 and hi@bakery.com</p>")], "site string, url string, kind string, html string")
    docs = site.page_documents(pages)
    assert docs.filter("kind = 'home'").first()["facts"]["addresses"] == ["S 1, BD"]
    d = site.site_documents(docs).first()
    assert d["phones"] == ["+8801711223344"] and d["emails"] == ["hi@bakery.com"] and d["colors"][0]["hex"] == "#FF0000" and d["fonts"][0]["family"] == "Inter"
    links = spark.createDataFrame([("b.com", "https://b.com/", t, u, i) for i, (t, u) in enumerate([("Contact", "https://b.com/contact"), ("Contact 2", "https://b.com/contact-us"), ("Shop", "https://b.com/shop"), ("Cake", "https://b.com/products/cake"), ("Login", "https://b.com/login"), ("About", "https://x.com/about"), ("Our story", "https://b.com/our-story#x")])], "site string, home string, text string, url string, seq long")
    assert [(r["kind"], r["url"]) for r in site.select_pages(links).orderBy("place").collect()] == [("contact", "https://b.com/contact"), ("about", "https://b.com/our-story"), ("catalog", "https://b.com/shop")]
    h = site.head_facts('<base href="/x/"><meta property="og:site_name" content="B"><link rel=stylesheet href="a.css"><link rel=stylesheet href="https://fonts.googleapis.com/css?family=Lato"><link rel=icon href=i.ico><div class="partner-logos"><img src="/p/logo.png" class="partner logo"></div><header><a href="/"><img src="/l.png" alt="Our logo"></a></header><a href="c">  <b>C</b></a>', "https://b.com/")
    assert h["site_name"] == "B" and h["stylesheets"] == ["https://b.com/x/a.css"] and h["web_fonts"] == ["Lato"] and h["logos"] == ["https://b.com/l.png"] and {"url": "https://b.com/x/c", "text": "C"} in h["anchors"]
    assert site.to_markdown("<h2>Hi</h2><ul><li>a</li></ul><p hidden>no</p><script>x</script>", "https://b.com/") == "## Hi\n\n- a"


def test_site_documents_parses_a_page_once(spark, tmp_path):
    """The branches of a site's document share one reading of its pages."""
    made = spark.range(6).select(F.lit("s.example").alias("site"), F.concat(F.lit("https://s.example/"), "id").alias("url"), F.lit("page").alias("kind"), F.lit("<p>Call 01712345678</p>").alias("html"))
    folder = str(tmp_path)

    def count(frames):
        import uuid

        for f in frames:
            for _ in range(len(f)):
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            yield f

    docs = site.page_documents(made.mapInPandas(count, "site string, url string, kind string, html string"))
    d = site.site_documents(docs).collect()
    assert len(d) == 1 and len(d[0]["pages"]) == 6 and d[0]["phones"] == ["01712345678"]
    assert len(list(tmp_path.iterdir())) == 6


def test_pages_are_parsed_in_pieces():
    """A batch is handed on in parts, so that a worker doesn't hold the parsed rows of all of it."""
    import pandas as pd

    from pagewarden.sources import html as h

    frame = pd.DataFrame({"body": ["x" * 10] * 450 + [None, "y" * 9_000_000, "z"] + ["w" * 1_500_000] * 3})
    parts = list(h.pieces(frame, "body"))
    assert pd.concat(parts).equals(frame)
    assert [len(p) for p in parts] == [200, 200, 51, 1, 3, 1]
    assert list(h.pieces(frame[:0], "body")) == []


def test_a_batch_of_pages_stays_in_arrow(spark):
    """Of a batch only the pages of one part become Python objects; its other columns are handed on as they came."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = to_arrow_schema(StructType.fromDDL(html.PARSED))
    bodies = [f"<title>t{i}</title><p>one two" for i in range(450)] + [None]
    batch = pa.RecordBatch.from_pydict({"body": bodies, "url": [f"https://a.example/{i}" for i in range(450)] + [None], "headers": pa.array([[("k", str(i))] for i in range(451)], pa.map_(pa.string(), pa.string()))})
    parts = list(html.parse_batch(batch, "body", "url", parsed))
    assert [p.num_rows for p in parts] == [200, 200, 51]
    assert [x.equals(y) for p, at in zip(parts, (0, 200, 400)) for x, y in zip(p.columns, batch.slice(at, p.num_rows).columns)] == [True] * 9
    assert all(x.buffers()[-1].address == y.buffers()[-1].address for p in parts for x, y in zip(p.columns[:2], batch.columns[:2]))
    assert [t for p in parts for t in p.column("title").to_pylist()] == [f"t{i}" for i in range(450)] + [None]
    assert {n for p in parts for n in p.column("word_count").to_pylist()[:50]} == {2}
    assert parts[0].schema.names == [*batch.schema.names, *parsed.names]
