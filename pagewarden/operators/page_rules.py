"""Page rules as expressions over one feature row a page; every finding comes from one projection.

A rule is a code and a count: how often it fires on a page. The expressions are SQL text that both
engines read, over the columns named in FEATURES (types in schemas.features). register_rule() adds more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from .catalog import rules_table

#: A feature row that triggers as little as possible; parsers override what they know.
FEATURES = {
    "url": "CAST(NULL AS STRING)", "status_code": "200", "waf_detected": "CAST(NULL AS STRING)", "ttfb_ms": "0", "is_truncated": "FALSE", "size_bytes": "CAST(0 AS BIGINT)", "crawl_depth": "0",
    "has_hsts": "FALSE", "has_csp": "FALSE", "has_x_frame_options": "FALSE", "has_x_content_type": "FALSE", "has_referrer_policy": "FALSE",
    "title": "CAST(NULL AS STRING)", "title_count": "1", "meta_description": "CAST(NULL AS STRING)", "description_count": "0", "meta_keywords": "CAST(NULL AS STRING)",
    "h1_primary": "CAST(NULL AS STRING)", "h1_count": "0", "h2_count": "0", "h3_count": "0", "has_duplicate_heading": "FALSE", "dom_element_count": "0",
    "robots_flags": "0", "canonical_url": "CAST(NULL AS STRING)", "canonical_count": "0", "is_canonical_relative": "FALSE",
    "n_links": "0", "n_blank_unsafe": "0", "n_generic_anchor": "0", "n_empty_anchor": "0",
    "n_images_no_alt": "0", "n_images_no_dimensions": "0", "n_images_data_uri": "0", "n_images_long_alt": "0", "n_images_http": "0",
    "viewport": "CAST(NULL AS STRING)", "word_count": "0", "archetype": "'standard'", "html_lang": "CAST(NULL AS STRING)",
    "has_soft_404_phrase": "FALSE", "has_spa_marker": "FALSE", "has_http_markup": "FALSE", "has_http_form": "FALSE", "has_lorem_ipsum": "FALSE",
    "n_schema_invalid": "0", "n_schema_incomplete": "0", "n_schema_bad_dates": "0", "n_products": "0", "n_products_valid": "0", "n_products_no_offer": "0", "n_products_no_availability": "0",
    "n_articles_valid": "0", "n_articles_no_author": "0", "n_articles_no_date": "0", "n_organisations": "0",
    "n_hreflang": "0", "n_hreflang_bad_code": "0", "n_hreflang_cross_host": "0", "has_x_default": "FALSE", "has_self_hreflang": "FALSE",
    "n_content_facets": "0", "is_pagination": "FALSE", "url_host": "CAST(NULL AS STRING)", "canonical_host": "CAST(NULL AS STRING)",
}

_W = r"[\x20\x09-\x0D\x{00A0}]"
# What titles of error pages say.
_ERROR_TITLE = "(404 not found|page not found|error 404)"


def page_rules(d=SPARK) -> list[tuple[str, str]]:
    """(code, how often it fires) over the columns of FEATURES."""
    trim = lambda x: d.rep(x, f"^{_W}+|{_W}+$")
    on = lambda p: f"CASE WHEN {p} THEN 1 ELSE 0 END"
    bit = lambda n: f"({d.bits('robots_flags', n)}) <> 0"
    title, desc, h1 = trim("title"), trim("meta_description"), trim("h1_primary")
    chars = lambda x: f"length({x})"
    bare = lambda x: f"lower({d.rep(x, '/+$')})"
    https = "url LIKE 'https://%'"
    soft = f"status_code = 200 AND (coalesce({d.has('lower(title)', _ERROR_TITLE)}, FALSE) OR coalesce({d.has('lower(h1_primary)', _ERROR_TITLE)}, FALSE)) AND (word_count < 150 OR has_soft_404_phrase)"
    return [
        ("ERR_HTTP_4XX_CLIENT_ERROR", on("status_code BETWEEN 400 AND 499")),
        ("ERR_HTTP_5XX_SERVER_ERROR", on("status_code BETWEEN 500 AND 599")),
        ("INFO_HTTP_301_PERMANENT_REDIRECT", on("status_code = 301")),
        ("INFO_HTTP_302_TEMPORARY_REDIRECT", on("status_code = 302")),
        ("INFO_HTTP_307_308_REDIRECT", on("status_code IN (307, 308)")),
        ("ALERT_WAF_BOT_CHALLENGE", on("waf_detected IS NOT NULL")),
        ("WARN_SLOW_TTFB", on("ttfb_ms > 1800")),
        ("ALERT_FACETED_SPIDER_TRAP", on("n_content_facets > 2")),
        ("ERR_HTTP_SOFT_404", on(soft)),
        ("ERR_PERF_EXCESSIVE_HTML_PAYLOAD", on("is_truncated OR size_bytes > 3000000")),
        ("WARN_PERF_LARGE_HTML_PAYLOAD", on("NOT is_truncated AND size_bytes > 1500000 AND size_bytes <= 3000000")),
        ("ERR_TITLE_MISSING", on(f"title IS NULL OR {title} = ''")),
        ("WARN_TITLE_WHITESPACE_PADDED", on(f"{title} <> '' AND title <> {title}")),
        ("WARN_TITLE_TOO_SHORT", on(f"{title} <> '' AND {chars(title)} < 30")),
        ("WARN_TITLE_TOO_LONG", on(f"{chars(title)} > 60")),
        ("ERR_TITLE_MULTIPLE", on("title_count > 1")),
        ("WARN_TITLE_SAME_AS_H1", on(f"{title} <> '' AND lower({title}) = lower({h1})")),
        ("WARN_META_KEYWORDS_PRESENT", on("meta_keywords IS NOT NULL")),
        ("WARN_META_DESC_MISSING", on(f"meta_description IS NULL OR {desc} = ''")),
        ("WARN_META_DESC_TOO_SHORT", on(f"{desc} <> '' AND {chars(desc)} < 70")),
        ("WARN_META_DESC_TOO_LONG", on(f"{chars(desc)} > 160")),
        ("ERR_META_DESC_MULTIPLE", on("description_count > 1")),
        ("ERR_H1_MISSING", on("h1_count = 0")),
        ("WARN_H1_MULTIPLE", on("h1_count > 1")),
        ("WARN_H1_EMPTY", on(f"h1_primary IS NOT NULL AND {h1} = ''")),
        ("WARN_H1_TOO_LONG", on(f"{chars(h1)} > 70")),
        ("WARN_HEADING_HIERARCHY_SKIPPED", on("h1_count > 0 AND h2_count = 0 AND h3_count > 0")),
        ("WARN_DUPLICATE_HEADING_TEXT", on("has_duplicate_heading")),
        ("WARN_EXCESSIVE_DOM_DEPTH", on("dom_element_count > 1500")),
        ("WARN_CANONICAL_MISSING", on("canonical_url IS NULL")),
        ("ERR_CANONICAL_RELATIVE", on("canonical_url IS NOT NULL AND is_canonical_relative")),
        ("ERR_CANONICAL_MULTIPLE", on("canonical_count > 1")),
        ("ALERT_CANONICAL_MISMATCH", on(f"{bare('canonical_url')} <> {bare('url')}")),
        ("ALERT_CANONICAL_CROSS_DOMAIN", on("canonical_host <> url_host")),
        ("WARN_CANONICAL_TO_UNVERIFIED_HTTP", on(f"{https} AND canonical_url LIKE 'http://%'")),
        ("ALERT_INDEXING_BLOCKED_NOINDEX", on(bit(1))),
        ("WARN_LINK_EQUITY_BLOCKED_NOFOLLOW", on(bit(2))),
        ("WARN_NOARCHIVE_PRESENT", on(bit(16))),
        ("WARN_NOSNIPPET_PRESENT", on(bit(4))),
        ("WARN_PAGINATION_MISSING_CANONICAL", on("is_pagination AND canonical_url IS NULL")),
        ("ALERT_PAGINATION_NOINDEX", on(f"is_pagination AND {bit(1)}")),
        ("ALERT_UNRENDERED_SPA_HEURISTIC", on("n_links = 0 AND word_count < 50 AND has_spa_marker")),
        ("ERR_SECURITY_INSECURE_HTTP", on(f"NOT {https}")),
        ("WARN_SECURITY_MISSING_HSTS", on(f"{https} AND NOT has_hsts")),
        ("ERR_SECURITY_MIXED_CONTENT", on(f"{https} AND (n_images_http > 0 OR has_http_markup)")),
        ("WARN_SECURITY_MISSING_CSP", on("NOT has_csp")),
        ("WARN_SECURITY_MISSING_X_FRAME_OPTIONS", on("NOT has_x_frame_options")),
        ("WARN_SECURITY_MISSING_X_CONTENT_TYPE", on("NOT has_x_content_type")),
        ("WARN_SECURITY_MISSING_REFERRER_POLICY", on("NOT has_referrer_policy")),
        ("WARN_SECURITY_TARGET_BLANK_NO_OPENER", on("n_blank_unsafe > 0")),
        ("WARN_SECURITY_INSECURE_FORM", on("has_http_form")),
        ("WARN_IMAGE_MISSING_ALT", on("n_images_no_alt > 0")),
        ("WARN_IMAGE_MISSING_DIMENSIONS", on("n_images_no_dimensions > 0")),
        ("WARN_IMAGE_DATA_URI", on("n_images_data_uri > 0")),
        ("WARN_IMG_ALT_TOO_LONG", on("n_images_long_alt > 0")),
        ("ERR_MOBILE_NO_VIEWPORT", on("viewport IS NULL")),
        ("WARN_MOBILE_VIEWPORT_NON_SCALABLE", on(d.has("lower(viewport)", "user-scalable=(no|0)|maximum-scale=1([.]0|,)"))),
        ("WARN_LINKS_TOO_MANY_ON_PAGE", on("n_links > 250")),
        ("WARN_LINK_EMPTY_ANCHOR", on("n_empty_anchor > 0")),
        ("WARN_LINK_SUSPICIOUS_ANCHOR", on("n_generic_anchor > 0")),
        ("ERR_SCHEMA_SYNTAX_ERROR", "n_schema_invalid"),
        ("WARN_SCHEMA_MISSING_REQUIRED_FIELDS", "n_schema_incomplete"),
        ("WARN_SCHEMA_INVALID_DATE_FORMAT", "n_schema_bad_dates"),
        ("WARN_SCHEMA_MULTIPLE_PRODUCT_ENTITIES", on("n_products > 1")),
        ("ERR_PRODUCT_MISSING_SCHEMA", on("archetype = 'product' AND n_products_valid = 0")),
        ("WARN_PRODUCT_MISSING_PRICE_OFFER", "CASE WHEN archetype = 'product' THEN n_products_no_offer ELSE 0 END"),
        ("WARN_PRODUCT_MISSING_AVAILABILITY", "CASE WHEN archetype = 'product' THEN n_products_no_availability ELSE 0 END"),
        ("ERR_ARTICLE_MISSING_SCHEMA", on("archetype = 'article' AND n_articles_valid = 0")),
        ("WARN_ARTICLE_MISSING_AUTHOR", "CASE WHEN archetype = 'article' THEN n_articles_no_author ELSE 0 END"),
        ("WARN_ARTICLE_MISSING_DATE_PUBLISHED", "CASE WHEN archetype = 'article' THEN n_articles_no_date ELSE 0 END"),
        ("WARN_ORG_MISSING_LOCAL_SCHEMA", on("archetype = 'contact' AND n_organisations = 0")),
        ("WARN_CONTENT_THIN", on("status_code = 200 AND word_count < 200")),
        ("WARN_LOREM_IPSUM_DETECTED", on("has_lorem_ipsum")),
        ("WARN_HTML_LANG_MISSING", on(f"coalesce({trim('html_lang')}, '') = ''")),
        ("ERR_HREFLANG_INVALID_LANG_CODE", "n_hreflang_bad_code"),
        ("WARN_HREFLANG_CROSS_DOMAIN", "n_hreflang_cross_host"),
        ("ERR_HREFLANG_MISSING_SELF_REFERENCE", on("n_hreflang > 0 AND NOT has_self_hreflang")),
        ("WARN_HREFLANG_MISSING_X_DEFAULT", on("n_hreflang > 0 AND NOT has_x_default")),
    ]


#: What a finding's message says of the page, as SQL over the feature columns; codes that aren't here have their title alone.
DETAILS = {
    **dict.fromkeys(("ERR_HTTP_4XX_CLIENT_ERROR", "ERR_HTTP_5XX_SERVER_ERROR", "INFO_HTTP_301_PERMANENT_REDIRECT", "INFO_HTTP_302_TEMPORARY_REDIRECT", "INFO_HTTP_307_308_REDIRECT"), "concat('status ', status_code)"),
    "ALERT_WAF_BOT_CHALLENGE": "concat('challenge of ', waf_detected)",
    "WARN_SLOW_TTFB": "concat(ttfb_ms, ' ms, over 1800')",
    "ALERT_FACETED_SPIDER_TRAP": "concat(n_content_facets, ' facets in the address, over 2')",
    "ERR_HTTP_SOFT_404": "concat('status 200 with ', word_count, ' words that say not found')",
    "ERR_PERF_EXCESSIVE_HTML_PAYLOAD": "CASE WHEN is_truncated THEN 'the body was cut off' ELSE concat(size_bytes, ' bytes, over 3000000') END",
    "WARN_PERF_LARGE_HTML_PAYLOAD": "concat(size_bytes, ' bytes, over 1500000')",
    "WARN_TITLE_TOO_SHORT": "concat(length(title), ' characters, under 30')",
    "WARN_TITLE_TOO_LONG": "concat(length(title), ' characters, over 60')",
    "ERR_TITLE_MULTIPLE": "concat(title_count, ' titles')",
    "WARN_META_KEYWORDS_PRESENT": "meta_keywords",
    "WARN_META_DESC_TOO_SHORT": "concat(length(meta_description), ' characters, under 70')",
    "WARN_META_DESC_TOO_LONG": "concat(length(meta_description), ' characters, over 160')",
    "ERR_META_DESC_MULTIPLE": "concat(description_count, ' descriptions')",
    "WARN_H1_MULTIPLE": "concat(h1_count, ' h1 headings')",
    "WARN_H1_TOO_LONG": "concat(length(h1_primary), ' characters, over 70')",
    "WARN_HEADING_HIERARCHY_SKIPPED": "concat(h3_count, ' h3 without h2')",
    "WARN_EXCESSIVE_DOM_DEPTH": "concat(dom_element_count, ' elements, over 1500')",
    **dict.fromkeys(("ERR_CANONICAL_RELATIVE", "ALERT_CANONICAL_MISMATCH", "WARN_CANONICAL_TO_UNVERIFIED_HTTP"), "concat('canonical is ', canonical_url)"),
    "ERR_CANONICAL_MULTIPLE": "concat(canonical_count, ' canonicals')",
    "ALERT_CANONICAL_CROSS_DOMAIN": "concat('canonical on ', canonical_host)",
    "WARN_SECURITY_TARGET_BLANK_NO_OPENER": "concat(n_blank_unsafe, ' links')",
    **dict.fromkeys(("WARN_IMAGE_MISSING_ALT",), "concat(n_images_no_alt, ' images')"),
    "WARN_IMAGE_MISSING_DIMENSIONS": "concat(n_images_no_dimensions, ' images')",
    "WARN_IMAGE_DATA_URI": "concat(n_images_data_uri, ' images')",
    "WARN_IMG_ALT_TOO_LONG": "concat(n_images_long_alt, ' images')",
    "WARN_MOBILE_VIEWPORT_NON_SCALABLE": "viewport",
    "WARN_LINKS_TOO_MANY_ON_PAGE": "concat(n_links, ' links, over 250')",
    "WARN_LINK_EMPTY_ANCHOR": "concat(n_empty_anchor, ' links')",
    "WARN_LINK_SUSPICIOUS_ANCHOR": "concat(n_generic_anchor, ' links')",
    "WARN_SCHEMA_MULTIPLE_PRODUCT_ENTITIES": "concat(n_products, ' products')",
    "WARN_CONTENT_THIN": "concat(word_count, ' words, under 200')",
    "ERR_HREFLANG_MISSING_SELF_REFERENCE": "concat(n_hreflang, ' alternates')",
    "WARN_HREFLANG_MISSING_X_DEFAULT": "concat(n_hreflang, ' alternates')",
}
_MORE: list[tuple[str, str]] = []


def register_rule(code: str, fires: str, detail: str | None = None) -> None:
    """Adds a rule: an SQL count over the feature columns, and what its message says. Its code should be in the table of rules too."""
    _MORE.append((code, fires))
    if detail:
        DETAILS[code] = detail


def findings(features: DataFrame, *keep: str) -> DataFrame:
    """keep columns, code and detail, one row for each finding: one projection and one explode for all rules."""
    detail = lambda code: F.expr(DETAILS[code]) if code in DETAILS else F.lit(None).cast("string")
    fired = F.array(*[F.struct(F.lit(code).alias("code"), F.expr(fires).cast("int").alias("times"), F.when(F.expr(fires) > 0, detail(code)).alias("detail")) for code, fires in [*page_rules(), *_MORE]])
    hits = F.filter(fired, lambda x: x["times"] > 0)
    each = F.flatten(F.transform(hits, lambda x: F.array_repeat(x, x["times"])))
    return features.select(*keep, F.explode(each).alias("x")).select(*keep, "x.code", "x.detail")


def described(found: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """found(code, detail, ...) with category, severity, title and message. The rules are broadcast: a hundred rows."""
    met = found.join(F.broadcast(rules or rules_table(found.sparkSession)), "code")
    return met.withColumn("message", F.concat_ws(": ", "title", "detail")).drop("detail")


def issues(features: DataFrame, *keep: str, rules: DataFrame | None = None) -> DataFrame:
    """findings with category, severity, title, message and source_page_url, the page where it was found."""
    names = list(dict.fromkeys([*keep, "url"]))
    found = described(findings(features, *names).withColumn("source_page_url", F.col("url")), rules)
    return found if "url" in keep else found.drop("url")


def findings_sql(d, features: str, keep: str) -> str:
    """The same over a table of features, for DuckDB: code and times a page."""
    fired = ", ".join(f"{{'code': '{code}', 'times': CAST({fires} AS INT)}}" for code, fires in page_rules(d))
    return f"SELECT {keep}, h.code AS code, h.times AS times FROM (SELECT {keep}, unnest([{fired}]) AS h FROM {features}) AS u WHERE h.times > 0"


def rendered_differences(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """url, code: what changes between the served and the rendered page, paired by url.

    Both need the feature columns; rendered also final_url and runtime_errors, raw final_url."""
    a, b = raw.alias("a"), rendered.alias("b")
    pairs = a.join(b, F.col("a.url") == F.col("b.url"))
    fewer = "b.word_count < (a.word_count div 2)"
    tests = {
        "ERR_JS_DIFF_CANONICAL_ALTERED": "NOT (a.canonical_url <=> b.canonical_url)",
        "ERR_JS_DIFF_NOINDEX_INJECTED": "(a.robots_flags & 1) = 0 AND (b.robots_flags & 1) <> 0",
        "WARN_JS_DIFF_TITLE_META_DESYNC": "a.final_url <> b.final_url AND a.title <=> b.title AND a.meta_description <=> b.meta_description",
        "ALERT_JS_DIFF_VANISHING_CONTENT": f"a.word_count >= 30 AND {fewer}",
        "ALERT_JS_DIFF_LATE_RENDERED_LINKS": "a.n_links = 0 AND b.n_links > 0",
        "ERR_JS_DIFF_HYDRATION_CRASH": f"size(b.runtime_errors) > 0 AND (b.word_count < 10 OR {fewer})",
    }
    fired = F.array(*[F.when(F.expr(t), F.lit(code)) for code, t in tests.items()])
    return pairs.select(F.col("a.url").alias("url"), F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("code"))
