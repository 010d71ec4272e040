"""The rule catalogue as a DataFrame: code, category, severity, title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rule codes by category, with their severity (1 critical, 2 alert, 3 warning, 4 notice).
CATALOG = {
    "http_transport": "ERR_HTTP_4XX_CLIENT_ERROR 1 ERR_HTTP_5XX_SERVER_ERROR 1 INFO_HTTP_301_PERMANENT_REDIRECT 4 INFO_HTTP_302_TEMPORARY_REDIRECT 3 INFO_HTTP_307_308_REDIRECT 4 ALERT_WAF_BOT_CHALLENGE 2 WARN_SLOW_TTFB 3 ALERT_FACETED_SPIDER_TRAP 2 ERR_HTTP_SOFT_404 1",
    "title_metadata": "ERR_TITLE_MISSING 1 WARN_TITLE_TOO_SHORT 3 WARN_TITLE_TOO_LONG 3 ERR_TITLE_MULTIPLE 2 WARN_TITLE_WHITESPACE_PADDED 4 WARN_TITLE_SAME_AS_H1 3 WARN_META_DESC_MISSING 3 WARN_META_DESC_TOO_SHORT 3 WARN_META_DESC_TOO_LONG 3 ERR_META_DESC_MULTIPLE 2 WARN_META_KEYWORDS_PRESENT 4 WARN_IMAGE_MISSING_ALT 3 WARN_IMG_ALT_TOO_LONG 4",
    "headings": "ERR_H1_MISSING 1 WARN_H1_MULTIPLE 3 WARN_H1_EMPTY 3 WARN_H1_TOO_LONG 3 WARN_HEADING_HIERARCHY_SKIPPED 3 WARN_DUPLICATE_HEADING_TEXT 3 WARN_EXCESSIVE_DOM_DEPTH 3",
    "indexability": "ALERT_INDEXING_BLOCKED_NOINDEX 2 WARN_LINK_EQUITY_BLOCKED_NOFOLLOW 3 WARN_NOARCHIVE_PRESENT 4 WARN_NOSNIPPET_PRESENT 4 WARN_PAGINATION_MISSING_CANONICAL 3 ALERT_PAGINATION_NOINDEX 2 ALERT_UNRENDERED_SPA_HEURISTIC 2",
    "canonicalization": "WARN_CANONICAL_MISSING 3 ERR_CANONICAL_RELATIVE 2 ERR_CANONICAL_MULTIPLE 2 ALERT_CANONICAL_MISMATCH 2 ALERT_CANONICAL_CROSS_DOMAIN 2 WARN_CANONICAL_TO_UNVERIFIED_HTTP 3",
    "security": "ERR_SECURITY_INSECURE_HTTP 1 ERR_SECURITY_MIXED_CONTENT 1 WARN_SECURITY_MISSING_HSTS 3 WARN_SECURITY_MISSING_CSP 3 WARN_SECURITY_MISSING_X_FRAME_OPTIONS 4 WARN_SECURITY_MISSING_X_CONTENT_TYPE 4 WARN_SECURITY_MISSING_REFERRER_POLICY 4 WARN_SECURITY_TARGET_BLANK_NO_OPENER 3 WARN_SECURITY_INSECURE_FORM 2",
    "mobile_ux": "WARN_IMAGE_MISSING_DIMENSIONS 3 WARN_IMAGE_DATA_URI 4 ERR_MOBILE_NO_VIEWPORT 1 WARN_MOBILE_VIEWPORT_NON_SCALABLE 3 WARN_PERF_LARGE_HTML_PAYLOAD 3 ERR_PERF_EXCESSIVE_HTML_PAYLOAD 1",
    "links": "WARN_LINKS_TOO_MANY_ON_PAGE 3 WARN_LINK_SUSPICIOUS_ANCHOR 3 WARN_LINK_EMPTY_ANCHOR 3",
    "structured_data": "ERR_SCHEMA_SYNTAX_ERROR 2 WARN_SCHEMA_MISSING_REQUIRED_FIELDS 3 WARN_SCHEMA_MULTIPLE_PRODUCT_ENTITIES 3 WARN_SCHEMA_INVALID_DATE_FORMAT 3 ERR_PRODUCT_MISSING_SCHEMA 2 WARN_PRODUCT_MISSING_PRICE_OFFER 3 WARN_PRODUCT_MISSING_AVAILABILITY 3 ERR_ARTICLE_MISSING_SCHEMA 2 WARN_ARTICLE_MISSING_AUTHOR 3 WARN_ARTICLE_MISSING_DATE_PUBLISHED 3 WARN_ORG_MISSING_LOCAL_SCHEMA 3",
    "geo_ai_search": "WARN_CONTENT_THIN 3 WARN_LOREM_IPSUM_DETECTED 3 ALERT_AI_SEARCH_BOTS_BLOCKED 2 WARN_LLMS_TXT_MISSING 3",
    "internationalization": "ERR_HREFLANG_NOT_RECIPROCAL 1 ERR_HREFLANG_TO_NON_CANONICAL 2 ERR_HREFLANG_TO_BROKEN_OR_REDIRECT 1 ERR_HREFLANG_INVALID_LANG_CODE 1 WARN_HREFLANG_CROSS_DOMAIN 3 WARN_HREFLANG_MISSING_X_DEFAULT 3 ERR_HREFLANG_MISSING_SELF_REFERENCE 1 WARN_HTML_LANG_MISSING 3",
    "site_graph": "ALERT_GRAPH_ORPHAN_PAGE 2 ERR_GRAPH_REDIRECT_LOOP 1 WARN_GRAPH_REDIRECT_CHAIN 3 ERR_GRAPH_CANONICAL_LOOP 1 WARN_GRAPH_EXACT_DUPLICATE_CONTENT 2 WARN_GRAPH_NEAR_DUPLICATE_CONTENT 3 WARN_GRAPH_DUPLICATE_TITLES 3 WARN_GRAPH_DUPLICATE_META_DESCS 3 WARN_GRAPH_DEAD_END_PAGE 3 WARN_GRAPH_HIGH_CRAWL_DEPTH 3 WARN_LOW_INTERNAL_PAGERANK_HUB 3",
    "js_diff": "ERR_JS_DIFF_CANONICAL_ALTERED 1 ERR_JS_DIFF_NOINDEX_INJECTED 1 WARN_JS_DIFF_TITLE_META_DESYNC 2 ALERT_JS_DIFF_VANISHING_CONTENT 2 ALERT_JS_DIFF_LATE_RENDERED_LINKS 3 ERR_JS_DIFF_HYDRATION_CRASH 1",
}
SEVERITIES = {1: "critical", 2: "alert", 3: "warning", 4: "notice"}


def rules() -> list[tuple[str, str, int, str]]:
    out = []
    for category, text in CATALOG.items():
        items = text.split()
        for code, severity in zip(items[::2], items[1::2]):
            out.append((code, category, int(severity), code.partition("_")[2].replace("_", " ").capitalize()))
    return out


def rules_table(spark: SparkSession) -> DataFrame:
    """One row a rule: a hundred rows, whatever is audited."""
    return spark.createDataFrame(rules(), "code string, category string, severity int, title string")


def values_sql() -> str:
    """The catalogue as an SQL row list: code, category, severity, title."""
    return "(VALUES " + ", ".join(f"('{c}', '{g}', {s}, '{t}')" for c, g, s, t in rules()) + ") AS rules(code, category, severity, title)"
