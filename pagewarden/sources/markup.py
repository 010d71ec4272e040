"""Pages to feature rows by SQL expressions: stays in generated code, and reads the same in DuckDB.

Exact for pages whose excluded blocks (head, nav, header, footer, script, style, noscript) are closed;
html.py parses any markup."""

from __future__ import annotations

from ..functions import text as tx
from ..functions import url as ux
from ..operators.page_rules import FEATURES

# Anchors that say nothing, phrases of error pages, markers of script-built pages.
GENERIC_ANCHORS = ["click here", "click this", "here", "read more", "learn more", "more", "link", "this link", "page", "website", "continue", "details"]
SOFT_404 = "404 not found|page not found|page cannot be found|page was not found"
SPA_MARKERS = '<div id="(root|app|__next)">|id="root"|id="app"|<noscript>you need javascript|enable javascript to run this app'

#: The driver's pages have no HTTP response. This made-up one varies by page_id, so that rules meet cases.
ENVELOPE = {
    "status_code": "CASE WHEN page_id % 29 = 7 THEN 404 WHEN page_id % 31 = 5 THEN 503 WHEN page_id % 37 = 3 THEN 301 WHEN page_id % 41 = 9 THEN 302 ELSE 200 END",
    "ttfb_ms": "CAST((page_id * 37) % 2500 AS INT)",
    "crawl_depth": "CAST(page_id % 7 AS INT)",
    "has_hsts": "page_id % 2 = 0",
    "has_csp": "page_id % 3 = 0",
}


def attribute(d, tag, name):
    """Value of an attribute in a tag's text."""
    return d.ext(tag, rf'(?is)[\s"]{name}\s*=\s*"([^"]*)"')


def pieces(d) -> dict[str, str]:
    """What several features share, found once a page: the tags, headings and links of html."""
    html = "html"
    tags = lambda name: d.all(html, rf"(?is)<{name}(?:\s[^>]*)?>", 0)
    inner = lambda name: d.keep(d.map(d.all(html, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1), "x", tx.field(d, "x")), "x", "x <> ''")
    anchors = d.zip(d.all(html, r"(?is)<a(\s[^>]*)>.*?</a\s*>", 1), d.all(html, r"(?is)<a\s[^>]*>(.*?)</a\s*>", 1))
    target = attribute(d, d.left("z"), "href")
    return {
        "metas": tags("meta"), "titles": d.all(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1), "h1s": inner("h1"), "h2s": inner("h2"), "h3s": inner("h3"),
        "canonicals": d.keep(tags("link"), "t", d.has("lower(t)", r'rel\s*=\s*"[^"]*canonical')),
        "anchors": d.keep(anchors, "z", f"{target} <> '' AND NOT {d.has(f'lower({target})', '^(tel|mailto|javascript|data):|^#')}"),
        "images": d.keep(tags("img"), "t", f"{attribute(d, 't', 'src')} <> ''"), "low": "lower(html)",
    }


def features(d) -> dict[str, str]:
    """Feature name to expression over html, url and pieces."""
    html, low = "html", "low"
    meta = lambda name: d.keep("metas", "t", d.has("lower(t)", rf'name\s*=\s*"{name}"'))
    content = lambda xs: f"nullif({tx.clean(d, tx.decode(d, attribute(d, d.last(xs), 'content')))}, '')"
    h1, h2, h3, links, images, canon = "h1s", "h2s", "h3s", "anchors", "images", "canonicals"
    twice = lambda xs: f"{d.size(xs)} <> {d.size(d.distinct(d.map(xs, 'x', 'lower(x)')))}"
    canon_href = f"nullif({attribute(d, d.last(canon), 'href')}, '')"
    canonical = ux.normalize(d, ux.resolve(d, canon_href, "url"))
    anchor = f"lower({tx.field(d, d.right('z'))})"
    generic = "(" + ", ".join(f"'{x}'" for x in GENERIC_ANCHORS) + ")"
    count = lambda xs, v, e: d.size(d.keep(xs, v, e))
    return FEATURES | {
        "url": "url",
        "size_bytes": f"CAST({d.octets(html)} AS BIGINT)",
        "title": f"nullif({tx.clean(d, tx.decode(d, d.join("titles", "")))}, '')",
        "title_count": d.size("titles"),
        "meta_description": content(meta("description")),
        "description_count": d.size(meta("description")),
        "meta_keywords": content(meta("keywords")),
        "viewport": content(meta("viewport")),
        "robots_flags": f"coalesce({tx.robots_flags(d, d.join(d.map(meta('robots'), 't', attribute(d, 't', 'content')), ','))}, 0)",
        "h1_primary": d.first(h1), "h1_count": d.size(h1), "h2_count": d.size(h2), "h3_count": d.size(h3),
        "has_duplicate_heading": f"({twice(h2)} OR {twice(h3)})",
        "dom_element_count": d.size(d.all(d.rep(html, r"(?is)(<(script|style)(?:\s[^>]*)?>).*?</(script|style)\s*>", "<x>"), "<[A-Za-z][^>]*>", 0)),
        "canonical_url": canonical, "canonical_count": d.size(canon),
        "is_canonical_relative": f"coalesce(NOT {d.has(f'lower({canon_href})', '^https?://')}, FALSE)",
        "n_links": d.size(links),
        "n_blank_unsafe": count(links, "z", f"lower({attribute(d, d.left('z'), 'target')}) = '_blank' AND NOT {d.has(f'lower({attribute(d, d.left("z"), "rel")})', 'noopener|noreferrer')}"),
        "n_generic_anchor": count(links, "z", f"{anchor} IN {generic}"),
        "n_empty_anchor": count(links, "z", f"{anchor} = '' AND NOT {d.has(d.right('z'), '(?i)<img')}"),
        "n_images_no_alt": count(images, "t", tx.clean(d, attribute(d, "t", "alt")) + " = ''"),
        "n_images_no_dimensions": count(images, "t", f"NOT ({d.has(attribute(d, 't', 'width'), '^[0-9]+$')} AND {d.has(attribute(d, 't', 'height'), '^[0-9]+$')})"),
        "n_images_data_uri": count(images, "t", f"{attribute(d, 't', 'src')} LIKE 'data:image/%'"),
        "n_images_long_alt": count(images, "t", f"length({attribute(d, 't', 'alt')}) > 125"),
        "n_images_http": count(images, "t", f"{attribute(d, 't', 'src')} LIKE 'http://%'"),
        "word_count": tx.word_count(d, tx.editorial(d, html)),
        "html_lang": f"nullif({attribute(d, d.ext(html, '(?is)<html(?:[ ][^>]*)?>', 0), 'lang')}, '')",
        "has_soft_404_phrase": d.has(low, SOFT_404), "has_spa_marker": d.has(low, SPA_MARKERS),
        "has_http_markup": d.has(html, '(src|action)=["\\x27]http://'), "has_http_form": d.has(html, 'action=["\\x27]http://'),
        "has_lorem_ipsum": d.has(low, "lorem ipsum"),
        "n_content_facets": ux.content_facets(d, "url"), "is_pagination": ux.is_pagination_page(d, "url"),
        "url_host": ux.host(d, "url"), "canonical_host": f"nullif({ux.host(d, canonical)}, '')",
    }


def features_sql(d, table: str = "pages", envelope: dict | None = None) -> str:
    """One row of features a page of table(page_id, url, html)."""
    cols = features(d) | (ENVELOPE if envelope is None else envelope)
    shared = ", ".join(f"{e} AS {n}" for n, e in pieces(d).items())
    return f"SELECT page_id, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM (SELECT page_id, url, html, {shared} FROM {table}) AS pieces"


def links_sql(d, table: str = "pages") -> str:
    """page_id, source_url, href, target_url, anchor, is_internal, is_nofollow: every link occurrence."""
    pair = d.zip(d.all("html", r"(?is)<a(\s[^>]*)>.*?</a\s*>", 1), d.all("html", r"(?is)<a\s[^>]*>(.*?)</a\s*>", 1))
    rows = d.explode(table, "page_id, url", pair, "z")
    href = f"trim({attribute(d, d.left('z'), 'href')})"
    inner = f"""SELECT page_id, {ux.normalize(d, 'url')} AS source_url, {href} AS href, {ux.normalize(d, ux.resolve(d, href, 'url'))} AS target_url,
        {tx.field(d, d.right('z'))} AS anchor, {d.has(f"lower({attribute(d, d.left('z'), 'rel')})", 'nofollow')} AS is_nofollow FROM ({rows}) AS e
        WHERE NOT {d.has(f'lower({href})', '^(tel|mailto|javascript|data):|^#|^$')}"""
    return f"SELECT *, {ux.host(d, 'target_url')} = {ux.host(d, 'source_url')} AS is_internal FROM ({inner}) AS l WHERE target_url IS NOT NULL"
