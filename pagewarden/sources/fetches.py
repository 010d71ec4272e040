"""Fetched responses: their schema, challenge detection, charset, and a data source for live fetching."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, final_url string, status_code int, headers map<string,string>, content_type string, body string, size_bytes bigint, ttfb_ms int, redirect_chain array<string>, is_truncated boolean, crawl_depth int"
MAX_BODY, MAX_REDIRECTS = 15_000_000, 10

# What the pages of bot-challenge providers contain, in the order in which they are tried.
WAF_BODIES = {
    "Cloudflare": ["cf-browser-verification", "checking your browser before accessing", "cloudflare ray id", "/cdn-cgi/challenge-platform/", "attention required! | cloudflare"],
    "Akamai": ["akamai bot manager", "reference&#32;number:", "bm-sz=", "_abck="],
    "DataDome": ["geo.captcha-delivery.com", "datadome", "dd_cookie_test"],
    "Imperva": ["incapsula incident id", "_incap_ses", "visid_incap"],
    "AWS WAF": ["captcha.awswaf.com", "token.awswaf.com", "awswafintegration", "gokuprops"],
}


def waf_provider(status: str = "status_code", headers: str = "headers", body: str = "body") -> str:
    """SQL for the provider of a challenge page, or NULL."""
    low = f"lower({body})"
    has = lambda name: f"array_contains(map_keys({headers}), '{name}')"
    any_ = lambda words: "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"
    return (
        f"CASE WHEN {status} IN (403, 429, 503) AND {has('cf-ray')} AND {any_(['cf-browser-verification', 'just a moment', 'challenge-platform'])} THEN 'Cloudflare'"
        f" WHEN {has('x-datadome')} OR contains({headers}['set-cookie'], 'datadome=') THEN 'DataDome' WHEN {has('x-amzn-waf-action')} THEN 'AWS WAF' "
        + " ".join(f"WHEN {any_(words)} THEN '{name}'" for name, words in WAF_BODIES.items())
        + " END"
    )


def is_html(content_type: str = "content_type", body: str = "body") -> str:
    """SQL: whether a response is a page, by its type or by how it begins."""
    return f"coalesce(contains(lower({content_type}), 'html'), false) OR (coalesce({content_type}, '') = '' AND lower(ltrim({body})) RLIKE r'^(<!doctype html|<html|<head|<body)')"


def prepared(fetches: DataFrame) -> DataFrame:
    """Responses that are pages, with header names in lower case and waf_detected."""
    # Names that differ in case alone are one header; its first value counts.
    entries = F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    once = F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.filter(entries, lambda e: e["key"] == k)[0])
    lowered = fetches.withColumn("headers", F.map_from_entries(once))
    return lowered.withColumn("waf_detected", F.expr(waf_provider())).filter(F.expr(is_html()))


def decode_body(data: bytes, content_type: str | None) -> str:
    """Text of a body by the charset of its header, its byte-order mark or its first meta tag."""
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    head = data[:1024].decode("latin-1")
    if data[:3] == b"\xef\xbb\xbf":
        name = "utf-8-sig"
    elif data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        name = "utf-16"
    elif charset:
        name = charset[1]
    else:
        meta = re.search(r"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", head, re.I)
        name = meta[1] if meta else "utf-8"
    try:
        return data.decode(name, errors="replace")
    except LookupError:
        return data.decode("utf-8", errors="replace")


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class HttpSource(DataSource):
    """spark.read.format("http_pages").option("urls", "...") : one partition a host, redirects by hand, public addresses only."""

    @classmethod
    def name(cls):
        return "http_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _HttpReader(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.timeout = options.get("urls", "").split(), float(options.get("timeout", "30"))

    def partitions(self):
        from urllib.parse import urlsplit

        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        return [_Host(x) for x in hosts.values()]

    def read(self, partition):
        for url in partition.urls:
            yield fetch(url, self.timeout)


def fetch(url: str, timeout: float = 30, opener=None) -> tuple:
    """One response in the order of SCHEMA; a failed fetch has status 0 and no body."""
    import time
    import urllib.error
    import urllib.request
    from urllib.parse import urljoin, urlsplit

    from ..functions.url import is_public_address

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *a):
            return None

    opener = opener or urllib.request.build_opener(Stay)
    chain, at, ttfb = [], url, None
    while True:
        if not is_public_address(urlsplit(at).hostname or ""):
            return (url, at, 0, {}, None, None, 0, 0, chain, False, 0)
        began = time.monotonic()
        try:
            answer = opener.open(at, timeout=timeout)
        except urllib.error.HTTPError as e:
            answer = e
        except (OSError, ValueError):
            return (url, at, 0, {}, None, None, 0, ttfb or 0, chain, False, 0)
        ttfb = int((time.monotonic() - began) * 1000) if ttfb is None else ttfb
        headers = {k.lower(): v for k, v in answer.headers.items()}
        target = urljoin(at, headers["location"]) if 300 <= answer.status < 400 and headers.get("location") else None
        if target and target not in chain and target != at and len(chain) < MAX_REDIRECTS:
            chain.append(at)
            at = target
            continue
        data = answer.read(MAX_BODY + 1)
        cut = len(data) > MAX_BODY
        data = data[:MAX_BODY]
        return (url, at, answer.status, headers, headers.get("content-type"), decode_body(data, headers.get("content-type")), len(data), ttfb, chain, cut, 0)
