"""Sitemaps: XML, gzipped or not, to rows, and the closure over sitemap indexes."""

from __future__ import annotations

import gzip
import io
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as ux
from ..functions.dialect import SPARK

#: No sitemap may inflate to more; indexes are followed so deep.
MAX_BYTES, MAX_DEPTH = 50 << 20, 3
#: Where sitemaps are looked for when robots.txt names none, and the least bound on what is discovered.
USUAL_NAMES, LEAST_FOUND = ("sitemap.xml", "sitemap_index.xml", "wp-sitemap.xml"), 10_000
ENTRIES = "sitemap_url string, is_index boolean, loc string, lastmod string, changefreq string, priority float, alternates array<struct<hreflang:string,href:string>>"


def parse_sitemap(data: bytes) -> list[dict]:
    """Entries of a urlset or sitemap index; what can be read before an error in the XML counts."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.GzipFile(fileobj=io.BytesIO(data)).read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError("the sitemap is too large")
    if b"<!DOCTYPE" in data[:4096].upper() or b"<!ENTITY" in data.upper():
        raise ValueError("the sitemap declares entities")
    out: list[dict] = []
    is_index = False
    name = lambda e: e.tag.rpartition("}")[2].lower()
    try:
        for event, e in ET.iterparse(io.BytesIO(data), events=("start", "end")):
            tag = name(e)
            if event == "start":
                is_index |= tag == "sitemapindex"
            elif tag in ("url", "sitemap"):
                text = {name(c): (c.text or "").strip() for c in e}
                if text.get("loc"):
                    try:
                        priority = float(text["priority"])
                    except (KeyError, ValueError):
                        priority = None
                    alternates = [{"hreflang": c.get("hreflang"), "href": c.get("href")} for c in e if name(c) == "link" and c.get("hreflang")]
                    out.append({"is_index": is_index, "loc": text["loc"], "lastmod": text.get("lastmod"), "changefreq": text.get("changefreq"), "priority": priority, "alternates": alternates})
                e.clear()
    except ET.ParseError:
        pass
    return out


def sitemap_entries(files: DataFrame) -> DataFrame:
    """Rows of ENTRIES from files(url, content binary); a file that can't be read gives none."""

    def run(frames):
        for frame in frames:
            rows = []
            for url, data in zip(frame["url"], frame["content"]):
                try:
                    rows += [{"sitemap_url": url, **r} for r in parse_sitemap(bytes(data or b""))]
                except (ValueError, OSError, EOFError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRIES.split(", ")])

    return files.select("url", "content").mapInPandas(run, ENTRIES)


def discovered(entries: DataFrame, roots: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """loc of every URL reached from roots(url) through sitemap indexes, at most `depth` deep."""
    at = roots.select(F.col("url").alias("sitemap_url")).distinct()
    found = None
    for _ in range(depth + 1):
        met = entries.join(at, "sitemap_url")
        urls = met.filter("NOT is_index").select("loc")
        found = urls if found is None else found.unionByName(urls)
        at = met.filter("is_index").select(F.col("loc").alias("sitemap_url")).distinct()
    return found.distinct()


def sitemap_roots(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """host, url of the sitemaps of sites(host, origin): those that rules (robots.robots_rules) name, or else the usual ones."""
    named = rules.filter("sitemap IS NOT NULL").select("host", F.col("sitemap").alias("url")).distinct()
    usual = sites.join(named.select("host").distinct(), "host", "left_anti")
    usual = usual.select("host", F.explode(F.array(*[F.concat("origin", F.lit(f"/{n}")) for n in USUAL_NAMES])).alias("url"))
    return named.join(sites.select("host"), "host", "left_semi").unionByName(usual)


def discovered_pages(entries: DataFrame, roots: DataFrame, host: str, max_pages: int = 0) -> DataFrame:
    """url of the pages of one host that its sitemaps lead to, files left out. With max_pages at most
    max(3 * max_pages, LEAST_FOUND), the first by url: the crawl takes no more."""
    urls = discovered(entries, roots).select(F.col("loc").alias("url"))
    own = urls.filter(F.expr(ux.host(SPARK, "url")) == host.lower()).filter(f"NOT {ux.is_asset(SPARK, 'url')}")
    return own.orderBy("url").limit(max(3 * max_pages, LEAST_FOUND)) if max_pages else own
