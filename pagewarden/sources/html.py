"""Any markup to page rows: the general parser, one pass a page, in Arrow batches.

Fields follow the feature columns of page rules, with the page's links, images, schemas and language
alternates as nested lists. Text stays undecoded until a field is cleaned; every tag splits words."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import DIRECTIVES, ENTITIES
from ..functions.url import resolve_url, same_host
from ..operators.intent import classify
from .jsonld import AUDIT_FIELDS, audit_schemas, parse_json_ld
from .markup import GENERIC_ANCHORS, SOFT_404, SPA_MARKERS

EXCLUDED = {"head", "nav", "header", "footer", "script", "style", "noscript"}
#: Rows and characters of markup that are parsed before their rows are handed on.
PIECE_ROWS, PIECE_CHARS = 200, 4_000_000
_ALNUM = re.compile(r"[^\W_]")

PARSED = """title string, title_count int, meta_description string, description_count int, meta_keywords string, viewport string, charset string, html_lang string,
robots_flags int, canonical_url string, canonical_count int, is_canonical_relative boolean, h1_primary string, h1_count int, h2_headings array<string>, h3_headings array<string>,
dom_element_count int, open_graph array<struct<key:string,value:string>>, twitter array<struct<key:string,value:string>>,
links array<struct<target_url:string,anchor_text:string,is_internal:boolean,is_nofollow:boolean,is_image_link:boolean,is_target_blank:boolean,has_opener_or_referrer:boolean>>,
images array<struct<src_url:string,alt_text:string,width:int,height:int,has_dimensions:boolean>>,
schemas array<struct<schema_type:string,raw_json:string,is_valid_json:boolean,is_google_eligible:boolean>>,
hreflangs array<struct<lang_code:string,target_url:string>>,
word_count int, content_hash bigint, simhash bigint, page_intent struct<archetype:string,confidence:double,signals:array<string>>, schema_audit struct<""" + ", ".join(f"{n}:int" for n in AUDIT_FIELDS) + ">"


def clean(text: str) -> str:
    return " ".join(text.split())


def decoded(text: str) -> str:
    for a, b in ENTITIES:
        text = text.replace(a, b)
    return clean(text)


def robots_bits(value: str) -> int:
    bits = 0
    for item in value.lower().split(","):
        bits |= DIRECTIVES.get(item.strip(), 0)
    return bits


def words(text: str) -> list[str]:
    return [w for w in text.split() if any(c.isalnum() for c in w)]


def hash60(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _core(word: str) -> str:
    """A word without signs around it."""
    first = _ALNUM.search(word)
    return word[first.start() : len(word) - _ALNUM.search(word[::-1]).start()] if first else ""


def simhash(text: str) -> int:
    tokens = Counter(t for w in text.lower().split() if (t := w if w.isalnum() else _core(w)))
    if not tokens:
        return 0
    h = np.fromiter(map(hash60, tokens), dtype=np.int64, count=len(tokens))
    n = np.fromiter(tokens.values(), dtype=np.int64, count=len(tokens))
    votes = ((h[:, None] >> np.arange(60)) & 1) * 2 - 1
    return sum(1 << i for i, v in enumerate((votes * n[:, None]).sum(axis=0).tolist()) if v > 0)


class _Parser(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=False)
        self.url, self.base = url, url
        self.f: dict = dict.fromkeys(("meta_description", "meta_keywords", "viewport", "charset", "html_lang", "canonical_url"))
        self.f |= {"robots_flags": 0, "is_canonical_relative": False, "description_count": 0, "title_count": 0, "canonical_count": 0, "dom_element_count": 0}
        self.titles: list[str] = []
        self.headings: dict[str, list[str]] = {"h1": [], "h2": [], "h3": []}
        self.open_graph, self.twitter, self.links, self.images, self.schemas, self.hreflangs = [], [], [], [], [], []
        self.body: list[str] = []
        self.skipped: list[str] = []
        self.heading: tuple[str, list[str]] | None = None
        self.link: dict | None = None
        self.in_title, self.script = False, None

    def handle_starttag(self, tag, attrs):
        self._start(tag, {k: v or "" for k, v in reversed(attrs)})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in ("svg", "path"):
            self.handle_endtag(tag)

    def _start(self, tag, a):
        f = self.f
        f["dom_element_count"] += 1
        self.body.append(" ")
        if tag in EXCLUDED:
            self.skipped.append(tag)
        if tag == "html" and "lang" in a:
            f["html_lang"] = a["lang"].strip()
        elif tag == "title":
            self.in_title = True
            f["title_count"] += 1
        elif tag == "meta":
            self._meta(a)
        elif tag == "link":
            rel, href = a.get("rel", "").lower(), a.get("href", "").strip()
            if "canonical" in rel:
                f["canonical_count"] += 1
                if href and (target := resolve_url(self.base, href)):
                    f["canonical_url"] = target
                    f["is_canonical_relative"] |= not href.lower().startswith(("http://", "https://"))
            elif "alternate" in rel and a.get("hreflang") and (target := resolve_url(self.base, href)):
                self.hreflangs.append({"lang_code": a["hreflang"].strip(), "target_url": target})
        elif tag in self.headings:
            self._end_heading()
            self.heading = (tag, [])
        elif tag == "a" and "href" in a:
            self._end_link()
            href = a["href"].strip()
            if href and not href.lower().startswith(("tel:", "mailto:", "javascript:", "#", "data:")) and (target := resolve_url(self.base, href)):
                rel = a.get("rel", "").lower()
                self.link = {"target_url": target, "text": [], "is_internal": same_host(self.url, target), "is_nofollow": "nofollow" in rel, "is_image_link": False, "is_target_blank": a.get("target", "").lower() == "_blank", "has_opener_or_referrer": "noopener" in rel or "noreferrer" in rel}
        elif tag == "img":
            if self.link:
                self.link["is_image_link"] = True
            if (src := a.get("src", "").strip()) and (target := resolve_url(self.base, src)):
                size = [int(a[k]) if re.fullmatch(r"[0-9]{1,9}", a.get(k, "").strip()) else None for k in ("width", "height")]
                self.images.append({"src_url": target, "alt_text": decoded(a["alt"]) if "alt" in a else None, "width": size[0], "height": size[1], "has_dimensions": None not in size})
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.script = []

    def _meta(self, a):
        f, name, content = self.f, a.get("name", "").lower(), decoded(a.get("content", ""))
        if name == "description":
            f["description_count"] += 1
            f["meta_description"] = content or None
        elif name in ("keywords", "viewport"):
            f["meta_keywords" if name == "keywords" else "viewport"] = content or None
        elif name == "robots":
            f["robots_flags"] |= robots_bits(content)
        elif name.startswith("twitter:"):
            self.twitter.append({"key": name, "value": content})
        if a.get("property", "").lower().startswith("og:"):
            self.open_graph.append({"key": a["property"].lower(), "value": content})
        if "charset" in a:
            f["charset"] = a["charset"]
        elif a.get("http-equiv", "").lower() == "content-type" and (m := re.search(r"charset=([\w-]+)", content, re.I)):
            f["charset"] = m[1]

    def handle_endtag(self, tag):
        self.body.append(" ")
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
        if tag == "title":
            self.in_title = False
        elif tag in self.headings:
            self._end_heading()
        elif tag == "a":
            self._end_link()
        elif tag == "script" and self.script is not None:
            self.schemas += parse_json_ld("".join(self.script))
            self.script = None

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif self.in_title:
            self.titles.append(data)
        elif not (self.skipped and self.skipped[-1] in ("script", "style")):
            if self.heading:
                self.heading[1].append(data)
            if self.link:
                self.link["text"].append(data)
        if not self.skipped and not self.in_title:
            self.body.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def _end_heading(self):
        if self.heading and (text := decoded("".join(self.heading[1]))):
            self.headings[self.heading[0]].append(text)
        self.heading = None

    def _end_link(self):
        if self.link:
            self.link["anchor_text"] = decoded("".join(self.link.pop("text")))
            self.links.append(self.link)
        self.link = None


def parse_html(html: str, url: str) -> dict:
    """The parsed row of one page: the columns of PARSED."""
    p = _Parser(url)
    p.feed(html)
    p.close()
    p._end_heading()
    p._end_link()
    text = clean("".join(p.body))
    out = p.f | {
        "title": decoded("".join(p.titles)) or None,
        "h1_primary": p.headings["h1"][0] if p.headings["h1"] else None, "h1_count": len(p.headings["h1"]), "h2_headings": p.headings["h2"], "h3_headings": p.headings["h3"],
        "open_graph": p.open_graph, "twitter": p.twitter, "links": p.links, "images": p.images, "schemas": p.schemas, "hreflangs": p.hreflangs,
        "word_count": len(words(text)), "content_hash": hash60(text), "simhash": simhash(text),
    }
    out["page_intent"] = classify(out, html, url)
    out["schema_audit"] = audit_schemas(p.schemas)
    return out


def spread(rows: DataFrame) -> DataFrame:
    """rows of a plain scan that has fewer splits than there are cores, dealt over all of them; a scan with enough
    splits stays as it is, without an exchange, and so does a stream."""
    if rows.isStreaming:
        return rows
    cores, plan = rows.sparkSession.sparkContext.defaultParallelism, rows._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString() or plan.execute().getNumPartitions() >= cores:
        return rows
    return rows.repartition(2 * cores)


def _cuts(sizes) -> Iterator[tuple[int, int]]:
    """Begin and end of parts of at most PIECE_ROWS rows and PIECE_CHARS characters (a single row may have more)."""
    begin, held, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if i > begin and (i - begin == PIECE_ROWS or held + size > PIECE_CHARS):
            yield begin, i
            begin, held = i, 0
        held += size
    if begin <= i:
        yield begin, i + 1


def pieces(frame: pd.DataFrame, html: str) -> Iterator[pd.DataFrame]:
    """A batch in parts: parsed rows take many times their markup, so a worker holds those of one part."""
    for begin, end in _cuts(len(h or "") for h in frame[html]):
        yield frame.iloc[begin:end]


def parse_batch(batch: pa.RecordBatch, html: str, url: str, parsed: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A batch with its parsed columns, in parts. Only the markup and URLs of one part become Python objects; all other
    columns are handed on as they came."""
    for begin, end in _cuts(pc.utf8_length(batch.column(html)).fill_null(0).to_pylist()):
        part = batch.slice(begin, end - begin)
        rows = [parse_html(h or "", u or "") for h, u in zip(part.column(html).to_pylist(), part.column(url).to_pylist())]
        yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([r[f.name] for r in rows], f.type) for f in parsed]], [*part.schema.names, *parsed.names])


def parse_pages(fetches: DataFrame, html: str = "body", url: str = "url") -> DataFrame:
    """fetches with the columns of PARSED. A null body is an empty page."""
    parsed = to_arrow_schema(StructType.fromDDL(PARSED))

    def run(batches):
        for batch in batches:
            yield from parse_batch(batch, html, url, parsed)

    kept = spread(fetches.drop(*parsed.names))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, {PARSED}")


def features_of(parsed: DataFrame) -> DataFrame:
    """Feature columns of page rules from parsed rows that kept url, body and the fetch's columns.

    Needed of a fetch: status_code, headers, ttfb_ms, is_truncated, size_bytes, waf_detected, crawl_depth."""
    from ..functions import url as ux
    from ..functions.dialect import SPARK as d

    count = lambda xs, e: f"size(filter({xs}, x -> {e}))"
    blank = lambda x: f"coalesce(regexp_replace({x}, r'[\\x20\\x09-\\x0D]', ''), '') = ''"
    generic = ", ".join(f"'{x}'" for x in GENERIC_ANCHORS)
    twice = lambda xs: f"size({xs}) <> size(array_distinct(transform({xs}, x -> lower(x))))"
    header = lambda name: f"coalesce(array_contains(map_keys(headers), '{name}'), false)"
    made = {
        "has_hsts": header("strict-transport-security"), "has_csp": header("content-security-policy"), "has_x_frame_options": header("x-frame-options"),
        "has_x_content_type": header("x-content-type-options"), "has_referrer_policy": header("referrer-policy"),
        "h2_count": "size(h2_headings)", "h3_count": "size(h3_headings)", "has_duplicate_heading": f"{twice('h2_headings')} OR {twice('h3_headings')}",
        "n_links": "size(links)", "n_blank_unsafe": count("links", "x.is_target_blank AND NOT x.has_opener_or_referrer"),
        "n_generic_anchor": count("links", f"lower(x.anchor_text) IN ({generic})"), "n_empty_anchor": count("links", "x.anchor_text = '' AND NOT x.is_image_link"),
        "n_images_no_alt": count("images", blank("x.alt_text")), "n_images_no_dimensions": count("images", "NOT x.has_dimensions"),
        "n_images_data_uri": count("images", "x.src_url LIKE 'data:image/%'"), "n_images_long_alt": count("images", "length(x.alt_text) > 125"), "n_images_http": count("images", "x.src_url LIKE 'http://%'"),
        "archetype": "page_intent.archetype", "has_soft_404_phrase": d.has("lower(body)", SOFT_404), "has_spa_marker": d.has("lower(body)", SPA_MARKERS),
        "has_http_markup": d.has("body", '(src|action)=["\\x27]http://'), "has_http_form": d.has("body", 'action=["\\x27]http://'), "has_lorem_ipsum": "contains(lower(body), 'lorem ipsum')",
        "n_hreflang": "size(hreflangs)", "n_hreflang_bad_code": count("hreflangs", r"NOT x.lang_code RLIKE r'(?i)^(x-default|[a-z]{2,3}(-([a-z]{2}|[0-9]{3}|[a-z]{4})(-([a-z]{2}|[0-9]{3}))?)?)$' OR x.lang_code RLIKE r'(?i)^[a-z]{2,3}-uk(-|$)'"),
        "n_hreflang_cross_host": count("hreflangs", f"{ux.host(d, 'x.target_url')} <> {ux.host(d, 'url')}"),
        "has_x_default": "exists(hreflangs, x -> lower(x.lang_code) = 'x-default')", "has_self_hreflang": "exists(hreflangs, x -> x.target_url = url)",
        "n_content_facets": ux.content_facets(d, "url"), "is_pagination": ux.is_pagination_page(d, "url"), "url_host": ux.host(d, "url"), "canonical_host": f"nullif({ux.host(d, 'canonical_url')}, '')",
    }
    made |= {n: f"schema_audit.{n}" for n in AUDIT_FIELDS}
    out = parsed.withColumns({n: F.expr(e) for n, e in made.items()})
    return out.withColumns({n: F.expr(f"coalesce({n}, {e})") for n, e in {"has_spa_marker": "false", "has_soft_404_phrase": "false", "has_http_markup": "false", "has_http_form": "false", "has_lorem_ipsum": "false"}.items()})


def children(parsed: DataFrame, *keep: str) -> dict[str, DataFrame]:
    """links, images, schemas and hreflangs, a row for each item, with the page's url and the columns kept."""
    of = lambda name, url: parsed.select(*keep, F.col("url").alias(url), F.explode(name).alias("x")).select(*keep, url, "x.*")
    return {"links": of("links", "source_url"), "images": of("images", "page_url"), "schemas": of("schemas", "page_url"), "hreflangs": of("hreflangs", "page_url")}
