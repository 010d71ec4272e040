"""One document a site: page choice, Markdown, contacts, colours, fonts, business facts."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contacts as co
from ..functions import design as de
from ..functions import scan
from ..functions.url import resolve_url
from ..staging import stage

# Kinds of pages with priority, number and keywords; what is never worth reading.
KINDS = [
    ("contact", 100, 1, ["contact", "reach us", "reach-us", "get in touch", "find us", "find-us", "যোগাযোগ", "আমাদের ঠিকানা"]),
    ("about", 90, 1, ["about", "our story", "our-story", "who we are", "who-we-are", "mission", "vision", "our values", "philosophy", "আমাদের সম্পর্কে", "আমাদের কথা", "লক্ষ্য"]),
    ("catalog", 60, 2, ["shop", "products", "product-category", "collections", "collection", "services", "service", "menu", "catalog", "catalogue", "categories", "পণ্য", "সেবা"]),
    ("locations", 50, 1, ["store locator", "store-locator", "stores", "outlet", "branches", "branch", "showroom", "locations", "শাখা", "শোরুম"]),
    ("ordering", 40, 1, ["how to order", "how-to-order", "order now", "links"]),
]
NEVER = "login signin signup register account accounts cart carts checkout wishlist compare search track tracking privacy terms refund refunds return returns shipping cookie cookies career careers jobs policy policies".split()
NEVER_PARTS = ["log-in", "sign-in", "blog/", "news/", "/tag/", "/page/2", "?page=", "lang=", "/feed", "wp-admin", "wp-login"]
DETAIL = ["product", "products", "p", "item", "items"]
LISTINGS = ["collections", "product-category", "categories", "category"]
FILES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".mp4", ".mp3", ".css", ".js", ".xml", ".ico")
MARKDOWN_CHARS, MAX_PAGES, MAX_COLORS, MAX_FONTS = 300_000, 6, 30, 30
BUSINESS_ENDINGS = ("store", "business", "shop", "clinic", "salon", "establishment")
BUSINESS = set("organization corporation restaurant bakery hotel dentist physician school library cafe bar foodestablishment localbusiness professionalservice ngo".split())


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_ঀ-৿]+|[\wঀ-৿]+", text.lower().replace("_", " "))


def _said(text: Column) -> Column:
    """The words of a text with a space around each."""
    found = F.regexp_extract_all(F.lower(F.replace(text, F.lit("_"), F.lit(" "))), F.lit(r"(?U)[^\W_ঀ-৿]+|[\wঀ-৿]+"), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def _naming(keywords: list[str]) -> str:
    """Pattern of padded words in which a keyword stands; plurals fit, words of other scripts with any ending."""
    word = lambda w: re.escape(w) + ("s?" if w.isascii() else "[^ ]*")
    return " (?:" + "|".join(" ".join(map(word, _words(k))) for k in keywords) + ") "


def _kinds(links: DataFrame) -> DataFrame:
    """links with kind, priority, most of its kind and listing, by the first of KINDS whose keywords a link's text or address
    has; a shop's single goods, and what is never worth reading, have none.

    Columns needed: text, path and query (decoded, in lower case)."""
    named = lambda keywords: F.col("said").rlike(_naming(keywords)) | F.col("way").rlike(_naming(keywords))
    out = links.withColumn("said", _said(F.col("text"))).withColumn("way", _said(F.concat_ws(" ", "path", "query"))).withColumn("parts", F.filter(F.split("path", "/"), lambda x: x != ""))
    hay = F.concat(F.lower("text"), F.lit(" "), "path", F.when(F.col("query") != "", "?").otherwise(""), "query")
    never = F.col("path").rlike("(?:" + "|".join(map(re.escape, FILES)) + ")$") | hay.rlike("|".join(map(re.escape, NEVER_PARTS))) | named(NEVER)
    # what the first segment of goods leads to is one of them
    one = (F.size("parts") > 2) | F.col("path").rlike(rf"^/*(?:(?!(?:{'|'.join(DETAIL)})/)[^/]+/+)*(?:{'|'.join(DETAIL)})/+[^/]")
    goods = next(k for kind, _, _, k in KINDS if kind == "catalog")
    listing = F.coalesce(F.get("parts", F.lit(0)).isin(LISTINGS) | _said(F.try_element_at("parts", F.lit(-1))).rlike(_naming(goods)), F.lit(False))
    table = [F.when(named(k), F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), F.lit(n).alias("most"))) for kind, priority, n, k in KINDS]
    out = out.withColumn("k", F.when(~never, F.coalesce(*table))).select("*", "k.*").filter("kind IS NOT NULL")
    return out.filter((F.col("kind") != "catalog") | ~one).withColumn("listing", (F.col("kind") != "catalog") | listing)


def select_pages(links: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """site, kind, url, place: pages to read, best first, from links(site, home, text, url, seq) of home pages."""
    of = lambda c, part: F.coalesce(F.try_parse_url(F.replace(c, F.lit(" "), F.lit("%20")), F.lit(part)), F.lit(""))
    own = lambda c: F.regexp_replace(F.lower(of(c, "AUTHORITY")), "^(?:[^@]*@)?(?:www[.])?", "")
    key = lambda c: F.concat(own(c), F.lower(F.rtrim(of(c, "PATH"), F.lit("/"))), F.when(of(c, "QUERY") != "", "?").otherwise(""), of(c, "QUERY"))
    plain = lambda c, part: F.lower(F.coalesce(F.try_url_decode(of(c, part)), of(c, part)))
    url, home = F.col("url"), F.col("home")
    near = links.filter(F.lower(of(url, "PROTOCOL")).isin("http", "https") & (own(url) == own(home)) & (key(url) != key(home)))
    near = near.select("site", F.coalesce("text", F.lit("")).alias("text"), "seq", F.substring_index("url", "#", 1).alias("url"), key(url).alias("page_key"), plain(url, "PATH").alias("path"), plain(url, "QUERY").alias("query"))
    scored = _kinds(near).withColumn("has_query", F.col("url").contains("?")).withColumn("other", ~F.col("listing")).withColumn("depth", F.size("parts")).withColumn("path_key", F.substring_index("url", "?", 1))
    best = [F.desc("priority"), "has_query", "other", "depth", "seq"]
    first = lambda df, n, order, *by: df.withColumn("r", F.row_number().over(Window.partitionBy("site", *by).orderBy(*order))).filter(F.col("r") <= n)
    once = first(first(scored, 1, ["seq"], "page_key"), 1, best, "path_key")
    return first(first(once, F.col("most"), best, "kind"), most, best).select("site", "kind", "url", "text", F.col("r").alias("place"))


STYLE, STYLE_END = re.compile(r"(?i)<style[^>]*>"), re.compile(r"(?i)</style\s*>")
# Marks of pages that scripts build.
DIV, ROOT, CLOSED = re.compile(r"(?i)<div[^>]*>"), re.compile(r"(?i).id=[\"']?(root|app|__next|__nuxt)[\"']?"), re.compile(r"(?i)\s*+</div>")
NOSCRIPT, ASKS = re.compile(r"(?i)<noscript[^>]*>"), re.compile(r"(?i)enable javascript|requires javascript|javascript is")


class _Markdown(HTMLParser):
    SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "select", "head"}
    BLOCK = set("p div section article main header footer nav aside table tr blockquote pre form figure ul ol dl dt dd address".split())

    def __init__(self, base: str):
        super().__init__()
        self.base, self.out, self.skip, self.links, self.lists = base, [], [], [], []

    def _break(self, n: int = 2):
        out, lines = self.out, 0
        while out and not (kept := out[-1].rstrip(" ")):
            out.pop()
        if not out:
            return
        out[-1] = kept
        for piece in reversed(out):
            bare = piece.rstrip("\n")
            lines += len(piece) - len(bare)
            if bare or lines >= n:
                break
        if lines < n:
            out.append("\n" * (n - lines))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("br", "hr", "img", "input", "meta", "link", "source", "wbr"):
            if not self.skip:
                if tag == "br":
                    self._break(1)
                elif tag == "hr":
                    self._break()
                    self.out.append("---")
                    self._break()
            return
        if self.skip or tag in self.SKIP or "hidden" in a and not a.get("id", "").startswith("S:") or "display:none" in a.get("style", "").replace(" ", ""):
            self.skip.append(tag)
        elif re.fullmatch("h[1-6]", tag):
            self._break()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self._break(1)
            self.out.append("  " * max(0, len(self.lists) - 1) + ("1. " if self.lists[-1:] == ["ol"] else "- "))
        elif tag == "a":
            self.links.append((len(self.out), a.get("href", "")))
        elif tag in self.BLOCK:
            self._break(1 if tag in ("ul", "ol") and self.lists else 2)
            if tag in ("ul", "ol"):
                self.lists.append(tag)

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            text = "".join(self.out[at:])
            label = " ".join(text.split())
            target = resolve_url(self.base, href) if href and not href.lower().startswith(("javascript:", "#")) else None
            if href.lower().startswith(("tel:", "mailto:")):
                target = href
            self.out[at:] = [f"[{label}]({target})" if target and label else text]
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCK:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self._break()

    def handle_data(self, data):
        if not self.skip and (text := re.sub(r"\s+", " ", data)):
            last = self.out[-1][-1:] if self.out else "\n"
            self.out.append(text.lstrip() if last in ("\n", " ", "") else text)


def to_markdown(html: str, url: str) -> str:
    p = _Markdown(url)
    p.feed(html)
    p.close()
    return "".join(p.out).strip()[:MARKDOWN_CHARS]


def business_facts(blocks: list[str]) -> dict[str, list[str]]:
    """Names, phones, mails, addresses, profiles, logos and descriptions of businesses in JSON-LD blocks."""
    out: dict[str, list[str]] = {k: [] for k in ("names", "telephones", "emails", "addresses", "same_as", "logos", "descriptions")}

    def add(key, *values):
        for v in values:
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, str) and (text := " ".join(x.split())) and text not in out[key] and len(out[key]) < 20:
                    out[key].append(text[:500])

    def address(v):
        if not isinstance(v, dict):
            return v
        country = v.get("addressCountry")
        parts = [v.get(k) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")] + [country.get("name") if isinstance(country, dict) else country]
        return ", ".join(dict.fromkeys(" ".join(p.split()) for p in parts if isinstance(p, str) and p.strip()))

    def walk(v, depth=0):
        if depth > 8:
            return
        if isinstance(v, list):
            for x in v[:100]:
                walk(x, depth + 1)
        elif isinstance(v, dict):
            kinds = v.get("@type") if isinstance(v.get("@type"), list) else [v.get("@type")]
            short = [re.split("[/:#]", k.strip())[-1].lower() for k in kinds if isinstance(k, str)]
            if any(k in BUSINESS or k.endswith(BUSINESS_ENDINGS) for k in short) or "telephone" in v or "address" in v:
                add("names", v.get("name"))
                add("telephones", v.get("telephone"))
                add("emails", *[e.removeprefix("mailto:").lower() for e in (v.get("email") if isinstance(v.get("email"), list) else [v.get("email")]) if isinstance(e, str)])
                add("descriptions", v.get("description"))
                add("addresses", *map(address, v["address"] if isinstance(v.get("address"), list) else [v.get("address")]))
                add("same_as", v.get("sameAs"))
                add("logos", v["logo"].get("url") if isinstance(v.get("logo"), dict) else v.get("logo"))
            for x in v.values():
                if isinstance(x, (dict, list)):
                    walk(x, depth + 1)

    for b in blocks:
        try:
            walk(json.loads(b))
        except (ValueError, RecursionError):
            continue
    return out


# Words that make a logo one of many, and not the site's own.
OTHER_LOGOS = set("partner partners client clients sponsor sponsors customer customers carousel slider slick swiper marquee brands affiliate affiliates trusted featured".split())


def _own_logo(value: str) -> bool:
    said = set(_words(value.replace("-", " ")))
    return "logo" in said and not said & OTHER_LOGOS


class _Head(HTMLParser):
    """What a page says about itself: head fields, style sheets, icons, links and candidates for its logo."""

    def __init__(self, url: str):
        super().__init__()
        self.url = self.base = url
        self.open: list[tuple[str, str]] = []
        self.fields: dict[str, str] = {}
        self.sheets, self.icons, self.fonts, self.logos, self.anchors = [], [], [], [], []
        self.label: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "").strip() for k, v in attrs}
        rel = a.get("rel", "").lower().split()
        target = resolve_url(self.base, a["href"]) if a.get("href") and len(a["href"]) <= 4096 else None
        if tag == "base" and target and self.base == self.url:
            self.base = target
        elif tag == "meta":
            name = (a.get("name") or a.get("property", "")).lower()
            key = {"description": "description", "og:description": "description", "og:site_name": "site_name", "theme-color": "theme_color", "og:image": "image"}.get(name)
            if key and a.get("content"):
                self.fields.setdefault(key, " ".join(a["content"].split()))
        elif tag == "link" and target:
            if "stylesheet" in rel:
                (self.fonts if de.google_fonts(target) else self.sheets).append(target)
            elif "icon" in rel or "apple-touch-icon" in rel:
                self.icons.append(target)
        elif tag == "a":
            self.label = [a.get("aria-label") or a.get("title", "")]
            self.anchors.append([target, self.label])
        elif tag == "img" and (src := resolve_url(self.base, a.get("src") or a.get("data-src", ""))):
            if self.label is not None and a.get("alt"):
                self.label.append(a["alt"])
            path = urlsplit(src).path
            said = " ".join(a.get(k, "") for k in ("class", "id", "alt", "title", "aria-label"))
            around = [x for _, x in self.open[-3:]]
            # Whatever calls it another's logo, in the image, its path or around it, outweighs a file that is named logo.
            others = any(set(_words(x)) & OTHER_LOGOS for x in (said, path, *around))
            if not others and any(_own_logo(x) for x in (said, path.rpartition("/")[2], *around)):
                home = any(t == "a" and x.startswith("home ") for t, x in self.open)
                header = any(t in ("header", "nav") for t, _ in self.open)
                self.logos.append((0 if header or home else 1, 0 if home else 1, len(self.logos), src))
        if tag not in ("img", "meta", "link", "br", "input", "hr", "base", "source", "wbr", "area"):
            is_home = tag == "a" and target and urlsplit(target).path == "/" and urlsplit(target).netloc == urlsplit(self.base).netloc
            self.open.append((tag, ("home " if is_home else "") + " ".join(a.get(k, "") for k in ("class", "id", "aria-label", "title"))))

    def handle_endtag(self, tag):
        if tag == "a":
            self.label = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.label is not None:
            self.label.insert(0, data)


def head_facts(html: str, url: str) -> dict:
    """description, site_name, theme_color, image; stylesheets, font families, icons, logos (best first), anchors."""
    p = _Head(url)
    p.feed(html)
    p.close()
    seen: dict[str, str] = {}
    for target, label in p.anchors:
        if target:
            seen.setdefault(target, " ".join(next((x for x in map(str.strip, label) if x), "").split()))
    logos = list(dict.fromkeys(src for *_, src in sorted(p.logos)))[:12]
    return {**{k: p.fields.get(k) for k in ("description", "site_name", "theme_color", "image")}, "stylesheets": list(dict.fromkeys(p.sheets)), "web_fonts": sorted({f for u in p.fonts for f in de.google_fonts(u)}), "icons": list(dict.fromkeys(p.icons)), "logos": logos, "anchors": [{"url": u, "text": t} for u, t in list(seen.items())[:400]]}


HEAD = "description string, site_name string, theme_color string, image string, stylesheets array<string>, web_fonts array<string>, icons array<string>, logos array<string>, anchors array<struct<url:string,text:string>>"
PAGE_DOC = "site string, url string, kind string, title string, markdown string, word_count int, is_js_shell boolean, " + co.CONTACTS + ", facts map<string,array<string>>, colors array<struct<hex:string,count:int>>, fonts array<struct<family:string,roles:array<string>,weights:array<int>>>, " + HEAD


def page_documents(pages: DataFrame) -> DataFrame:
    """A row of PAGE_DOC for each of pages(site, url, kind, html)."""

    def one(site, url, kind, html):
        from ..sources.html import parse_html

        html = html or ""
        row, text = parse_html(html, url), to_markdown(html, url)
        hrefs = " ".join(re.findall(r"(?i)href\s*=\s*[\"']([^\"']+)", html))
        styles = "\n".join(html[a:b] for _, a, b, _ in scan.elements(STYLE, STYLE_END, html)) + "\n".join(f"x{{{s}}}" for s in re.findall(r"(?i)\sstyle\s*=\s*\"([^\"]*)\"", html))
        design = de.analyse(styles)
        n = row["word_count"]
        scripts = len(re.findall(r"(?i)<script", html))
        empty_root = any(ROOT.search(m[0]) and CLOSED.match(html, m.end()) for m in scan.tags(DIV, html))
        asks = any(ASKS.search(html, m.end(), (html.find("<", m.end()) + 1 or len(html) + 1) - 1) for m in scan.tags(NOSCRIPT, html))
        shell = n == 0 and not row["links"] or empty_root and n < 200 or asks and n < 120 or scripts > 0 and n < 40
        return {"site": site, "url": url, "kind": kind, "title": row["title"], "markdown": text, "word_count": n, "is_js_shell": bool(shell), **co.contacts_of("\n".join((text, hrefs, co.protected_emails(html)))), "facts": business_facts([s["raw_json"] for s in row["schemas"]]), **design, **head_facts(html, url)}

    def run(frames):
        from ..sources.html import pieces

        for f in frames:
            for part in pieces(f[["site", "url", "kind", "html"]], "html"):
                yield pd.DataFrame([one(*r) for r in part.itertuples(index=False)])

    from ..sources.html import spread

    return spread(pages).mapInPandas(run, PAGE_DOC)


def site_documents(documents: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """site, pages, contacts, colors and fonts: page documents put together, home page first.

    sheets(site, url, css) are style sheets. Contacts keep their first appearance, by page and place."""
    # Eight branches read these rows, and without a table each would parse every page again.
    documents = stage(documents, "documents")
    order = F.when(F.col("kind") == "home", 0).otherwise(1)
    base = documents.withColumn("o", F.struct(order.alias("o"), "url"))
    whole = base.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("o", "kind", "title", "markdown", "word_count"))).alias("p"), F.max("is_js_shell").alias("needs_rendering"))
    out = whole.select("site", F.transform("p", lambda x: F.struct(x["o"]["url"].alias("url"), x["kind"].alias("kind"), x["title"].alias("title"), x["markdown"].alias("markdown"), x["word_count"].alias("word_count"))).alias("pages"), "needs_rendering")
    for kind in ("phones", "emails", "whatsapp", "facebook", "instagram"):
        each = base.select("site", "o", F.posexplode(kind).alias("i", "value"))
        digits = F.regexp_replace("value", "[^0-9]", "")
        key = F.lower("value") if kind != "phones" else F.when(digits.startswith("880"), F.concat(F.lit("0"), F.regexp_replace(digits, "^8800*", ""))).otherwise(digits)
        once = each.withColumn("key", key).groupBy("site", "key").agg(F.min(F.struct("o", "i", "value")).alias("f"))
        out = out.join(once.groupBy("site").agg(F.slice(F.array_sort(F.collect_list("f")), 1, co.MOST).alias("f")).select("site", F.transform("f", lambda x: x["value"]).alias(kind)), "site", "left")
    design = documents.select("site", "colors", "fonts")
    if sheets is not None:

        def read(frames):
            for f in frames:
                yield pd.DataFrame([{"site": s, **de.analyse(c or "")} for s, c in zip(f["site"], f["css"])], columns=["site", "colors", "fonts"])

        design = design.unionByName(sheets.mapInPandas(read, "site string, colors array<struct<hex:string,count:int>>, fonts array<struct<family:string,roles:array<string>,weights:array<int>>>"))
    return out.join(color_shares(design.select("site", F.explode("colors").alias("c")).select("site", "c.*")), "site", "left").join(font_table(design), "site", "left")


def color_shares(colors: DataFrame, most: int = MAX_COLORS) -> DataFrame:
    """site, colors: code, count and share (four decimals) of the most used, from colors(site, hex, count)."""
    sums = colors.groupBy("site", "hex").agg(F.sum("count").alias("count"))
    share = sums.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("site")), 4))
    top = share.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("count"), "hex"))).filter(F.col("r") <= most)
    return top.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("r", "hex", "count", "share"))).alias("colors"))


def font_table(design: DataFrame, most: int = MAX_FONTS) -> DataFrame:
    each = design.select("site", F.explode("fonts").alias("f")).select("site", "f.*")
    one = each.groupBy("site", "family").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("roles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("weights")))).alias("weights"))
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy(F.size("roles") == 0, "family"))).filter(F.col("r") <= most)
    return ranked.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("r", "family", "roles", "weights"))).alias("fonts"))
