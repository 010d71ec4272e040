"""What a page is for: a table of weighted signals over six archetypes, and a soft-max over their sums.

facts() makes one flat row of a page; each signal is a test of that row; classify() adds up what holds."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right

from ..functions import scan

ARCHETYPES = ("standard", "product", "article", "category", "contact", "homepage")

# Patterns of prices, calls to action and other marks of a page's kind.
_MONEY = r"[\$€£৳₹¥₩₽₪₫฿₴₸₺元円]|CHF|USD|EUR|GBP|BDT|CAD|AUD|JPY|CNY|INR|RUB|SAR|AED|EGP|TRY|BRL|PLN"
SCRIPT, SCRIPT_END = re.compile(r"(?i)<(?:script|style)[^>]*>"), re.compile(r"(?i)</(?:script|style)>")
ROW, ROW_END = re.compile(r"(?i)<tr\b[^>]*>"), re.compile(r"(?i)</tr>")
TERM = re.compile(r"(?i)<dt\b[^>]*>")
INPUT, QUANTITY = re.compile(r"(?i)<input"), re.compile(r"(?i)name=[\"']?(?:qty|quantity)[\"']?|type=[\"']?number[\"']?")
CALL = re.compile(
    r"(?i)(?:add\s+to\s+(?:cart|bag)|buy\s+now|order\s+now|purchase|in\s+den\s+warenkorb|in\s+den\s+einkaufswagen|jetzt\s+kaufen|ajouter\s+au\s+panier|acheter|añadir\s+a\s+la\s+cesta|agregar\s+al\s+carrito|comprar\s+ya"
    r"|aggiungi\s+al\s+carrello|acquista\s+ora|in\s+winkelwagen|bestel\s+nu|в\s+корзину|купить|কার্টে\s+যোগ\s+করুন|এখনই\s+কিনুন|カートに入れる|今すぐ購入|加入购物车|立即购买|أضف\s+إلى\s+السلة|اشتري\s+الآن)"
)
STOCK = re.compile(r"(?i)\b(?:in\s+stock|out\s+of\s+stock|auf\s+lager|nicht\s+auf\s+lager|en\s+stock|épuisé|disponible|agotado|disponibile|op\s+voorraad|в\s+наличии|স্টকে\s+আছে|在庫あり|有现货|متوفر)\b")
BYLINE = re.compile(r"(?i)(?:by|written\s+by|author|von|par|por|автор|লেখক|著者|作者)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})")
DATED = re.compile(r"(?i)(?:published|updated|posted|veröffentlicht|publié|publicado|опубликовано|প্রকাশিত)\s*+(?:(?:on|le|am|el)\s*+)?(?:[A-Za-z]{1,40}+ \d{1,2},? \d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})")
FORM, FORM_END = re.compile(r"(?i)<form[^>]*>"), re.compile(r"(?i)</form>")
ASKED = re.compile(r"(?i)name=[\"']?(?:email|message|subject|contact)[\"']?|type=[\"']?email[\"']?|<textarea")
PAGES = re.compile(r"(?i)rel=[\"']?(?:next|prev)[\"']?|class=[\"'](?=[^\"']*+[\"'])[^\"']*(?:pagination|page-numbers|page-link)|\bpage=\d+|\bp=\d+")
FORM_SIZE = 2500
STOPWORDS = set("and or the a an of in for with to at by from on und der die das et le la les y el".split())
NEAR = 1800


def _tokens(text: str) -> set[str]:
    """Words of two letters or more, and the parts of words that mix letters and digits."""
    out = set()
    for w in re.findall(r"[^\W_]+", text.lower()):
        parts = re.findall(r"[0-9]+|[^0-9]+", w)
        out.update(x for x in [w, *(parts if len(parts) > 1 else [])] if len(x.encode()) >= 2 and x not in STOPWORDS)
    return out


def slug_overlap(url: str, h1: str | None) -> tuple[int, float]:
    """Number of tokens in a URL's last segment, and the share of them in the headline."""
    segments = [s for s in re.sub(r"^[a-z]+://[^/?#]*|[?#].*$", "", url, flags=re.I).split("/") if s]
    if segments and segments[-1].lower() in ("index.html", "index.php", "index.htm"):
        segments.pop()
    slug = _tokens(segments[-1].rpartition(".")[0] or segments[-1]) if segments else set()
    if len(slug) < 3 or not h1 or not (head := _tokens(h1)):
        return len(slug), 0.0
    return len(slug), len(slug & head) / len(slug)


def long_runs(html: str, least: int = 120) -> int:
    """Stretches between tags with so many characters that aren't white space."""
    last = html.rfind(">") + 1
    return sum(len(x) >= least and len("".join(re.sub(r"^[^<]*>", "", x).split())) >= least for x in re.split("<", re.sub(r"<[^>]*>", "<", html[:last]) + html[last:]))


#: What a text that a pattern matches holds for certain, in lower case: looked for first, as that is far quicker.
HINTS = {
    _MONEY: [*"$€£৳₹¥₩₽₪₫฿₴₸₺元円", *"chf usd eur gbp bdt cad aud jpy cny inr rub sar aed egp try brl pln".split()],
    CALL: "add buy order purchase warenkorb einkaufswagen kaufen panier acheter cesta carrito comprar carrello acquista winkelwagen bestel корзину купить কার্টে এখনই カート 購入 购物车 购买 السلة اشتري".split(),
    STOCK: "stock lager épuisé disponible agotado disponibile voorraad наличии স্টকে 在庫 有现货 متوفر".split(),
    DATED: "published updated posted veröffentlicht publié publicado опубликовано প্রকাশিত".split(),
    PAGES: "rel= pagination page-numbers page-link page= p=".split(), INPUT: ["<input"],
}


def facts(page: dict, html: str, url: str, browser: dict | None = None) -> dict:
    """What the signals look at: one flat row of numbers and flags."""
    path = re.sub(r"^[a-z]+://[^/?#]*|[?#].*$", "", url, flags=re.I).lower()
    segment = set(re.findall(r"/([^/]+)(?=/)", path))
    shown = scan.without(SCRIPT, SCRIPT_END, html)
    low, size = html.lower(), max(1, len(shown.encode()))
    may = lambda pattern: any(hint in low for hint in HINTS[pattern])
    price = scan.prices(_MONEY, shown) if may(_MONEY) else []
    call = [m.start() for m in CALL.finditer(shown)] if may(CALL) else []
    quantity = scan.inputs(INPUT, QUANTITY, shown) if may(INPUT) else []
    together = lambda xs, ys: any(bisect_left(ys, x - NEAR) < bisect_right(ys, x + NEAR) for x in xs)
    rows = (shown[a:b] for _, a, b, _ in scan.elements(ROW, ROW_END, shown)) if "<tr" in low else ()
    pairs = sum(len(re.findall(r"(?i)</(?:td|th)>", row)) == 2 for row in rows)
    target = [x["target_url"].lower() for x in page["links"]]
    gap = price[1] - price[0] if len(price) > 1 else 0
    slug, overlap = slug_overlap(url, page["h1_primary"])
    seen = browser or {}
    return {
        "path": path, "root": path in ("", "/", "/index.html", "/index.php"),
        "product_path": bool(segment & PRODUCT_SEGMENTS), "category_path": bool(segment & CATEGORY_SEGMENTS), "article_path": bool(segment & ARTICLE_SEGMENTS),
        "contact_path": any(x in path for x in CONTACT_PATHS), "legal_path": path.startswith(DOCS_PATHS) or any(x in path for x in LEGAL_PATHS),
        "prices": len(price), "calls": len(call), "quantities": len(quantity), "cluster": together(price, call) and (not quantity or together(price, quantity)),
        "hero": gap > 0 and (price[0] / size <= 0.45 or price[0] <= 30_000) and (gap >= 3000 or gap / size >= 0.2),
        "matrix": pairs >= 5 or "<dt" in low and sum(1 for _ in scan.tags(TERM, shown)) >= 5, "stock": may(STOCK) and bool(STOCK.search(shown)),
        "whatsapp": any(mark in t for t in target for mark in ("wa.me/", "api.whatsapp.com/", "whatsapp://")),
        "asks": any(t.startswith("tel:") or "#contact" in t or "#quote" in t or "#inquir" in t and ("#inquiry" in t or "#inquire" in t) for t in target),
        "reachable": any(t.startswith(("tel:", "mailto:")) for t in target), "form": "<form" in low and scan.near(FORM, ASKED, FORM_END, html, FORM_SIZE),
        "kind": next((x["value"].lower() for x in page["open_graph"] if x["key"] == "og:type"), ""),
        "byline": bool(BYLINE.search(html)), "dated": "<time" in html or "datetime=" in html or may(DATED) and bool(DATED.search(html)),
        "article_tag": "<article" in html or 'role="article"' in html, "runs": long_runs(html), "words": page["word_count"],
        "slug": slug >= 3 and overlap >= 0.5, "links": len(target), "dense": page["word_count"] > 0 and len(target) / page["word_count"] > 0.28, "paged": may(PAGES) and bool(PAGES.search(html)),
        **{k: bool(seen.get(k)) for k in ("platform_pdp", "platform_plp", "hero_price_above_fold")}, "cards": seen.get("uniform_card_count", 0),
    }


# Path segments and parts that speak for a kind of page.
PRODUCT_SEGMENTS = set("product products item items p dp goods".split())
CATEGORY_SEGMENTS = set("category categories collection collections shop catalog store browse".split())
ARTICLE_SEGMENTS = set("blog news post posts article articles press".split())
CONTACT_PATHS = ("/contact", "/contact-us", "/contactus", "/reach-us", "/get-in-touch")
DOCS_PATHS = ("/docs", "/documentation")
LEGAL_PATHS = ("/privacy", "/terms", "/legal", "/changelog", "/license", "/faq")


def _narrative(f: dict) -> bool:
    return f["runs"] >= 3 and f["words"] > 300 or f["runs"] >= 1 and f["words"] > 250


def _told(f: dict) -> bool:
    """Whether something marks a narrative as an article."""
    return f["byline"] or f["dated"] or f["article_tag"] or f["article_path"] or "article" in f["kind"]


def _goods(f: dict) -> bool:
    return f["product_path"] or f["prices"] > 0 or f["matrix"]


#: (signal, when it holds, what it adds to Standard, Product, Article, Category, Kontakt and Home, and by C? what only
#: pages that aren't at a contact path get). Signals without a name add, but aren't reported. Weights are fixed values.
SIGNALS = [
    # address
    ("root_path", lambda f: f["root"], {"H": 14, "S": -8, "P": -8, "A": -10, "C": -6, "K": -8}),
    (None, lambda f: not f["root"], {"H": -8}),
    ("docs_or_legal_path", lambda f: f["legal_path"], {"S": 8, "A": -20, "P": -15, "C": -10, "K": -8}),
    ("url_product_token", lambda f: f["product_path"], {"P": 3.5, "C": -1}),
    ("url_category_token", lambda f: f["category_path"] and not f["product_path"], {"C": 6, "P": -6, "S": -2}),
    ("url_article_token", lambda f: f["article_path"], {"A": 4}),
    ("url_contact_token", lambda f: f["contact_path"], {"K": 6, "A": -6, "P": -6, "C": -8, "S": -3}),
    # declared type
    ("og_type_product", lambda f: "product" in f["kind"], {"P": 5.5, "A": -4, "S": -3}),
    ("og_type_article", lambda f: "article" in f["kind"] and "product" not in f["kind"], {"A": 5.5, "P": -4, "S": -3}),
    # commerce
    ("transactional_micro_cluster", lambda f: f["cluster"], {"P": 6, "A": -5, "C": -3, "S": -4}),
    ("quantity_input", lambda f: f["quantities"] > 0, {"P": 3.5, "A": -3}),
    ("action_button_with_price", lambda f: f["calls"] > 0 and f["prices"] > 0, {"P": 3.5, "A": -2}),
    ("hero_price_with_recommendations", lambda f: f["hero"], {"P": 4, "C": -2}),
    ("single_hero_price", lambda f: f["prices"] == 1, {"P": 2.5, "C": -1}),
    ("price_pattern", lambda f: f["prices"] > 1 and not f["hero"], {"P": 2, "C": 1}),
    ("dense_spec_matrix", lambda f: f["matrix"], {"P": 4.5, "C": -3.5, "A": -3}),
    ("availability_status", lambda f: f["stock"], {"P": 3.5, "A": -2}),
    ("protocol_whatsapp_inquiry", lambda f: f["whatsapp"], {"P": 4, "A": -2}),
    ("protocol_tel_quote_inquiry", lambda f: f["asks"] and not f["whatsapp"] and _goods(f), {"P": 4, "A": -2}),
    # prose
    ("byline_author", lambda f: f["byline"], {"A": 3.5}),
    ("publication_date", lambda f: f["dated"], {"A": 3.5}),
    ("continuous_narrative_runs", lambda f: _narrative(f) and _told(f), {"A": 5.5, "P": -3, "C": -3.5, "S": -2}),
    (None, lambda f: _narrative(f) and not _told(f), {"S": 2.5, "A": 1}),
    ("encyclopedic_longform_text", lambda f: f["words"] > 1000 and f["runs"] >= 4 and f["prices"] <= 1, {"A": 6.5, "C": -6, "P": -5, "S": -3}),
    ("slug_h1_high_overlap", lambda f: f["slug"] and _goods(f), {"P": 4, "C": -4}),
    ("slug_h1_high_overlap", lambda f: f["slug"] and not _goods(f) and (f["article_path"] or f["byline"] or f["dated"]), {"A": 4, "C": -4}),
    # lists
    ("multi_price_catalog_grid", lambda f: f["prices"] >= 4 and f["links"] >= 8 and not f["hero"], {"A": -6, "C?": 6, "P": -6, "S": -3}),
    ("listing_link_density", lambda f: f["dense"] and f["links"] >= 6, {"C?": 3.5, "A": -3, "S": -2}),
    ("pagination_controls", lambda f: f["paged"] and f["links"] >= 6, {"C?": 4, "P": -3, "S": -2}),
    # contact
    ("tel_or_mailto", lambda f: f["reachable"], {"K": 3.5}),
    ("contact_form", lambda f: f["form"], {"K": 5.5, "P": -3, "A": -4, "S": -3}),
    # a browser
    ("cdp_runtime_platform_pdp", lambda f: f["platform_pdp"], {"P": 8, "A": -6, "C": -5, "S": -4}),
    ("cdp_runtime_platform_plp", lambda f: f["platform_plp"], {"C": 8, "P": -6, "A": -6, "S": -4}),
    ("cdp_visual_hero_price_above_fold", lambda f: f["hero_price_above_fold"], {"P": 4.5, "A": -3}),
    ("cdp_visual_grid_uniformity", lambda f: f["cards"] >= 4, {"C": 5, "P": -4, "A": -4}),
]
START = {"S": 1.5}


def classify(page: dict, html: str, url: str, browser: dict | None = None) -> dict:
    """archetype, confidence and signals of a parsed page; browser: signals of a rendered one."""
    f = facts(page, html, url, browser)
    held = [(name, weights) for name, test, weights in SIGNALS if test(f)]
    score = dict.fromkeys("SPACKH", 0.0) | START
    for _, weights in held:
        for kind, weight in weights.items():
            if len(kind) == 1 or not f["contact_path"]:
                score[kind[0]] += weight
    best = max(score, key=score.get)  # of equals the first archetype
    share = 1 / sum(math.exp(x - score[best]) for x in score.values())
    return {"archetype": ARCHETYPES["SPACKH".index(best)], "confidence": share, "signals": [name for name, _ in held if name]}
