"""JSON-LD blocks: records, field checks, rich-result validation."""

from __future__ import annotations

import json
import re

# Schema types of rich results, date fields, and the types that page rules look for.
ELIGIBLE = "Article NewsArticle BlogPosting Product LocalBusiness Organization BreadcrumbList FAQPage HowTo Recipe Review Event Course JobPosting VideoObject".lower().split()
SUPPORTED = [*ELIGIBLE, "techarticle", "report", "website"]
DATE_FIELDS = "datePublished dateModified uploadDate priceValidUntil validFrom validThrough startDate endDate expires".lower().split()
ARTICLES = "article newsarticle blogposting techarticle report".split()
ORGANISATIONS = "organization localbusiness contactpage place".split()
AUDIT_FIELDS = "n_schema_invalid n_schema_incomplete n_schema_bad_dates n_products n_products_valid n_products_no_offer n_products_no_availability n_articles_valid n_articles_no_author n_articles_no_date n_organisations".split()
ISO = re.compile(r"^([1-9]\d{3})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?:[Tt ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d.*)?$", re.S)


def _refused(name: str):
    raise ValueError(f"{name} is no JSON")


def parse_json_ld(raw: str) -> list[dict]:
    """A record for each typed node of a block; one of type InvalidJson if it can't be read."""
    raw = raw.strip()
    if not raw:
        return []
    record = lambda kind, valid: {"schema_type": kind, "raw_json": raw, "is_valid_json": valid, "is_google_eligible": kind.lower() in ELIGIBLE}
    try:
        todo, out = [json.loads(raw, parse_constant=_refused)], []
    except (ValueError, RecursionError):
        return [record("InvalidJson", False)]
    while todo:
        node = todo.pop(0)
        if isinstance(node, list):
            todo[:0] = node
        elif isinstance(node, dict):
            if isinstance(node.get("@graph"), list):
                todo[:0] = node["@graph"]
            elif "@type" in node:
                kind = node["@type"]
                kind = kind[0] if isinstance(kind, list) and kind else kind
                out.append(record(kind if isinstance(kind, str) else "Unknown", True))
    return out


def _nodes(value):
    """Objects at the top of a value, in lists and in @graph lists."""
    todo = [value]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += node
        elif isinstance(node, dict):
            yield node
            if isinstance(node.get("@graph"), list):
                todo += node["@graph"]


def has_field(value, name: str) -> bool:
    return any(name in node for node in _nodes(value))


def has_nested(value, parent: str, name: str) -> bool:
    return any(has_field(node[parent], name) for node in _nodes(value) if parent in node)


def bad_dates(value) -> int:
    """Date fields, at any depth, whose text isn't an ISO date."""
    n, todo = 0, [value]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += node
        elif isinstance(node, dict):
            for k, v in node.items():
                if k.lower() in DATE_FIELDS and isinstance(v, str):
                    n += not ISO.match(v.strip())
                elif isinstance(v, (dict, list)):
                    todo.append(v)
    return n


def audit_schemas(records: list[dict]) -> dict[str, int]:
    """Counts over a page's records that the structured-data rules read."""
    out = dict.fromkeys(AUDIT_FIELDS, 0)
    for r in records:
        kind = r["schema_type"].lower()
        out["n_products"] += kind == "product"
        if not r["is_valid_json"]:
            out["n_schema_invalid"] += 1
            continue
        value = json.loads(r["raw_json"])
        out["n_schema_bad_dates"] += bad_dates(value)
        if kind == "product":
            out["n_products_valid"] += 1
            price = has_field(value, "price") or has_nested(value, "offers", "price") or has_nested(value, "offers", "lowPrice")
            out["n_products_no_offer"] += not (has_field(value, "offers") or price)
            out["n_products_no_availability"] += not (has_field(value, "availability") or has_nested(value, "offers", "availability"))
        elif kind in ARTICLES:
            out["n_articles_valid"] += 1
            out["n_articles_no_author"] += not (has_field(value, "author") or has_field(value, "creator"))
            out["n_articles_no_date"] += not (has_field(value, "datePublished") or has_field(value, "dateCreated"))
        out["n_organisations"] += kind in ORGANISATIONS
    return out


#: Required and recommended fields of the types that are validated in depth.
REQUIRED = {
    "product": (["name"], ["image", "description", "brand", "sku"]), "article": (["headline"], ["image", "datePublished", "author"]), "newsarticle": (["headline"], ["image", "datePublished", "author"]),
    "blogposting": (["headline"], ["image", "datePublished", "author"]), "faqpage": (["mainEntity"], []), "breadcrumblist": (["itemListElement"], []),
}


def validate(raw: str) -> dict:
    """Validity, type, eligibility and missing fields of a JSON-LD block, or of the blocks in a page."""
    blocks = re.findall(r"(?is)<script[^>]*type\s*=\s*[\"']?application/ld\+json[^>]*>(.*?)</script\s*>", raw)
    out = {"is_valid_json": False, "detected_type": None, "is_rich_result_eligible": False, "missing_required": [], "missing_recommended": [], "error": None}
    try:
        value = json.loads((blocks[0] if blocks else raw).strip())
    except ValueError as e:
        return out | {"error": str(e)}
    out["is_valid_json"] = True
    node = next((n for n in _nodes(value) if "@type" in n), None)
    if node is None:
        return out | {"error": "no @type"}
    kind = node["@type"][0] if isinstance(node["@type"], list) and node["@type"] else node["@type"]
    kind = kind if isinstance(kind, str) else "Unknown"
    must, may = REQUIRED.get(kind.lower(), ([], []))
    missing = [f for f in must if not node.get(f)]
    if kind.lower() == "product" and not any(node.get(f) for f in ("offers", "review", "aggregateRating")):
        missing.append("offers, review or aggregateRating")
    return out | {"detected_type": kind, "missing_required": missing, "missing_recommended": [f for f in may if not node.get(f)], "is_rich_result_eligible": kind.lower() in SUPPORTED and not missing}
