"""JSON-LD blocks as variants: found, parsed and walked level by level in SQL functions, without Python workers.

A level is one lateral `variant_explode` of all values that are open, staged while anything is left: lists open
into their items, an object with a list under @graph into that list's. What the rules ask of a block
is answered by joins of the nodes met. Gives what jsonld.py gives a value at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .jsonld import ARTICLES, AUDIT_FIELDS, DATE_FIELDS, ELIGIBLE, ISO, ORGANISATIONS

def _member(value: str, name: str) -> Column:
    """A member as a variant; null only if there is none."""
    return F.expr(f"""try_variant_get({value}, '$["{name}"]', 'variant')""")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def blocks(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """*keep, block (its place on the page from 0) and raw: the JSON-LD scripts of pages that are closed.

    A page is cut at the ends of scripts; what follows the first start of a script in a piece is its text."""
    pieces = pages.select(*keep, F.posexplode(F.split(html, r"(?i)</script\s*>")).alias("block", "piece"))
    opened = r"(?is)^.*?<script(\s[^<>]*)?>"
    of = F.regexp_extract("piece", r"(?is)<script(\s[^<>]*)?>", 1)
    cut = pieces.filter(F.contains(F.lower("piece"), F.lit("ld+json"))).select(*keep, "block", of.alias("attributes"), F.regexp_replace("piece", opened, "").alias("raw"))
    last = F.max(F.size(F.split(html, r"(?i)</script\s*>")) - 1)
    ends = pages.groupBy(*keep).agg(last.alias("unclosed"))
    typed = F.col("attributes").rlike(r"""(?i)\stype\s*=\s*["']?\s*application/ld\+json""")
    return cut.filter(typed).join(ends, [*keep]).filter(F.col("block") < F.col("unclosed")).drop("attributes", "unclosed")


def parsed(raws: DataFrame) -> DataFrame:
    """raws, staged, with raw trimmed and v, a variant or null; blank ones go. A block must be one JSON value and nothing else;
    of members of one name the last counts."""
    key, conf = "spark.sql.variant.allowDuplicateKeys", raws.sparkSession.conf
    before = conf.get(key)
    try:
        conf.set(key, "true")
        out = raws.withColumn("raw", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).filter("raw <> ''")
        # Read within a list that ends with the text's own digest: what follows a value would stand between, or end the list before it.
        out = out.withColumn("v", F.try_parse_json(F.concat(F.lit("["), "raw", F.lit(',"'), F.md5("raw"), F.lit('"]'))))
        alone = F.expr("try_variant_get(v, '$[1]', 'string') = md5(raw)")
        return stage(out.withColumn("v", F.when(alone, F.expr("try_variant_get(v, '$[0]', 'variant')"))), "parsed")
    finally:
        conf.set(key, before)


def _levels(seeds: DataFrame, keep: list[str], opened: Column) -> list[DataFrame]:
    """All levels of values from seeds(*keep, path, v) on, staged. opened: the value whose items are the next level, or null."""
    spark, out = seeds.sparkSession, []
    level = stage(seeds.select(*keep, "path", "v"), "level")
    while not level.isEmpty():
        out.append(level)
        inner = level.withColumn("open", opened).filter("open IS NOT NULL").lateralJoin(spark.tvf.variant_explode(F.col("open").outer()))
        level = stage(inner.select(*keep, F.concat("path", F.array("pos")).alias("path"), F.col("value").alias("v")), "level")
    return out


def _union(levels: list[DataFrame], empty: DataFrame) -> DataFrame:
    for level in levels:
        empty = empty.unionByName(level)
    return empty


def nodes(values: DataFrame, keep: list[str]) -> DataFrame:
    """*keep, path, v and is_graph of the objects at the top of values(*keep, v), in lists and in @graph lists; paths are in order of appearance."""
    graph = _member("v", "@graph")
    seeds = values.select(*keep, F.array().cast("array<int>").alias("path"), "v").filter("v IS NOT NULL")
    levels = _levels(seeds, keep, F.when(_is(F.col("v"), "ARRAY"), F.col("v")).when(_is(graph, "ARRAY"), graph))
    return _union(levels, seeds.limit(0)).filter(_is(F.col("v"), "OBJECT")).withColumn("is_graph", _is(graph, "ARRAY"))


def records(values: DataFrame, keep: list[str], met: DataFrame | None = None) -> DataFrame:
    """*keep, path, schema_type, raw_json, is_valid_json, is_google_eligible: a row for each typed node of parsed values, one
    of type InvalidJson for a value that can't be read."""
    met = nodes(values, keep) if met is None else met
    kind, first = _member("v", "@type"), F.expr("""try_variant_get(v, '$["@type"][0]', 'variant')""")
    text = F.when(_is(kind, "STRING"), kind.try_cast("string")).when(_is(first, "STRING"), first.try_cast("string")).otherwise(F.lit("Unknown"))
    typed = met.filter(~F.col("is_graph") & kind.isNotNull()).select(*keep, "path", text.alias("schema_type"))
    good = values.filter("v IS NOT NULL").select(*keep, "raw").join(typed, keep).withColumn("is_valid_json", F.lit(True))
    bad = values.filter("v IS NULL").select(*keep, "raw", F.array().cast("array<int>").alias("path"), F.lit("InvalidJson").alias("schema_type"), F.lit(False).alias("is_valid_json"))
    out = good.unionByName(bad).withColumn("is_google_eligible", F.lower("schema_type").isin(ELIGIBLE))
    return out.select(*keep, "path", "schema_type", F.col("raw").alias("raw_json"), "is_valid_json", "is_google_eligible")


def bad_dates(values: DataFrame, keep: list[str]) -> DataFrame:
    """*keep, bad_dates: date fields at any depth whose text isn't an ISO date; values without any have no row."""
    spark = values.sparkSession
    date = F.coalesce(F.lower("key").isin(DATE_FIELDS), F.lit(False)) & _is(F.col("v"), "STRING")
    level, found = stage(values.filter("v IS NOT NULL").select(*keep, "v"), "deep"), None
    while not level.isEmpty():
        inner = level.filter(_is(F.col("v"), "ARRAY") | _is(F.col("v"), "OBJECT")).withColumnRenamed("v", "open").lateralJoin(spark.tvf.variant_explode(F.col("open").outer()))
        inner = stage(inner.select(*keep, "key", F.col("value").alias("v")), "deep")
        wrong = inner.filter(date & ~F.regexp_replace(F.col("v").try_cast("string"), r"(?U)^\s+|\s+$", "").rlike(f"(?s){ISO.pattern}")).select(*keep)
        found = wrong if found is None else found.unionByName(wrong)
        level = inner.filter(~date).drop("key")
    if found is None:
        found = values.limit(0).select(*keep)
    return found.groupBy(*keep).agg(F.count("*").alias("bad_dates"))


def audit(values: DataFrame, page: list[str], block: str = "block") -> DataFrame:
    """*page and AUDIT_FIELDS: the counts over a page's records that the structured-data rules read."""
    keep = [*page, block]
    met = stage(nodes(values, keep), "nodes")
    seen = records(values, keep, met)
    any_ = lambda name: F.max(_member("v", name).isNotNull())
    top = met.groupBy(*keep).agg(*[any_(n).alias(n) for n in ("price", "offers", "availability", "author", "creator", "datePublished", "dateCreated")])
    offers = met.select(*keep, _member("v", "offers").alias("v")).filter("v IS NOT NULL")
    inner = nodes(offers, keep).groupBy(*keep).agg(any_("price").alias("inner_price"), any_("lowPrice").alias("inner_low"), any_("availability").alias("inner_availability"))
    facts = seen.join(top, keep, "left").join(inner, keep, "left").join(bad_dates(values, keep), keep, "left")
    kind, valid = F.lower("schema_type"), F.col("is_valid_json")
    has = lambda *names: F.greatest(*[F.coalesce(n, F.lit(False)) for n in names], F.lit(False))
    product, article = valid & (kind == "product"), valid & kind.isin(ARTICLES)
    counted = {
        "n_schema_invalid": ~valid, "n_schema_incomplete": F.lit(False), "n_products": kind == "product", "n_products_valid": product,
        "n_products_no_offer": product & ~has("offers", "price", "inner_price", "inner_low"), "n_products_no_availability": product & ~has("availability", "inner_availability"),
        "n_articles_valid": article, "n_articles_no_author": article & ~has("author", "creator"), "n_articles_no_date": article & ~has("datePublished", "dateCreated"),
        "n_organisations": valid & kind.isin(ORGANISATIONS),
    }
    sums = {n: F.count_if(c) for n, c in counted.items()} | {"n_schema_bad_dates": F.sum(F.coalesce("bad_dates", F.lit(0)))}
    return facts.groupBy(*page).agg(*[sums[n].cast("int").alias(n) for n in AUDIT_FIELDS])
