"""Health score, TTFB figures, indexability and other report expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Severity weights, scale and cap of a category; reason phrases of HTTP.
WEIGHTS = {1: 5.0, 2: 2.0, 3: 0.5, 4: 0.0}
SCALE, CAP = 10.0, 35.0
REASONS = {
    200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout", 410: "Gone", 429: "Too Many Requests",
    500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}


def _weight() -> str:
    return "CASE severity " + " ".join(f"WHEN {s} THEN {w}" for s, w in WEIGHTS.items()) + " ELSE 0.0 END"


def health_score(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """score of a site from issues(category, severity) and pages(n): 100 less each category's capped penalty."""
    sums = issues.groupBy("category").agg(F.sum(F.expr(_weight()).cast("double")).alias("w"))
    both = sums.crossJoin(F.broadcast(pages))  # pages: one row
    penalty = F.when(F.col("n") > 0, F.least(F.lit(SCALE) * F.col("w") / F.col("n"), F.lit(CAP))).otherwise(0.0)
    return both.agg(F.coalesce(F.sum(penalty), F.lit(0.0)).alias("p")).select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("p")))).cast("int").alias("score"))


def health_sql(issues: str, pages: str) -> str:
    return f"""SELECT CAST(round(greatest(0.0, least(100.0, 100 - coalesce(sum(CASE WHEN n > 0 THEN least({SCALE} * w / n, {CAP}) ELSE 0.0 END), 0.0)))) AS INT) AS score
        FROM (SELECT category, sum(CAST({_weight()} AS DOUBLE)) AS w FROM {issues} AS i GROUP BY category) AS c CROSS JOIN {pages} AS p"""


def ttfb_summary(times: DataFrame) -> DataFrame:
    """average (whole) and p95, the value at round(0.95 n) in order, of times(ttfb_ms).

    Values are counted first: as many rows as distinct milliseconds meet in the window."""
    counts = times.groupBy("ttfb_ms").agg(F.count("*").alias("n"))
    up = counts.withColumn("to", F.sum("n").over(Window.orderBy("ttfb_ms").rowsBetween(Window.unboundedPreceding, 0)))
    whole = counts.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("ttfb_ms")).alias("sum"))
    place = F.least(F.col("all") - 1, F.round(F.col("all") * 0.95).cast("long"))
    hit = up.crossJoin(F.broadcast(whole)).filter(F.col("to") > place)  # whole: one row
    return hit.groupBy("all", "sum").agg(F.min("ttfb_ms").cast("long").alias("p95")).select(F.expr("sum div all").cast("long").alias("average"), "p95")


def status_reason(s: str) -> str:
    """Phrase of a status, or its class."""
    known = " ".join(f"WHEN {c} THEN '{t}'" for c, t in REASONS.items())
    return f"CASE {s} {known} ELSE CASE WHEN {s} BETWEEN 200 AND 299 THEN 'Success' WHEN {s} BETWEEN 300 AND 399 THEN 'Redirection' WHEN {s} BETWEEN 400 AND 499 THEN 'Client Error' WHEN {s} BETWEEN 500 AND 599 THEN 'Server Error' ELSE 'Unknown' END END"


def indexability(status: str, flags: str, canonical: str, url: str, d) -> str:
    bare = lambda x: f"lower({d.rep(x, '/+$')})"
    return f"CASE WHEN {status} NOT BETWEEN 200 AND 299 THEN 'Non-Indexable: status' WHEN ({d.bits(flags, 1)}) <> 0 THEN 'Non-Indexable: noindex' WHEN {canonical} IS NOT NULL AND {bare(canonical)} <> {bare(url)} THEN 'Non-Indexable: canonicalised' ELSE 'Indexable' END"


def csv_guard(d, x: str) -> str:
    """A cell that a spreadsheet would run as a formula gets an apostrophe in front."""
    risky = d.has(x, r"^[\x20\x09-\x0D]*[=+@-]|^[\x09\x0D]")
    return f"CASE WHEN {risky} THEN concat({d.text(chr(39))}, {x}) ELSE {x} END"
