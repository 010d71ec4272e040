"""Crawl scheduling over tables: candidates, frontier by level, and the adaptive rate controller."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as ux
from ..functions.dialect import SPARK
from ..staging import stage

# Fixed values of the rate controller.
WINDOW, MAX_DELAY, STEP, ERRORS, LATENCY, FIRST_BASELINE, SLOW = 50, 10_000, 25, 0.08, 1.5, 200, 500


def candidates(links: DataFrame, pages: DataFrame, max_facets: int = 2, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """url, depth: where a crawl may go next, from links(source_url, target_url, is_internal) of pages(url, canonical_url, crawl_depth)."""
    own = pages.select(F.col("url").alias("source_url"), "canonical_url", "crawl_depth")
    out = links.filter("is_internal").join(own, "source_url")
    # A page that names another as its canonical doesn't speak for its links to itself.
    out = out.filter("canonical_url IS NULL OR target_url <> source_url OR canonical_url = source_url")
    out = out.filter(f"NOT {ux.is_asset(SPARK, 'target_url')} AND {ux.sorting_facets(SPARK, 'target_url')} = 0")
    if max_facets:
        out = out.filter(f"{ux.content_facets(SPARK, 'target_url')} <= {int(max_facets)}")
    if include:
        out = out.filter(F.col("target_url").rlike(include))
    if exclude:
        out = out.filter(~F.col("target_url").rlike(exclude))
    return out.groupBy(F.col("target_url").alias("url")).agg((F.min("crawl_depth") + 1).alias("depth"), F.count("*").alias("in_degree"))


def prioritised(frontier: DataFrame, limit: int | None = None) -> DataFrame:
    """frontier(url, depth, in_degree, is_seed) in the order in which it is fetched."""
    out = frontier.withColumn("priority", F.expr(ux.importance(SPARK, "url", "depth", "in_degree", "is_seed"))).orderBy(F.desc("priority"), "depth", "url")
    return out.limit(limit) if limit else out


def crawl(fetches: DataFrame, links: DataFrame, seeds: DataFrame, max_depth: int = 0, max_pages: int = 0, allowed: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Which URLs of a table of responses a crawl would reach, by breadth: url, depth; and whether it saw all.

    fetches(url), links(source_url, target_url, is_internal), seeds(url), allowed(url) by robots. A level is one
    join and one anti join over staged tables."""
    edges = stage(links.filter("is_internal").select("source_url", F.col("target_url").alias("url")).distinct(), "edges")
    pages = fetches.select("url").distinct()
    if allowed is not None:
        pages = pages.join(allowed.select("url").distinct(), "url", "left_semi")
    pages = stage(pages, "pages")
    level = stage(seeds.select("url").distinct().join(pages, "url", "left_semi").withColumn("depth", F.lit(0)), "level")
    seen, depth, whole = level, 0, True
    while True:
        n = seen.count()
        if max_pages and n >= max_pages:
            return seen.orderBy("depth", "url").limit(max_pages), False
        next_ = edges.join(level.select(F.col("url").alias("source_url")), "source_url").select("url").distinct().join(pages, "url", "left_semi").join(seen, "url", "left_anti")
        next_ = stage(next_.withColumn("depth", F.lit(depth + 1)), "level")
        if not next_.limit(1).count():
            return seen, whole
        if max_depth and depth >= max_depth:
            return seen, False
        seen, level, depth = stage(seen.unionByName(next_), "seen"), next_, depth + 1


class Controller:
    """Additive increase, multiplicative decrease of a host's crawl rate, over the last WINDOW responses."""

    def __init__(self, concurrency: int = 10, delay: int = 0):
        self.most = self.concurrency = max(1, concurrency)
        self.delay = self.floor = delay
        self.baseline = FIRST_BASELINE
        self.recent: deque[int | None] = deque(maxlen=WINDOW)  # milliseconds, None for a failure

    def p95(self) -> int:
        s = sorted(x for x in self.recent if x is not None)
        return s[max(0, math.ceil(0.95 * len(s)) - 1)] if s else 0

    def error_rate(self) -> float:
        return sum(x is None for x in self.recent) / len(self.recent) if self.recent else 0.0

    def success(self, ms: int) -> None:
        """Recovers only while the window holds no failure and is fast and steady."""
        self.recent.append(ms)
        self.baseline = (9 * self.baseline + ms) // 10 if self.baseline else ms
        p95 = self.p95()
        if self.error_rate() == 0 and p95 < SLOW and p95 <= LATENCY * self.baseline:
            self.delay = max(self.floor, self.delay - STEP)
            self.concurrency = min(self.most, self.concurrency + 1)

    def failure(self, status: int | None = None) -> None:
        """Backs off on rate limits and server errors, and on others where too many of the window failed."""
        self.recent.append(None)
        if status == 429 or status in range(500, 505) or self.error_rate() > ERRORS:
            self.delay = min(MAX_DELAY, 2 * self.delay or 100)
            self.concurrency = max(1, self.concurrency // 2)

    def record(self, ms: int | None, status: int | None) -> None:
        if status is None or status == 429 or status >= 500 or status == 0:
            self.failure(status)
        else:
            self.success(ms or 0)


def control(responses: DataFrame, concurrency: int = 10) -> DataFrame:
    """host, seq, delay_ms, concurrency after each of responses(host, seq, ttfb_ms, status_code); a null status is a failure.

    The state is a fold, so a host's responses are read in order within one task; a host has as many as were fetched from it."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        c, out = Controller(concurrency), []
        for host, seq, ms, status in frame.sort_values("seq")[["host", "seq", "ttfb_ms", "status_code"]].itertuples(index=False):
            c.record(None if pd.isna(ms) else int(ms), None if pd.isna(status) else int(status))
            out.append((host, seq, c.delay, c.concurrency))
        return pd.DataFrame(out, columns=["host", "seq", "delay_ms", "concurrency"])

    return responses.groupBy("host").applyInPandas(fold, "host string, seq bigint, delay_ms int, concurrency int")
