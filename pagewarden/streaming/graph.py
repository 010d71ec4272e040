"""Findings that need more than one page, over streams of pages: duplicates with state, broken links by a join of streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.graph_rules import duplicate_keys

#: State with time limits needs a store that knows them; set before a query with duplicates starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LOG = "code string, key string, url string, related string"


class _First(StatefulProcessor):
    """Keeps the first URL of a key, in order of URLs, and nothing else, however many share the key."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "url string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.first.get() if self.first.exists() else None
        first = before = held[0] if held else None
        for frame in rows:
            urls = frame["url"].drop_duplicates()
            least = urls.min()
            if first is None or least < first:
                moved, first = first, least
                urls = urls if moved is None else pd.concat([urls, pd.Series([moved])])
            found = urls[urls != first]
            if len(found):
                yield pd.DataFrame({"code": key[0], "key": key[1], "url": found.to_numpy(), "related": first})
        if first != before or self.ttl_ms:  # what is seen again lives on
            self.first.update((first,))

    def close(self) -> None:
        pass


def duplicate_log(pages: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """LOG rows: pages that share a title, a description or their content with one that sorts before, as far as is known when they come.

    A page that comes late and sorts before all others makes a duplicate of the one that was first, and the log
    says so then; duplicates() puts right what it said before. Without ttl_ms a key is kept for ever; with it, a key not
    seen for so long is forgotten and its next page starts anew. Pages of one key of a batch go to one task, a frame at a time."""
    pages.sparkSession.conf.set(*STORE)
    grouped = duplicate_keys(pages).groupBy("code", "key")
    return grouped.transformWithStateInPandas(_First(ttl_ms), LOG, "Append", "ProcessingTime" if ttl_ms else "None")


def duplicates(log: DataFrame) -> DataFrame:
    """url, code, related: the findings that a log amounts to, as the batch rules give them for all its pages."""
    first = log.groupBy("code", "key").agg(F.min("related").alias("related"))
    return log.select("code", "key", "url").distinct().join(first, ["code", "key"]).filter("url <> related").select("url", "code", "related")


def broken_links(pages: DataFrame, links: DataFrame, at: str = "fetched_at", within: str = "1 day", late: str = "1 hour") -> DataFrame:
    """source_url, target_url, anchor_text of internal links to pages that answer 404, whichever comes first.

    A link and its target's answer meet if they were seen within the interval `within` of one another; older ones leave the state."""
    gone = pages.filter("status_code = 404").select(F.col("url").alias("gone_url"), F.col(at).alias("gone_at")).withWatermark("gone_at", late)
    asked = links.filter("is_internal").select("source_url", "target_url", "anchor_text", F.col(at).alias("asked_at")).withWatermark("asked_at", late)
    near = F.expr(f"target_url = gone_url AND gone_at BETWEEN asked_at - INTERVAL {within} AND asked_at + INTERVAL {within}")
    return asked.join(gone, near).select("source_url", "target_url", "anchor_text")
