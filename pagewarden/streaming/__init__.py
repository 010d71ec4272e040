"""Structured Streaming: pages in micro-batches, windows over events, rate control with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import page_rules as pr
from ..operators.catalog import rules_table
from ..operators.frontier import Controller
from ..sources import fetches as fe
from ..sources import html
from ..sources.storage import Store


def fetch_stream(spark: SparkSession, folder: str, files: int = 10) -> DataFrame:
    """Responses that arrive as Parquet files, so many files a batch."""
    return spark.readStream.schema(fe.SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def audit_stream(fetches: DataFrame) -> DataFrame:
    """Page findings of a stream of responses."""
    return pr.issues(html.features_of(html.parse_pages(fe.prepared(fetches))), "url")


def write_batches(issues: DataFrame, folder: str, checkpoint: str, every: str = "500 milliseconds"):
    """Appends findings to Parquet; the query's checkpoint makes each batch count once."""
    return issues.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def write_session(fetches: DataFrame, store: Store, session_id: str, checkpoint: str, every: str | None = None):
    """Pages, their children and page findings of a stream of responses go to a stored session, a version a batch.
    Without `every`, the query ends when all that is there has been read."""

    def derived(pages: DataFrame) -> dict[str, DataFrame]:
        rules = rules_table(pages.sparkSession)
        found = pr.findings(html.features_of(pages), "url").select("url", "code", F.lit(None).cast("string").alias("related"), F.lit("page").alias("phase"), "detail", F.col("url").alias("source_page_url"))
        return html.children(pages) | {"issues": pr.described(found, rules)}

    sink = store.sink(session_id, lambda df: {"pages": html.parse_pages(fe.prepared(df))}, derived)
    when = {"processingTime": every} if every else {"availableNow": True}
    return fetches.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**when).start()


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type and window; later than `late` they are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def control_stream(responses: DataFrame, concurrency: int = 10) -> DataFrame:
    """host, seq, delay_ms, concurrency after each of a stream of responses(host, seq, ttfb_ms, status_code).

    The state of a host is the controller's few numbers and its window of fifty responses."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Controller(concurrency)
        if state.exists:
            c.concurrency, c.delay, c.baseline, recent = state.get
            c.recent.extend(None if x < 0 else x for x in recent)
        out = []
        for seq, ms, status in pd.concat(list(frames)).sort_values("seq")[["seq", "ttfb_ms", "status_code"]].itertuples(index=False):
            c.record(None if pd.isna(ms) else int(ms), None if pd.isna(status) else int(status))
            out.append((key[0], seq, c.delay, c.concurrency))
        state.update((c.concurrency, c.delay, c.baseline, [-1 if x is None else x for x in c.recent]))
        yield pd.DataFrame(out, columns=["host", "seq", "delay_ms", "concurrency"])

    return responses.groupBy("host").applyInPandasWithState(step, "host string, seq bigint, delay_ms int, concurrency int", "concurrency int, delay int, baseline int, recent array<int>", "append", GroupStateTimeout.NoTimeout)
