"""Audit sessions: atomic writes of all tables, micro-batches that count once, snapshots, slices by key, retention."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import substring
from .commits import Commits, schema_of

TABLES = ("pages", "links", "images", "schemas", "hreflangs", "issues")
CRAWLS = "target_url string, status string, started_at timestamp, finished_at timestamp, total_pages bigint, error_count bigint, alert_count bigint, warning_count bigint, health_score int"
#: Tables of the index for substrings of URLs.
INDEX = ("url_texts", "url_grams")
#: The column by which each table is kept in order when a session is compacted.
KEYS = {"pages": "url", "links": "source_url", "images": "page_url", "schemas": "page_url", "hreflangs": "page_url", "issues": "url"}


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None, microsecond=0)


class Store:
    """Sessions under a folder of any file system that Spark writes to.

    Tables lie in folders of their own attempt under data/; the log under log/ says which of them make up a session
    (commits.py). Each method reads one version of the log, the latest unless `version` is given, so a reader
    never sees part of a write."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        self.log = Commits(spark, f"{self.folder}/log", CRAWLS)

    def at(self, version: int) -> Store:
        """The store as it was at a version."""
        return Store(self.spark, self.folder, version)

    def _entries(self) -> DataFrame:
        return self.log.entries(self.version)

    def _write(self, tables: dict[str, DataFrame], session: str, files: dict, schemas: dict, ordered: bool = False) -> None:
        for name, df in tables.items():
            path = f"data/{uuid.uuid4().hex}/{name}"
            df = df.withColumn("crawl_id", F.lit(session))
            key = KEYS.get(name)
            if ordered and key:
                df = df.repartitionByRange(key).sortWithinPartitions(key)
            df.write.parquet(f"{self.folder}/{path}")
            files[name], schemas[name] = path, df.schema.json()

    def _index(self, files: dict, schemas: dict) -> None:
        """An index for substrings of the URLs of the findings just written."""
        folder = f"data/{uuid.uuid4().hex}"

        def write(df: DataFrame, name: str, *by: str) -> DataFrame:
            files[name], schemas[name] = f"{folder}/{name}", df.schema.json()
            df.write.partitionBy(*by).parquet(f"{self.folder}/{folder}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{folder}/{name}")

        urls = self.spark.read.schema(schema_of(schemas["issues"])).parquet(f"{self.folder}/{files['issues']}")
        rows = write(substring.numbered(urls, "url"), "url_texts", "shelf")
        write(substring.postings(rows), "url_grams")

    def begin(self, session_id: str, target_url: str) -> None:
        self.log.commit("status", session_id, self.log.latest(), crawl={"target_url": target_url, "status": "crawling", "started_at": _now()})

    def append(self, session_id: str, batch: str, tables: dict[str, DataFrame], derived: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> bool:
        """Adds a batch to all tables of a session at once; False if the session has the batch already.

        derived(pages): tables made from the batch's pages as they were written, so that pages are computed once."""
        since, files, schemas = self.log.latest(), {}, {}
        if not self._entries().filter((F.col("session") == session_id) & (F.col("kind") == "append") & (F.col("batch") == batch)).isEmpty():
            return False
        self._write(tables, session_id, files, schemas)
        if derived:
            pages = self.spark.read.schema(schema_of(schemas["pages"])).parquet(f"{self.folder}/{files['pages']}").drop("crawl_id")
            self._write(derived(pages), session_id, files, schemas)
        return self.log.commit("append", session_id, since, batch, files, schemas) is not None

    def sink(self, session_id: str, tables: Callable[[DataFrame], dict[str, DataFrame]], derived: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each micro-batch counts once, however often a restart runs it."""
        return lambda df, batch: self.append(session_id, f"stream-{batch}", tables(df), derived) and None

    def _closed(self, session_id: str, status: str, pages: DataFrame, issues: DataFrame) -> dict:
        from ..operators.score import health_score

        n = {r["severity"]: r["count"] for r in issues.groupBy("severity").count().collect()}  # four rows
        total = pages.agg(F.count("*").alias("n"))
        known = self.crawls().filter(F.col("session_id") == session_id).first()
        crawl = {"target_url": known["target_url"] if known else None, "status": status, "started_at": known["started_at"] if known else _now(), "finished_at": _now()}
        return crawl | {"total_pages": total.first()["n"], "error_count": n.get(1, 0), "alert_count": n.get(2, 0), "warning_count": n.get(3, 0), "health_score": health_score(issues, total).first()["score"]}

    def finish(self, session_id: str, status: str = "completed") -> None:
        """Closes a session with the counts of what it holds."""
        since = self.log.latest()
        self.log.commit("status", session_id, since, crawl=self._closed(session_id, status, self.table("pages", session_id), self.table("issues", session_id)))

    def save(self, session_id: str, audit) -> None:
        """Writes an audit's tables and closes its session, as one version. Saved again, a session is replaced."""
        since, files, schemas = self.log.latest(), {}, {}
        self._write({name: getattr(audit, name) for name in TABLES}, session_id, files, schemas)
        self.log.commit("replace", session_id, since, None, files, schemas, self._closed(session_id, "completed", audit.pages, audit.issues))

    def compact(self, session_id: str) -> None:
        """A session's batches as one, with every table in order of its page's URL, and an index of the findings' URLs."""
        since, files, schemas = self.log.latest(), {}, {}
        known = self.at(since)
        self._write({n: known.table(n, session_id).drop("crawl_id") for n in known.names(session_id)}, session_id, files, schemas, ordered=True)
        if "issues" in files:
            self._index(files, schemas)
        crawl = known.crawls().filter(F.col("session_id") == session_id).drop("session_id").first()
        self.log.commit("replace", session_id, since, None, files, schemas, crawl.asDict() if crawl else None)

    def crawls(self, limit: int | None = None) -> DataFrame:
        """Sessions, newest first."""
        states = self._entries().filter("kind <> 'delete' AND crawl IS NOT NULL")
        last = states.groupBy("session").agg(F.max_by("crawl", "version").alias("s")).select(F.col("session").alias("session_id"), "s.*").orderBy(F.desc("started_at"), "session_id")
        return last.limit(limit) if limit else last

    def table(self, name: str, session_id: str | None = None) -> DataFrame:
        """A table of one session, or of all; crawl_id says whose a row is."""
        of = self._entries().filter(F.col("files")[name].isNotNull())
        own = of.filter(F.col("session") == session_id) if session_id is not None else of
        held = own.select("version", F.col("files")[name].alias("path"), F.col("schemas")[name].alias("schema")).orderBy("version").collect()  # a row a batch
        if not held:
            like = of.select(F.max_by(F.col("schemas")[name], "version").alias("schema")).first()["schema"]
            if like is None:
                raise ValueError(f"no session has a table {name}")
            return self.spark.createDataFrame([], schema_of(like))
        kinds: dict[str, list[str]] = {}
        for r in held:
            kinds.setdefault(r["schema"], []).append(f"{self.folder}/{r['path']}")
        parts = [self.spark.read.schema(schema_of(s)).parquet(*paths) for s, paths in kinds.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def names(self, session_id: str) -> list[str]:
        """The tables a session has."""
        named = self._entries().filter(F.col("session") == session_id).select(F.explode(F.map_keys("files")).alias("name")).distinct()
        return sorted(r["name"] for r in named.collect() if r["name"] not in INDEX)

    def pages_with_children(self, session_id: str, limit: int, offset: int = 0) -> DataFrame:
        """A slice of a session's pages in order of url; the children are nested lists of the row."""
        return self.table("pages", session_id).orderBy("url").offset(offset).limit(limit)

    def page_slice(self, session_id: str, limit: int, after: str | None = None) -> dict[str, DataFrame]:
        """The `limit` pages that follow the URL `after`, and their children, a table each.

        The keys bound what is read: in a compacted session the files' ranges leave out all others, and children need no exchange."""
        pages = self.table("pages", session_id)
        pages = (pages if after is None else pages.filter(F.col("url") > after)).orderBy("url").limit(limit)
        urls = [r["url"] for r in pages.select("url").collect()]  # at most `limit`
        out = {"pages": pages}
        for name in self.names(session_id):
            if name == "pages":
                continue
            rows, key = self.table(name, session_id), F.col(KEYS[name])
            out[name] = rows.filter(key.between(urls[0], urls[-1]) & key.isin(urls)) if urls else rows.limit(0)
        return out

    def issues(self, session_id: str, severity: int | None = None, category: str | None = None, code: str | None = None, url_part: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """Findings that meet every filter given, by severity; limit 0 means 50. In url_part % and _ are wildcards."""
        return self._filtered(session_id, severity, category, code, url_part).orderBy("severity", "url", "code").offset(offset).limit(limit or 50)

    def count_issues(self, session_id: str, **filters) -> int:
        return self._filtered(session_id, **filters).count()

    def _filtered(self, session_id, severity=None, category=None, code=None, url_part=None) -> DataFrame:
        out = self.table("issues", session_id)
        for column, value in (("severity", severity), ("category", category), ("code", code)):
            if value is not None:
                out = out.filter(F.col(column) == value)
        if not url_part:
            return out
        batches = self._entries().filter((F.col("session") == session_id) & F.col("files")["issues"].isNotNull())
        if batches.select(F.every(F.col("files")["url_grams"].isNotNull()).alias("all")).first()["all"]:  # none was added since it was compacted
            urls = substring.search(*(self.table(name, session_id) for name in INDEX), url_part)
            return out.join(urls, out["url"] == urls["text"], "left_semi")
        return out.filter(F.col("url").ilike(f"%{url_part}%"))

    def broken_links(self, session_id: str) -> DataFrame:
        """Internal links to pages that answer 404."""
        gone = self.table("pages", session_id).filter("status_code = 404").select(F.col("url").alias("target_url"))
        return self.table("links", session_id).filter("is_internal").join(gone, "target_url").select("source_url", "target_url", "anchor_text")

    def delete(self, session_id: str) -> bool:
        """Ends a session; False if there is none. Its files stay until vacuum, for readers of earlier versions."""
        since = self.log.latest()
        if self.crawls().filter(F.col("session_id") == session_id).isEmpty():
            return False
        self.log.commit("delete", session_id, since)
        return True

    def clean(self, days: int | None = None) -> int:
        """Deletes sessions that began over `days` days ago, or all; returns their number."""
        old = self.crawls()
        if days is not None:
            old = old.filter(F.col("started_at") < F.expr(f"current_timestamp() - INTERVAL {int(days)} DAYS"))
        ids = [r["session_id"] for r in old.select("session_id").collect()]  # sessions, not rows of data
        return sum(map(self.delete, ids))

    def vacuum(self, hours: float = 24) -> int:
        """Removes folders that no session in force names and that are older than `hours`, of deleted and replaced sessions
        and of attempts that were lost; returns their number. Readers and writers must be done within `hours`."""
        version = self.log.latest()
        used = {p.split("/")[1] for r in self.log.entries(version).select(F.map_values("files").alias("p")).collect() for p in r["p"]}
        data, fs = self.log._hadoop(f"{self.folder}/data")
        limit, gone = datetime.datetime.now().timestamp() - hours * 3600, 0
        for x in fs.listStatus(data) if fs.exists(data) else []:
            if x.getPath().getName() not in used and x.getModificationTime() / 1000 <= limit:
                gone += fs.delete(x.getPath(), True)
        return gone
