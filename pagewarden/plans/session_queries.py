"""Queries over stored sessions: pages and links go through batches, replays, lost attempts and deletions, and are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK
from ..operators import substring
from ..sources import markup
from ..sources.storage import Store
from ..staging import fresh, stage
from .registry import load, query


def _links(pages: DataFrame) -> DataFrame:
    pages.createOrReplaceTempView("session_pages")
    return pages.sparkSession.sql(markup.links_sql(SPARK, "session_pages"))


@query(
    "session_store",
    lambda: f"""WITH p AS (SELECT *, {markup.ENVELOPE["status_code"]} AS status_code FROM pages), l AS ({markup.links_sql(DUCK)}),
        n AS (SELECT page_id, count(*) AS links, count(*) FILTER (is_internal) AS internal_links FROM l GROUP BY page_id)
        SELECT 'crawl' AS session_id, status_code, count(*) AS pages, sum(octet_length(encode(html)))::BIGINT AS bytes, coalesce(sum(links), 0)::BIGINT AS links, coalesce(sum(internal_links), 0)::BIGINT AS internal_links
        FROM p LEFT JOIN n USING (page_id) GROUP BY status_code""",
)
def session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is appended in one of three batches, one of which comes twice and one of which was lost before; a second
    session is deleted; then the first one is compacted and counted by status."""
    store = Store(spark, fresh(spark, "sessions"))
    pages = load(spark, sf_dir, "pages").withColumn("status_code", F.expr(markup.ENVELOPE["status_code"]))
    part = lambda k: {"pages": pages.filter(F.pmod(F.xxhash64("url"), F.lit(3)) == k)}
    derived = lambda p: {"links": _links(p)}
    store.begin("crawl", "https://example.com/")
    store.begin("other", "https://example.com/")
    store._write(part(1), "crawl", {}, {})  # an attempt that ended before it was published
    for k in (0, 1, 1, 2):
        store.append("crawl", f"batch-{k}", part(k), derived)
    store.append("other", "batch-0", part(0), derived)
    store.delete("other")
    store.compact("crawl")
    seen = store.table("pages").select("crawl_id", "page_id", "status_code", F.octet_length("html").alias("bytes"))
    links = store.table("links").groupBy("crawl_id", "page_id").agg(F.count("*").alias("links"), F.count_if("is_internal").alias("internal_links"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("bytes", "links", "internal_links")]
    return seen.join(links, ["crawl_id", "page_id"], "left").groupBy(F.col("crawl_id").alias("session_id"), "status_code").agg(F.count("*").alias("pages"), *sums)


#: Parts of URLs: a host's, a path's, one with wildcards, one in capitals, one too short for the index, one that no URL has.
NEEDLES = ("spam-farm", "/es/5", "page=_&ref", "BLOG.%.HTML", "/9", "no-such-part")


@query("url_substring_search", lambda: "SELECT needle, page_id, url FROM pages JOIN (VALUES " + ", ".join(f"('{n}')" for n in NEEDLES) + ") AS n(needle) ON url ILIKE concat('%', needle, '%')")
def url_substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages whose URL has each of some parts, by an index of all URLs."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    path = fresh(spark, "url_texts")
    numbered = substring.numbered(pages, "url")
    numbered.write.partitionBy("shelf").parquet(path)
    texts = spark.read.schema(numbered.schema).parquet(path)
    lists = stage(substring.postings(texts), "url_grams")
    found = [substring.search(texts, lists, n).select(F.lit(n).alias("needle"), F.col("text").alias("url")) for n in NEEDLES]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.join(pages, "url").select("needle", "page_id", "url")
