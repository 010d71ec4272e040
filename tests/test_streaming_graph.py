"""Findings over streams equal the batch rules after the last batch, also after a restart."""

import random

from pyspark.sql import functions as F

from pagewarden.operators import graph_rules as gr
from pagewarden.streaming import graph

PAGES = "seq string, url string, title string, meta_description string, word_count int, content_hash long, simhash long"
CODES = ["WARN_GRAPH_EXACT_DUPLICATE_CONTENT", "WARN_GRAPH_DUPLICATE_TITLES", "WARN_GRAPH_DUPLICATE_META_DESCS"]


def pages(spark, n=60):
    r = random.Random(3)
    urls = [f"https://e.com/{i:03d}" for i in range(n)]
    r.shuffle(urls)  # so that firsts come late
    titles = [None, "", "  ", "One", " One ", "Two", "Three", *map(str, range(60))]
    return [(u, u, r.choice(titles), r.choice(titles), r.choice([10, 80]), r.randrange(8), 0) for u in urls]


def drain(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_duplicates(spark, tmp_path):
    rows, source, out, ck = pages(spark), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    whole = spark.createDataFrame(rows, PAGES)

    def arrive(part):
        for at in range(0, len(part), 15):
            spark.createDataFrame(part[at : at + 15], PAGES).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(source)
        drain(graph.duplicate_log(stream), out, ck)

    def want(part):
        found = gr.duplicate_rules(spark.createDataFrame(part, PAGES)).filter(F.col("code").isin(CODES))
        return sorted(map(tuple, found.select("url", "code", "related").collect()))

    def got():
        return sorted(map(tuple, graph.duplicates(spark.read.schema(graph.LOG).parquet(out)).collect()))

    arrive(rows[:30])
    run()
    assert got() == want(rows[:30]) != []
    arrive(rows[30:])  # the query ended; it goes on from its state
    run()
    assert got() == want(rows) and len(got()) > 40
    log = spark.read.schema(graph.LOG).parquet(out)
    assert log.join(graph.duplicates(log), ["url", "code", "related"], "left_anti").count() > 0  # something was put right later
    arrive(rows[:15])  # pages that come again add nothing
    run()
    assert got() == want(rows) and whole.count() == len(rows)


def test_broken_links(spark, tmp_path):
    stamp = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT), 0, 0)"
    p = spark.sql(f"SELECT concat('u', id) AS url, CASE WHEN id % 3 = 0 THEN 404 ELSE 200 END AS status_code, {stamp} AS fetched_at FROM range(40)")
    k = spark.sql(f"SELECT concat('u', id) AS source_url, concat('u', (id * 7) % 45) AS target_url, 'x' AS anchor_text, id % 5 <> 0 AS is_internal, {stamp} AS fetched_at FROM range(40)")
    for name, df in (("p", p), ("k", k)):
        for part in range(3):
            df.filter(F.pmod(F.hash(df.columns[0]), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    drain(graph.broken_links(stream("p", p), stream("k", k), within="2 days", late="3 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    gone = {r["url"] for r in p.filter("status_code = 404").collect()}
    assert got == sorted((r["source_url"], r["target_url"], "x") for r in k.collect() if r["is_internal"] and r["target_url"] in gone) and len(got) > 5
    near = graph.broken_links(p, k, within="20 hours")
    assert 0 < near.count() < len(got)
