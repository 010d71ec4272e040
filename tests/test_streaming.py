"""Streams give what batches give."""

from pagewarden import streaming as s
from pagewarden.operators import frontier as fr
from pagewarden.operators import page_rules as pr
from pagewarden.sources import fetches as fe
from pagewarden.sources import html


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_page_stream(spark, tmp_path):
    row = lambda i: (f"https://e.com/{i}", f"https://e.com/{i}", 200, {}, "text/html", f"<title>{i}</title><p>x</p>", 10, 5, [], False, 0)
    rows = spark.createDataFrame([row(i) for i in range(6)], fe.SCHEMA)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    got = drain(s.audit_stream(s.fetch_stream(spark, str(tmp_path / "in"), 1)), "issues_stream")
    want = pr.issues(html.features_of(html.parse_pages(fe.prepared(rows))), "url")
    assert sorted(map(tuple, got.select("url", "code").collect())) == sorted(map(tuple, want.select("url", "code").collect()))
    q = s.write_batches(s.audit_stream(s.fetch_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want.count()


def test_event_windows(spark, tmp_path):
    events = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,CAST(id * 7 AS INT),0) AS ts, id % 3 AS user_id, 'a' AS event_type, 1.0D AS value FROM range(200)")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    got = drain(s.tumbling(stream), "tumbling_out", "complete")
    assert got.count() == 24 and got.agg({"n": "sum"}).first()[0] == 200
    assert s.sessions(events).count() == 3


def test_rate_control_stream(spark, tmp_path):
    rows = spark.createDataFrame([("h", i, 50, 429 if i < 2 else 200) for i in range(8)] + [("k", 1, 40, None)], "host string, seq long, ttfb_ms int, status_code int")
    for part in ("seq < 4", "seq >= 4"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    got = drain(s.control_stream(stream), "control_out")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in fr.control(rows).collect()}
