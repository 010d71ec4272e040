"""The session store: writers that are killed, doubled and late, snapshots, replayed streams, slices by key."""

import threading

import pytest
from pyspark.sql import functions as F

from pagewarden import streaming
from pagewarden.sources import commits, storage
from pagewarden.sources import fetches as fe
from pagewarden.sources.storage import Store

PAGES, LINKS, ISSUES = "url string, status_code int", "source_url string, target_url string, is_internal boolean, anchor_text string", "url string, code string, category string, severity int"


def batch(spark, urls):
    pages = spark.createDataFrame([(u, 404 if u.endswith("9") else 200) for u in urls], PAGES)
    links = spark.createDataFrame([(u, f"{u}9", True, "x") for u in urls for _ in range(2)], LINKS)
    return {"pages": pages, "links": links, "issues": spark.createDataFrame([(u, "C", "links", 2) for u in urls], ISSUES)}


def urls(store, session="s"):
    return sorted(r["url"] for r in store.table("pages", session).collect())


class Killed(BaseException):
    pass


def test_readers_see_all_or_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    store.begin("s", "https://e.com/")
    assert store.append("s", "0", batch(spark, "ab"))
    write = Store._write

    def dies_after_pages(self, tables, *more):
        write(self, {"pages": tables["pages"]}, *more)
        raise Killed

    for name, dies in ((("_write"), dies_after_pages), ("publish", lambda *_: (_ for _ in ()).throw(Killed()))):
        with monkeypatch.context() as m:
            m.setattr(Store if name == "_write" else commits.Commits, name, dies)
            with pytest.raises(Killed):
                store.append("s", "1", batch(spark, "cd"))
        assert urls(store) == ["a", "b"] and store.table("links", "s").count() == 4 == 2 * store.count_issues("s")
    assert store.append("s", "1", batch(spark, "cd")) and not store.append("s", "1", batch(spark, "cd"))
    assert urls(store) == [*"abcd"] and store.table("links", "s").count() == 8
    # what the two killed attempts wrote goes, what is in force stays
    assert store.vacuum(hours=24) == 0 and store.vacuum(hours=-1) > 0
    assert urls(store) == [*"abcd"] and store.table("links", "s").count() == 8


def test_writers_at_once(spark, tmp_path):
    """Of two writers of a batch one counts; writers of different batches all do, each under a version of its own."""
    store = Store(spark, f"file://{tmp_path}/store")
    barrier, done = threading.Barrier(4), []

    def run(name, letters):
        barrier.wait()
        done.append((name, Store(spark, store.folder).append("s", name, batch(spark, letters))))

    threads = [threading.Thread(target=run, args=x) for x in (("same", "ab"), ("same", "ab"), ("other", "cd"), ("third", "ef"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [("other", True), ("same", False), ("same", True), ("third", True)]
    assert urls(store) == [*"abcdef"] and store.log.latest() == 3


def test_one_of_two_publishers_gets_a_name(spark, tmp_path):
    log = commits.Commits(spark, f"file://{tmp_path}/log", storage.CRAWLS)
    got = []
    threads = [threading.Thread(target=lambda i=i: got.append(log.publish("1.json", f"{i}" * 50_000))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [False] * 7 + [True] and len((tmp_path / "log/1.json").read_text()) == 50_000
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_conflicts_and_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "CHECKPOINT", 3)
    store = Store(spark, f"file://{tmp_path}/store")
    store.begin("s", "https://e.com/")
    store.append("s", "0", batch(spark, "ab"))
    store.append("t", "0", batch(spark, "xy"))
    before = store.log.latest()
    store.delete("s")
    with pytest.raises(commits.Conflict):  # this writer began before the session was deleted
        store.log.commit("append", "s", before, "late")
    with pytest.raises(commits.Conflict):
        store.log.commit("replace", "s", before)
    assert urls(store.at(before)) == ["a", "b"] and urls(store) == [] and urls(store, "t") == ["x", "y"]
    assert not store.delete("s") and store.crawls().count() == 0
    store.begin("s", "https://e.com/2")
    store.append("s", "0", batch(spark, "c"))  # the batches of the deleted session count no more
    for i in range(1, 4):
        store.append("s", str(i), batch(spark, f"{i}"))
    assert urls(store) == ["1", "2", "3", "c"] and store.crawls().first()["target_url"] == "https://e.com/2"
    assert sorted(r["crawl_id"] for r in store.table("pages").collect()) == ["s"] * 4 + ["t"] * 2
    store.finish("s")
    row = store.crawls().first()
    assert (row["status"], row["total_pages"], row["alert_count"]) == ("completed", 4, 4)
    # the log begins at a checkpoint; what it stands for can go
    last = store.log.latest()
    store.log.forget(last)
    assert min(store.log.versions()) > 3 and urls(store) == ["1", "2", "3", "c"] and store.log.latest() == last
    assert store.append("s", "4", batch(spark, "4")) and not store.append("s", "2", batch(spark, "2")) and len(urls(store)) == 5


def test_empty_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/none")
    assert store.crawls().count() == 0 and not store.delete("s") and store.clean() == 0 and store.vacuum() == 0
    with pytest.raises(ValueError):
        store.table("pages", "s")
    store.append("s", "0", batch(spark, "ab") | {"pages": batch(spark, "ab")["pages"].limit(0)})
    assert urls(store) == [] and store.page_slice("s", 5)["links"].count() == 0
    assert store.table("pages", "unknown").columns == ["url", "status_code", "crawl_id"]


def test_slices_of_a_compacted_session(spark, tmp_path, capsys):
    store = Store(spark, f"file://{tmp_path}/store")
    names = [f"https://e.com/{i:03d}" for i in range(120)]
    for k in range(3):
        store.append("s", str(k), batch(spark, names[k::3]))
    want = store.table("links", "s").count()
    store.compact("s")
    assert store.table("links", "s").count() == want and urls(store) == names
    after, seen = None, []
    while True:
        part = store.page_slice("s", 50, after)
        got = [r["url"] for r in part["pages"].collect()]
        if not got:
            break
        assert sorted(r["source_url"] for r in part["links"].collect()) == sorted(got * 2) and part["issues"].count() == len(got)
        after, seen = got[-1], seen + got
    assert seen == names
    part = store.page_slice("s", 10, names[20])
    capsys.readouterr()
    part["links"].explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "GreaterThanOrEqual(source_url" in plan


def test_replayed_stream(spark, tmp_path):
    """A stream that is run again over batches whose commits were lost adds nothing twice, and equals the batch result."""
    page = lambda i: (f"https://e.com/{i}", f"https://e.com/{i}", 200, {}, "text/html", f'<title>{i}</title><p>x</p><a href="/{i + 1}">n</a>', 10, 5, [], False, 0)
    for i in range(3):
        spark.createDataFrame([page(2 * i), page(2 * i + 1)], fe.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, f"file://{tmp_path}/store")

    def drain():
        q = streaming.write_session(streaming.fetch_stream(spark, str(tmp_path / "in"), 1), store, "s", str(tmp_path / "ck"))
        q.awaitTermination()

    drain()
    assert len(urls(store)) == 6 == store.table("links", "s").count() and store.log.latest() == 3
    for f in (tmp_path / "ck/commits").iterdir():
        if f.name.strip(".").startswith("2"):  # as if the driver had died before the last batch was marked as done
            f.unlink()
    drain()
    assert len(urls(store)) == 6 and store.log.latest() == 3
    want = streaming.audit_stream(spark.read.schema(fe.SCHEMA).parquet(str(tmp_path / "in"))).groupBy("code").count()
    assert sorted(map(tuple, store.table("issues", "s").groupBy("code").count().collect())) == sorted(map(tuple, want.collect()))
    assert store.table("issues", "s").filter(F.col("severity").isNull()).count() == 0
