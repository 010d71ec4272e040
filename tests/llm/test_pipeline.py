"""The pipeline's stages against brute force, and the corpus queries against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from pagewarden.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    from test_operators import brute_lines, brute_near

    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, f in cp.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = f(spark, docs, SF)
        seen[name] = [r.asDict() for r in docs.collect()]
        after = seen[name]
        if name == "toxicity":
            scored = {r["doc_id"]: r["predicted"] for r in QUERIES["op7_toxicity"](spark, SF).collect()}
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not scored[r["doc_id"]]} and len(after) > 0.8 * len(before)
        elif name == "line_dedup":
            deleted = brute_lines([(r["doc_id"], r["text"]) for r in before], 10) if len(before) < 400 else None
            for r in after:
                text = next(b["text"] for b in before if b["doc_id"] == r["doc_id"])
                assert r["text"] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in deleted[r["doc_id"]])
        elif name == "near_dedup":
            want = brute_near([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert {r["doc_id"] for r in after} == {i for i, (_, c) in want.items() if i == c}
        elif name == "mixing":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) >= len(before) / 2
        if name != "tokens":
            assert docs.columns == cp.COLUMNS
    assert all(r["decodes"] and r["n_tokens"] == len(r["token_ids"]) for r in seen["tokens"])
    whole = cp.run(spark, SF)
    assert {r["doc_id"] for r in whole.collect()} == {r["doc_id"] for r in seen["tokens"]}


def test_what_the_toxicity_stage_removes(spark):
    """Against the labels, over rows that training didn't see: most of what goes is toxic, most of what is toxic goes."""
    from pagewarden.llm.toxicity import held_out

    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r["doc_id"] for r in cp.toxicity(spark, docs, sf).select("doc_id").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter(held_out()).collect()}
    toxic, gone = {i for i, y in truth.items() if y}, {i for i in truth if i not in left}
    assert len(gone & toxic) >= 0.7 * len(toxic) and len(gone & toxic) >= 0.6 * len(gone)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an empty table, and clashing columns."""
    pytest.importorskip("public_tokenizers")
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(1, line, "en", "a", 5), (1, line, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "  \n\t", "en", None, 4), (5, line + "\nown words here", "de", "b", 9), (6, "word " * 60_000, "en", "b", 1), (7, "WORD " * 60_000, "en", "b", 1), (None, "no id", "en", "b", 5), (8, "nul \0 é 🙂", "fr", "c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("kept", "score", "topic", "runs", "text_kept", "digest", "token_ids", "probability", "component_id", "part", "predicted"):
        df = df.withColumn(c, F.lit("clash"))
    df = df.limit(0) if empty else df
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 1), (8, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda out: sorted((r["doc_id"] for r in out.collect()), key=str)
    stages = dict(cp.STAGES)
    every = [] if empty else sorted((r[0] for r in rows), key=str)
    assert ids(stages["toxicity"](spark, read, str(tmp_path))) == every
    lined = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, read, str(tmp_path)).collect()}
    assert lined == ({} if empty else {r[0]: r[1] for r in rows} | {5: "own words here"})
    near = set(ids(stages["near_dedup"](spark, read, str(tmp_path))))
    assert near == set(every) - {7}
    mixed = stages["mixing"](spark, read, str(tmp_path))
    assert mixed.columns == cp.COLUMNS and set(ids(mixed)) <= set(every) and set(ids(mixed)) >= ({2, 3, 4} & set(every))
    out = {r["doc_id"]: r for r in stages["tokens"](spark, read, str(tmp_path)).collect()}
    assert set(out) == set(every) and all(r["decodes"] for r in out.values())
    assert cp.run(spark, str(tmp_path)).count() <= len(every)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(SQL[name])
    names = [x[0] for x in r.description]
    want = sorted(str(tuple(x[names.index(c)] for c in cols)) for x in r.fetchall())
    assert sorted(str(tuple(x[c] for c in cols)) for x in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    if name.startswith("op2"):
        pytest.importorskip("public_tokenizers")
    assert QUERIES[name](spark, SF).count() > 0
