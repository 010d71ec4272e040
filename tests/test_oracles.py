"""Every query that has SQL for DuckDB gives the same rows on the smallest scale."""

import os

import duckdb
import pytest

from pagewarden.plans import all_queries, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
all_queries()


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(registry.ORACLES[name]())
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert sorted(tuple(norm(x[c]) for c in cols) for x in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
