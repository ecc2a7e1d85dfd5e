"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LLM = {k for k in entry.queries() if k == "pipeline" or k.startswith("op") and k[2].isdigit()}  # tested in tests/llm
OWN = sorted(set(entry.oracle_sql()) - LLM)
OWN_TESTS = {"sq_corrected", "ml_learning_cycle", "ml_boosted", "sq_tuned_thresholds", "co_ablated", "co_repaired", "tn_thresholds", "tn_viterbi_arms"}  # slow, their operators have tests
OTHERS = sorted(set(entry.queries()) - set(entry.oracle_sql()) - LLM - OWN_TESTS)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", OWN)
def test_query_agrees_with_sql(spark, db, name):
    got = entry.queries()[name](spark, DATA)
    rel = db.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", OTHERS)
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
