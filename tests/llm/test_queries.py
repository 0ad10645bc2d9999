"""The registered queries: SQL where there is some, whole tables everywhere."""

import os

import duckdb
import pytest

from ionforge.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = queries.queries()[name](spark, DIR).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_returns_each_document(spark, con, name):
    got = queries.queries()[name](spark, DIR)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert ids == {r[0] for r in con.sql("select doc_id from documents").fetchall()}
