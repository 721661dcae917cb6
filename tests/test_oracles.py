"""Every catalogued query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from quillspark.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_without_oracle(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_native_queries_have_no_python_nodes(spark):
    for name in ("t1_clean_text", "w5_chunk_per_doc", "w9_diversified_top_k", "g3_line_features", "j7_containment", "c_findings"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name
        assert "CartesianProduct" not in plan, name
