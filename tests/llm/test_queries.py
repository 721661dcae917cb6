"""The registered queries on the smallest tables, against DuckDB or brute force, and the pipeline stage by stage."""

import os

import duckdb
import pytest

from quillspark.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
pytest.importorskip("public_tokenizers")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    found = con.execute(Q.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name, table", [("op2_url_filter", "pages"), ("op4_sharding", "documents"), ("op5_suffix_array_dedup", "documents"), ("op8_simhash", "documents"), ("op10_bpe", "documents")])
def test_one_row_for_each_input_row(spark, name, table):
    assert Q.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_passages_find_every_repeat_of_51_words(spark):
    got = Q.queries()["op1_compact_windows"](spark, SF).collect()
    assert len({r.doc_id for r in got}) == len(got) == spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").distinct().count()
    linked, first, need = {r.doc_id for r in got if r.linked}, {}, set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ws = (r.text or "").lower().split()
        for i in range(len(ws) - 50):
            if first.setdefault(tuple(ws[i : i + 51]), r.doc_id) != r.doc_id:
                need.add(r.doc_id)
    assert len(need - linked) <= 0.1 * len(need)


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before
    assert C.run(spark, SF).count() == packed.count()
