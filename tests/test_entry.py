"""Every registered query runs on the smallest tables and agrees with its oracle."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from marlstone.operators import sparse

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("p")  or n.startswith("prj")))
def test_as_oracle(spark, db, name):
    df = entry.queries()[name](spark, DIR)
    sql = db.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    want = sorted(tuple(plain(v) for v in r) for r in db.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]}) q").fetchall())
    assert got == want


def test_tags_are_stripped_from_all_documents(spark):
    df = entry.queries()["fn_strip_xml_all"](spark, DIR)
    assert df.count() == spark.read.parquet(f"{DIR}/documents.parquet").count() > entry.queries()["fn_strip_xml"](spark, DIR).count()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "position", "chunk_id", "doc", "page", "section", "score", "snippet"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["ret_hybrid", "ret_hybrid_dense"])
def test_whole_hybrid_search_prunes_no_terms(spark, monkeypatch, name):
    def pruned(*_):
        raise AssertionError("terms are left out")

    monkeypatch.setattr(sparse, "pruned_terms", pruned)
    assert "before < " not in entry.oracle_sql()[name]
    assert entry.queries()[name](spark, DIR).columns
