"""The pN queries on the smallest tables."""

import os

import duckdb
import pytest

from marlstone.llm import queries as q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
COLUMNS = {
    "p1_found": {"origin": "string", "term": "string", "mark": "string"},
    "p2_found": {"slug": "string", "chunk_id": "bigint", "lang": "string"},
    "p3_found": {"item_kind": "string", "item_id": "bigint"},
    "p4_found": {"chunk_id_a": "bigint", "chunk_id_b": "bigint"},
    "p5_found": {"chunk_id_a": "bigint", "chunk_id_b": "bigint"},
    "p6_found": {"chunk_id": "bigint", "kind": "string"},
    "p7_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p8_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p9_found": {"doc_id": "bigint", "kind": "string"},
}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_runs(spark, name):
    df = q.QUERIES[name](spark, DIR)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows and (not name.endswith("_found") or len(set(rows)) == len(rows))


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_as_oracle(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DIR):
        db.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    df = q.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = db.sql(f"select {', '.join(columns)} from ({q.SQL[name]}) q").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))
