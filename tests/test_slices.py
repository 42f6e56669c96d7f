import numpy as np
from pyspark.sql import functions as F

from marlstone.functions import tokens as tk
from marlstone.operators import dense, lexical, products
from marlstone.plans import catalog
from marlstone.session import one_a_key

PARTS, QUERIES, K = 16, 40, 2


def test_many_blocks_of_queries_leave_few_candidates(spark, monkeypatch):
    """Candidates followed the queries times all partitions of the chunks."""
    monkeypatch.setattr(products, "BLOCK", 4)
    monkeypatch.setattr(dense, "BLOCK", 4)
    packed = products.pack(spark.createDataFrame([(c, "t", 1.0 + c) for c in range(800)], "chunk_id bigint, term string, weight double"), "weight").repartition(PARTS)
    weights = spark.createDataFrame([(q, "t", 1.0) for q in range(QUERIES)], "query_id int, term string, w double")
    most = QUERIES * K * products.SLICES
    assert products.best_products(packed, weights, K).count() <= most < QUERIES * K * PARTS
    seen, plain = [], dense.top_k
    monkeypatch.setattr(dense, "top_k", lambda scored, k: seen.append(scored.count()) or plain(scored, k))
    v = spark.createDataFrame([(c, [1.0, float(c)]) for c in range(800)], "chunk_id bigint, embedding array<float>").repartition(PARTS)
    q = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(QUERIES)], "query_id int, embedding array<float>")
    assert dense.dense_top_k(v, q, K, 2).count() == QUERIES * K
    assert seen[0] <= most


def test_dense_results_are_those_of_double_precision(spark, monkeypatch):
    monkeypatch.setattr(dense, "STEP", 16)
    rng = np.random.default_rng(5)
    near = np.array([1.0, 1.0, 0.0, 0.0]) + rng.normal(0, 3e-4, (300, 4))  # cosines closer than single precision tells apart
    near = near.astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(near)], "chunk_id bigint, embedding array<float>").repartition(2)
    q = spark.createDataFrame([(0, [1.0, 1.0, 0.0, 0.0])], "query_id int, embedding array<float>")
    x = near.astype(float) / np.linalg.norm(near.astype(float), axis=1, keepdims=True)
    cos = np.round(x @ (np.array([1.0, 1, 0, 0]) / np.sqrt(2)), 9)
    want = np.lexsort((np.arange(300), -cos))[:9].tolist()
    assert [r.chunk_id for r in dense.dense_top_k(v, q, 9, 4).orderBy("rank").collect()] == want


def test_tokens_are_counted_where_they_lie(spark):
    rows = [(1, "fox runs fox H2SO4 x_1"), (2, None), (3, "the of"), (4, "a+b a+b zebra fox"), (None, "fox")]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(2)
    for split in (tk.tokens, tk.plain_tokens):
        flat = [df.select("chunk_id", "len", F.explode("p").alias("x")).select("chunk_id", "len", "x.term", "x.value") for df in (lexical.counted(chunks, split), products.pack(lexical.postings(chunks, split), "tf", "len"))]
        assert sorted(map(tuple, flat[0].collect())) == sorted(map(tuple, flat[1].collect())) != []
    whole = spark.createDataFrame(rows, "chunk_id bigint, text string")
    assert "Exchange" not in lexical.counted(whole)._jdf.queryExecution().executedPlan().toString()


def test_one_a_key_moves_keys_and_not_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "n"), (None, "n")], "k bigint, text string").repartition(3)
    keys = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "k bigint")
    for most in (100, 0):
        assert sorted(map(tuple, one_a_key(rows, "k", most=most).collect()), key=str) == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
        assert sorted(map(tuple, one_a_key(rows, "k", keys, most).collect())) == [(1, "a"), (2, "b")]


def test_collection_is_that_of_its_tables(spark):
    d = "/root/testdata/sf0.001"
    c = catalog.collection(spark, d)
    for got, want in ((c.chunks, catalog.chunks_of(spark, d)), (c.vectors, catalog.vectors_of(spark, d)), (c.terms, catalog.terms_of(spark, d))):
        assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
