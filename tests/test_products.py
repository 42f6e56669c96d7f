import math

import numpy as np
import pytest

from marlstone.operators import lexical, products, search, sparse


def ranked(rows):
    return sorted((r.query_id, r["rank"], r.chunk_id) for r in rows)


@pytest.mark.parametrize("low", [0.1, -1.0])
def test_products_are_exact_in_any_blocks(spark, monkeypatch, low):
    rng = np.random.default_rng(3)
    stored = [(c, f"t{t}", float(np.round(rng.uniform(low, 2), 1))) for c in range(120) for t in rng.choice(12, 4, replace=False)]
    asked = [(q, f"t{t}", float(np.round(rng.uniform(low, 2), 1))) for q in range(9) for t in rng.choice(14, 3, replace=False)]
    if low < 0:
        stored.append((500, "t1", math.nan))
    want = set()
    for q in range(9):
        score = {}
        for c, t, v in stored:
            for a, u, w in asked:
                if (a, u) == (q, t):
                    score[c] = score.get(c, 0.0) + v * w
        order = sorted(score, key=lambda c: (-math.inf if math.isnan(score[c]) else -round(score[c], 9), c))
        want |= {(q, c, i + 1) for i, c in enumerate(order[:7])}
    s = spark.createDataFrame(stored, "chunk_id bigint, term string, weight double").repartition(3)
    a = spark.createDataFrame(asked, "query_id int, term string, qw double")
    for name, value in (("BLOCK", 2048), ("BLOCK", 4), ("STEP", 16), ("KEPT", 1), ("FULL", 2.0), ("FEW", 1)):
        monkeypatch.setattr(products, name, value)
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in sparse.sparse_top_k(s, a, 0, 7, prune=False).collect()} == want


def pairs_sorted(monkeypatch, module, run):
    """How many rows reach the ranking."""
    seen, plain = [], module.top_k
    monkeypatch.setattr(module, "top_k", lambda scored, k: seen.append((scored.count(), scored.rdd.getNumPartitions())) or plain(scored, k))
    run().collect()
    return seen[0]


def test_sparse_leg_ranks_no_more_than_k_a_query_and_task(spark, monkeypatch):
    s = spark.createDataFrame([(c, "t", 1.0 + c) for c in range(400)], "chunk_id bigint, term string, weight double")
    a = spark.createDataFrame([(q, "t", 1.0) for q in range(30)], "query_id int, term string, qw double")
    rows, tasks = pairs_sorted(monkeypatch, sparse, lambda: sparse.sparse_top_k(s, a, 0, 2, prune=False))
    assert rows <= 30 * 2 * tasks < 30 * 400


def test_bm25_ranks_no_more_than_k_a_query_and_task(spark, monkeypatch):
    chunks = spark.createDataFrame([(c, "fox " + "word " * (c % 7)) for c in range(400)], "chunk_id bigint, text string")
    q = spark.createDataFrame([(i, "fox") for i in range(30)], "query_id int, text string")
    rows, tasks = pairs_sorted(monkeypatch, lexical, lambda: lexical.Index(chunks).search(q, 2))
    assert rows <= 30 * 2 * tasks < 30 * 400


def test_hybrid_legs_rank_no_more_than_k_a_query_and_task(spark, monkeypatch):
    chunks = spark.createDataFrame([(c, "A", 1, "", "fox " + "word " * (c % 7)) for c in range(600)], "chunk_id bigint, doc string, page int, section string, text string")
    vectors = spark.createDataFrame([(c, [1.0, float(c)]) for c in range(600)], "chunk_id bigint, embedding array<float>")
    terms = spark.createDataFrame([(c, "t" if c < 80 else "u", 1.0 + c) for c in range(600)], "chunk_id bigint, term string, weight double")
    q = spark.createDataFrame([(i, "fox", [1.0, 1.0]) for i in range(30)], "query_id int, text string, embedding array<float>")
    qt = spark.createDataFrame([(i, "t", 1.0) for i in range(30)], "query_id int, term string, qw double")
    seen, plain = [], lexical.top_k
    for module in (lexical, sparse):
        monkeypatch.setattr(module, "top_k", lambda scored, k: seen.append((scored.count(), scored.rdd.getNumPartitions())) or plain(scored, k))
    legs = search.legs(search.Collection(chunks, vectors, terms, 2), q, qt, 1)
    assert [leg.count() for leg in legs] == [30 * 20, 30 * 20, 30 * 4]
    assert len(seen) == 2 and all(rows <= 30 * k * tasks for (rows, tasks), k in zip(seen, (20, 4)))
