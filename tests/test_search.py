import math

import numpy as np
import pytest

from marlstone.operators import dense, evaluate, fusion, kb, lexical, search, sparse

A = ["the quick brown fox jumps", "lazy dog sleeps"]
CHUNK = "chunk_id bigint, doc string, page int, section string, text string"


def chunks(spark, rows):
    return spark.createDataFrame([(i, d, p, s, t) for i, d, p, s, t in rows], CHUNK)


@pytest.fixture
def small(spark):
    return chunks(spark, [(1, "A", 1, "", A[0]), (2, "A", 2, "Intro", A[1]), (3, "B", 1, "", "quick fox again")])


def test_collection_statistics_and_replace(spark, small):
    s = lexical.statistics(lexical.lengths(small)).first()
    assert (s.n, s.total_len) == (3, 10) and lexical.postings(small).count() == 10
    docs = spark.createDataFrame([("A", "2024"), ("B", "2024")], "slug string, created_at string")
    none = {"vec_chunks": spark.createDataFrame([(1, [1.0])], "chunk_id bigint, embedding array<float>"), "sparse_terms": spark.createDataFrame([(2, "dog", 1.0)], "chunk_id bigint, term string, weight double")}
    new = {"docs": docs.where("slug = 'A'"), "chunks": chunks(spark, [(7, "A", 1, "", "completely different words here")]), "vec_chunks": none["vec_chunks"].where("false"), "sparse_terms": none["sparse_terms"].where("false")}
    for _ in range(2):
        after = kb.replace_docs({"docs": docs, "chunks": small, **none}, new)
        s = lexical.statistics(lexical.lengths(after["chunks"])).first()
        assert (s.n, s.total_len) == (2, 7) and lexical.postings(after["chunks"]).count() == 7
        assert after["vec_chunks"].count() == after["sparse_terms"].count() == 0
        assert kb.orphans(lexical.postings(after["chunks"]), after["chunks"]).count() == 0
        assert {r.chunk_id for r in after["chunks"].collect()} == {3, 4}


def test_merge_skips_or_replaces(spark, small):
    docs = spark.createDataFrame([("A", "2024"), ("B", "2024")], "slug string, created_at string")
    side = {"vec_chunks": spark.createDataFrame([(3, [1.0])], "chunk_id bigint, embedding array<float>"), "sparse_terms": spark.createDataFrame([], "chunk_id bigint, term string, weight double")}
    live, incoming = {"docs": docs, "chunks": small, **side}, {"docs": docs.where("slug = 'B'"), "chunks": small.where("doc = 'B'"), **side}
    merged, report = kb.merge(live, incoming)
    assert merged["chunks"].count() == 3 and report.first().action == "skipped"
    merged, report = kb.merge(live, incoming, replace=True)
    assert {r.chunk_id for r in merged["chunks"].collect()} == {1, 2, 4} and {r.chunk_id for r in merged["vec_chunks"].collect()} == {4}
    assert report.first().action == "replaced"


def test_bm25_by_hand(spark, small):
    q = spark.createDataFrame([(1, "fox fox"), (2, "unknown"), (3, None)], "query_id int, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25(lexical.postings(small), lexical.statistics(lexical.lengths(small)), q, 10).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    want = {(1, i): idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / (10 / 3))) for i, n in ((1, 4), (3, 3))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_filter_keeps_collection_frequencies(spark, small):
    q = spark.createDataFrame([(1, "fox")], "query_id int, text string")
    where = search.Filter(docs=["B"])
    stats = lexical.statistics(lexical.lengths(small))
    whole = {r.chunk_id: r.score for r in lexical.bm25(lexical.postings(small), stats, q, 9).collect()}
    part = {r.chunk_id: r.score for r in lexical.bm25(lexical.postings(small), stats, q, 9, where.allowed(small)).collect()}
    assert part == {3: whole[3]}
    assert search.Filter(section="INTR").allowed(small).first().chunk_id == 2
    assert search.Filter(section="").allowed(small) is None and search.Filter(page_from=2, page_to=2).allowed(small).count() == 1


def test_dense_is_exact_and_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)] + [(90, [0.0] * 4), (91, None), (92, [1.0])], "chunk_id bigint, embedding array<float>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "query_id bigint, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(7) for j in np.argsort(-(u @ u[i]))[:5]}
    for block in (2048, 3):
        monkeypatch.setattr(dense, "BLOCK", block)
        assert {(r.query_id, r.chunk_id) for r in dense.dense_top_k(v, q, 5, 4).collect()} == want
    assert dense.dense_top_k(v.where("false"), q, 5, 4).count() == 0 == dense.dense_top_k(v, q.where("false"), 5, 4).count()


def test_sparse_pruning(spark):
    terms = spark.createDataFrame([(1, f"t{i:02}", float(100 - i)) for i in range(33)], "query_id int, term string, qw double")
    df = spark.createDataFrame([(f"t{i:02}", 15 if i else 16) for i in range(33)], "term string, df bigint")
    got = [r.term for r in sparse.pruned_terms(terms, df, 100).orderBy("term").collect()]
    assert got == [f"t{i:02}" for i in range(1, 32)]  # the first is in over 15 %, the last is the 33rd
    got = [r.term for r in sparse.pruned_terms(terms, df, 100, budget=31).orderBy("term").collect()]
    assert got == ["t01", "t02", "t03"]  # the last one taken crosses the budget
    assert sparse.pruned_terms(terms, df.selectExpr("term", "1L as df"), 6).count() == 0


def leg(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id bigint, rank int")


def test_rrf(spark):
    got = fusion.rrf([leg(spark, [(1, 5, 1), (1, 6, 2)]), leg(spark, [(1, 6, 1), (1, 7, 2)]), leg(spark, [(1, 8, 2)])]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [6, 5, 7, 8]  # 7 and 8 are equal: the earlier leg first
    assert abs(got[0].score - (1 / 61 + 1 / 60)) < 1e-12


def test_mmr_prefers_the_different(spark):
    fused = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.89, 2), (1, 3, 0.5, 3), (1, 4, 0.1, 4)], "query_id int, chunk_id bigint, score double, rank int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "chunk_id bigint, embedding array<float>")
    got = [r.chunk_id for r in fusion.mmr(fused, v, 3).orderBy("position").collect()]
    assert got == [1, 2, 3] or got == [1, 3, 2]
    assert got == [c + 1 for c in fusion.pick_diverse(np.array([1, 0.9875, 0.5, 0]), np.array([[1, 1, 0, 0], [1, 1, 0.01, 0], [0, 0.01, 1, 0], [0, 0, 0, 0]]), 3)]
    plain = [r.chunk_id for r in fusion.mmr(fused, v.where("chunk_id = 1"), 2).orderBy("position").collect()]
    assert plain == [1, 2]
    assert fusion.pick_diverse(np.array([1.0, 0.5, 0.5]), np.eye(3), 3) == [0, 1, 2]


def test_hybrid_without_encoder(spark, small):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id bigint, embedding array<float>")
    terms = spark.createDataFrame([], "chunk_id bigint, term string, weight double")
    c = search.Collection(small, v, terms, 2)
    q = spark.createDataFrame([(1, "quick fox", None)], "query_id int, text string, embedding array<float>")
    qt = spark.createDataFrame([], "query_id int, term string, qw double")
    got = search.hybrid(c, q, qt, 5).orderBy("position").collect()
    assert [r.chunk_id for r in got] == [3, 1] and got[0].score == round(1 / 60, 4)
    e = search.envelope(c, q, qt).first()
    assert (e.total, e.dense, e.strength, e.message) == (3, False, 0.0, search.NO_ENCODER)
    assert search.envelope(c, q, qt, keyword=False).first().message == search.NOTHING
    empty = search.Collection(small.where("false"), v, terms, 2)
    assert search.envelope(empty, q, qt).first().message == search.EMPTY


def test_hybrid_takes_all_terms_of_a_query(spark):
    """Terms in over 15 % of the chunks, those after the 32nd and those over the budget of postings were left out."""
    many = chunks(spark, [(i, "A", 1, "", "words") for i in range(1, 9)])
    stored = [(i, "common", float(i)) for i in range(1, 7)] + [(7, f"t{i:02}", 1.0) for i in range(32)] + [(8, "t32", 9.0)]
    c = search.Collection(many, spark.createDataFrame([], "chunk_id bigint, embedding array<float>"), spark.createDataFrame(stored, "chunk_id bigint, term string, weight double"), 2)
    q = spark.createDataFrame([(1, None, None), (2, None, None)], "query_id int, text string, embedding array<float>")
    qt = spark.createDataFrame([(1, "common", 1.0)] + [(2, f"t{i:02}", float(100 - i)) for i in range(33)], "query_id int, term string, qw double")
    got = {(r.query_id, r.position): r.chunk_id for r in search.hybrid(c, q, qt, 5).collect()}
    assert got == {(1, 1): 6, (1, 2): 5, (1, 3): 4, (1, 4): 3, (1, 5): 2, (2, 1): 7, (2, 2): 8}
    assert [(r.query_id, r.chunk_id) for r in search.hybrid(c, q, qt, 5, prune=True).collect()] == [(2, 7)]


def test_metrics(spark):
    run = leg(spark, [(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)])
    qrels = spark.createDataFrame([(1, 11, 2), (1, 13, 1), (2, 99, 0)], "query_id int, chunk_id bigint, rel int")
    n = {r.query_id: r.ndcg for r in evaluate.ndcg(run, qrels).collect()}
    assert abs(n[1] - (2 / math.log2(3)) / (2 + 1 / math.log2(3))) < 1e-12 and n[2] == 0
    r = {x.query_id: x.recall for x in evaluate.recall(run, qrels).collect()}
    assert r == {1: 0.5, 2: 0.0}


def test_full_ranking(spark):
    ids = spark.range(1, 8).selectExpr("id as chunk_id")
    scored = spark.createDataFrame([(1, 2, 0.5), (1, 7, 0.9)], "query_id int, chunk_id bigint, score double")
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = evaluate.full_ranking(scored, q, ids, 4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, 7), (1, 2), (1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4)]


def test_pages(spark):
    rows = chunks(spark, [(2, "A", 1, "S", "two"), (1, "A", 1, "R", "one"), (3, "A", 2, "S", "three")])
    got = {(r.doc, r.page): (r.chunks, r.section, r.text) for r in search.page_text(rows).collect()}
    assert got == {("A", 1): (2, "R", "one\n\ntwo"), ("A", 2): (1, "S", "three")}
