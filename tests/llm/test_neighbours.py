import tracemalloc

import numpy as np

from marlstone.llm import neighbours as nb

DIM = 16


def run(spark, rows, ids=None, k=5):
    v = spark.createDataFrame([(i, x, 1.0) for i, x in rows], "chunk_id bigint, embedding array<float>, similarity double")
    c = spark.createDataFrame([(i,) for i in (ids if ids is not None else sorted({i for i, _ in rows if i is not None}))], "chunk_id bigint")
    return {(r.id, r.neighbour): r.similarity for r in nb.nearest(v, c, DIM, k).collect()}


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = {}
    for a in range(len(ids)):
        order = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if ids[b] != ids[a])[:k]
        out |= {(ids[a], b): -m for m, b in order}
    return out


def clustered(n, clusters, seed):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((clusters, DIM))
    return [(int(i), (centre[i % clusters] + 0.25 * rng.standard_normal(DIM)).astype(np.float32).tolist()) for i in range(n)]


def test_one_cell_is_exact(spark):
    rows = clustered(300, 12, 1)
    got, want = run(spark, rows), brute(rows)
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-6 for p in want)


def test_many_cells_lose_little(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 150)
    rows = clustered(3000, 60, 2)
    got, want = run(spark, rows), brute(rows)
    assert len(set(got) & set(want)) >= 0.97 * len(want)


def test_rows_beyond_the_cap_find_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 150)
    rng = np.random.default_rng(12)
    centre = rng.standard_normal((40, DIM))
    rows = [(int(i), (centre[i % 40] + 0.02 * rng.standard_normal(DIM)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(5000 + i, rng.standard_normal(DIM).astype(np.float32).tolist()) for i in range(30)]
    got, want = run(spark, rows), brute(rows)
    alone = {p for p in want if p[0] >= 5000}
    assert len(alone & set(got)) >= 0.95 * len(alone) and len({p for p in got if p[0] >= 5000}) == len(alone)


def test_cells_are_bounded_whatever_the_sample(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((30, 64))
    rows = [(int(i), (centre[i % 30] + 0.3 * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(2400)]
    v = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    # a sample for four leaves, where twelve times as many cells are needed
    got = {(r.id, r.neighbour) for r in nb.nearest(v, v.select("chunk_id"), 64, 5, cell_rows=50, sample_max=20).collect()}
    want = set(brute(rows))
    assert len(got & want) >= 0.97 * len(want)
    x = np.array([r for _, r in rows], np.float32)
    tree = nb.ProjectionTree(64, len(x), x[:20], 50)
    leaf = np.bincount(tree.leaves(x), minlength=1 << tree.depth)
    tree.set_blocks(leaf, 50)
    assert tree.depth <= 2 and np.bincount(tree.cells(x, np.arange(len(x)))).max() <= 100
    assert (tree.leaf_of[tree.cells(x, np.arange(len(x)))] == tree.leaves(x)).all()


def test_squared_projections_follow_the_law():
    rng = np.random.default_rng(9)
    d = rng.standard_normal((4000, 64))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    axes = nb.ProjectionTree(64, 10, np.zeros((0, 64), np.float32)).axes
    assert np.allclose(axes @ axes.T, np.eye(nb.DIRECTIONS), atol=1e-5)
    far = ((d @ axes.T) ** 2).sum(1) * 64 > nb.chi2_quantile(0.9, nb.DIRECTIONS)
    assert far.mean() < 0.11


def test_a_vector_that_a_third_of_all_rows_share(spark):
    base = clustered(60, 6, 7)
    rows = [*base, *((3000 + i, base[2][1]) for i in range(30))]
    every = spark.createDataFrame(rows, "id bigint, vec array<float>")
    kept, copies, firsts = nb.without_copies(every, 5)
    assert kept.count() == 60 + 5 and copies.count() == 25 and [r.id for r in firsts.collect()] == [2]
    assert {r.id for r in copies.collect()} == {2} and min(r.copy for r in copies.collect()) == 3005


def test_copies_ties_and_lengths(spark):
    base = clustered(40, 4, 3)
    rows = [*base, *((1000 + i, [2 * x for x in base[0][1]]) for i in range(3)), *((2000 + i, base[1][1]) for i in range(30))]
    got, want = run(spark, rows), brute(rows)
    assert set(got) == set(want)
    assert {b for a, b in got if a == 2029} == {1, 2000, 2001, 2002, 2003}


def test_unusable_rows(spark):
    good = clustered(8, 2, 4)
    bad = [(50, None), (51, []), (52, [0.0] * DIM), (53, [float("nan")] + [1.0] * (DIM - 1)), (54, [1.0] * (DIM - 1)), (None, [1.0] * DIM), (99, [1.0] * DIM)]
    got = run(spark, [*good, *bad, good[0]], ids=[i for i, _ in good] + [50, 51, 52, 53, 54])
    assert set(got) == set(brute(good))


def test_few_and_no_rows(spark):
    assert run(spark, [(1, [1.0] * DIM)]) == {}
    assert set(run(spark, [(1, [1.0] * DIM), (2, [1.0] + [2.0] * (DIM - 1))])) == {(1, 2), (2, 1)}
    assert run(spark, [], ids=[1]) == {}


def test_quantiles():
    # of tables: chi-square 0.95 with 1, 2 and 10 degrees of freedom
    assert [round(nb.chi2_quantile(0.95, c), 3) for c in (1, 2, 10)] == [3.841, 5.991, 18.307]


def test_candidates_of_one_step_are_held_at_once():
    """All candidates of all queries were held until the last one."""
    rng = np.random.default_rng(3)
    x = nb._unit(rng.standard_normal((6000, 64)) + 2.0 * rng.standard_normal((60, 64))[np.arange(6000) % 60])
    ids, axes = np.arange(6000), np.linalg.qr(rng.standard_normal((64, 16)))[0].T.astype(np.float32)
    tracemalloc.start()
    r, c, s = nb.best_in(x, ids, x, ids, 5, axes, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.bincount(r).tolist() == [5] * 6000 and (np.diff(r) >= 0).all() and (c != r).all()
    assert peak < 150 << 20


def test_rows_asked_of_a_group_are_not_held_together(spark, monkeypatch):
    """All rows that visit a group of cells were one table in a task."""
    monkeypatch.setattr(nb, "ASKED", 40, raising=False)
    monkeypatch.setattr(nb, "ASKED_STEP", 16, raising=False)
    plans, plain = [], nb.durable
    monkeypatch.setattr(nb, "durable", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or plain(df, name))
    rng = np.random.default_rng(4)
    x = nb._unit(rng.standard_normal((900, 8))).astype(np.float32)
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "chunk_id bigint, embedding array<float>")
    got = nb.nearest(v, v.select("chunk_id"), 8, cell_rows=64)
    assert not any("CoGroups" in p for p in plans)
    every = {(r.id, r.neighbour): r.similarity for r in got.collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    np.fill_diagonal(sims, -2)
    want = {(i, int(j)) for i in range(900) for j in np.lexsort((np.arange(900), -sims[i]))[:5]}
    assert len(every) == 4500 and len(want & every.keys()) > 0.97 * 4500
    assert all(abs(sims[a, b] - s) < 2e-6 for (a, b), s in every.items())
