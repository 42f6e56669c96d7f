from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marlstone.llm.terms import term_frequencies

POSTINGS = "term string, chunk_id bigint, tf int, extra string"


def run(spark, rows, ids, **kw):
    p = spark.createDataFrame([(*r, "x") for r in rows], POSTINGS)
    c = spark.createDataFrame([(i,) for i in ids], "chunk_id bigint")
    return {r.term: (r.occurrences, r.records, r.mark) for r in term_frequencies(p, c, **kw).collect()}


def brute(rows, ids, share=0.15):
    occ, recs, live = defaultdict(int), defaultdict(set), set(ids)
    for t, c, tf in set(rows):
        if t is None or not t.strip(" \t\r\n") or c not in live or tf is None or tf <= 0:
            continue
        k = t.strip(" \t\r\n").lower()
        occ[k] += tf
        recs[k].add(c)
    n = len(set().union(*recs.values())) if recs else 0
    return {k: (occ[k], len(recs[k]), "rare" if occ[k] <= 2 else "common" if len(recs[k]) > share * n else None) for k in occ}


def test_dirty_rows(spark):
    rows = [("a", 1, 3), ("a", 1, 3), (" A ", 1, 2), (None, 1, 1), ("  ", 1, 1), ("b", 2, None), ("b", 2, 0), ("b", 3, -1), ("c", 99, 4), ("c", None, 4), ("d", 64, 1), ("d", 65, 1)]
    ids = [1, 2, 3, 64, 65]
    assert run(spark, rows, ids) == brute(rows, ids) == {"a": (5, 1, "common"), "d": (2, 2, "rare")}


def test_empty_tables(spark):
    assert run(spark, [], [1]) == {}
    assert run(spark, [("a", 1, 1)], []) == {}


def test_share_is_strict_and_ids_may_be_negative(spark):
    rows = [("t", i, 1) for i in range(-3, 0)] + [("u", i, 1) for i in range(17)]
    ids = list(range(-3, 17))
    assert run(spark, rows, ids)["t"] == (3, 3, None)  # 3 of 20 are exactly 15 %
    assert run(spark, rows, ids)["u"][2] == "common"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "A", "b ", "ß", None, ""]), st.integers(0, 200), st.sampled_from([None, -1, 1, 2, 5])), max_size=60))
def test_as_brute_force(spark, rows):
    ids = list(range(0, 200, 3))
    assert run(spark, rows, ids) == brute(rows, ids)


def test_one_hot_term(spark):
    rows = [("hot", i, 1) for i in range(5000)] + [(f"t{i}", i, 3) for i in range(5000)]
    got = run(spark, rows, range(5000))
    assert got["hot"] == (5000, 5000, "common") and got["t7"] == (3, 1, None)
