import random

import pytest

from marlstone.llm import leakage as lk

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item string")
    e = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id bigint, text string, suite string")
    return {(r.doc_id, r.item_id): (r.longest_run, r.tolerant_score) for r in lk.find_leaks(d, e).collect()}


def test_runs_and_substitutions(spark):
    w = ITEM.split()
    docs = [
        (1, "before " + " ".join(w[2:15]) + " after"), (2, "before " + " ".join(w[2:14]) + " after"), (3, ITEM.upper().replace(" ", ", ")),
        (4, " ".join(w[:7] + ["other"] + w[8:])), (5, None), (6, ""), (7, ITEM.replace("seven ", "se­ven​ ").replace("five", "ﬁve")),
        (8, " ".join(["pad"] * 20000) + " " + ITEM), (1, "nothing"),
    ]
    got = run(spark, docs, [(10, ITEM), (11, "too short to leak"), (12, None)])
    assert got == {(1, 10): (13, 13), (3, 10): (18, 18), (4, 10): (10, 15), (8, 10): (18, 18), (7, 10): (18, 18)}


def test_as_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(5, 60)))) for i in range(30)]
    docs = []
    for i in range(200):
        t = [r.choice(words) for _ in range(80)]
        for _ in range(2):
            src = r.choice(items)[1].split()
            a = r.randrange(len(src))
            part = src[a : a + r.randint(8, 20)]
            at = r.randrange(60)
            t[at : at + len(part)] = part
        docs.append((i, " ".join(t)))
    got = {p for p, (run_, _) in run(spark, docs, items).items() if run_ >= 13}
    grams = lambda t: {tuple(t.split()[k : k + 13]) for k in range(len(t.split()) - 12)}
    assert got == {(i, j) for i, t in docs for j, e in items if grams(t) & grams(e)}


def test_long_items_are_measured_whole(spark, monkeypatch):
    w = [f"w{i}" for i in range(200)]
    apart = w[:20] + ["other"] * 100 + w[120:]
    docs = [(1, "before " + " ".join(w) + " after"), (2, " ".join(w[:90] + ["other"] + w[91:])), (3, " ".join(apart)), (4, " ".join(w[:14] + ["pad"] * 9 + w[50:60] + ["other"] + w[61:71]))]
    want = {(1, 10): (200, 200), (2, 10): (109, 197), (3, 10): (80, 80), (4, 10): (14, 18)}
    assert run(spark, docs, [(10, " ".join(w))]) == want
    monkeypatch.setattr(lk, "CELLS_AT_ONCE", 150)
    index = lk.SeedIndex([10], [" ".join(w)])
    text, _, best, top, place = index.overlaps(lk.Words([t for _, t in docs], lk._Hashes()))
    assert {(docs[t][0], 10): (int(x), int(y)) for t, x, y in zip(text, best, top)} == want and place.tolist() == [1, 91, 120, 0]


@pytest.mark.parametrize("seed", range(3))
def test_diagonals_as_brute_force(seed):
    r = random.Random(seed)
    items = [[f"w{r.randrange(4)}" for _ in range(r.randint(13, 150))] for _ in range(4)]
    docs = [[f"w{r.randrange(4)}" if r.random() < 0.1 else x for x in r.choice(items)[r.randrange(9) :]] for _ in range(12)]
    index, corpus = lk.SeedIndex([*range(4)], [" ".join(x) for x in items]), lk.Words([" ".join(x) for x in docs], lk._Hashes())
    a, b = index.hits(corpus)
    want = {}
    for t, i, d in zip(corpus.text_at(a), index.words.text_at(b), (a - corpus.starts[corpus.text_at(a)]) - (b - index.words.starts[index.words.text_at(b)])):
        run_ = score = 0
        for k in range(max(0, d), min(len(docs[t]), len(items[i]) + d)):
            same = docs[t][k] == items[i][k - d]
            run_, score = (run_ + 1) * same, max(0, score + (1 if same else -lk.MISMATCH))
            best = want.get((t, i), (0, 0))
            want[t, i] = max(best[0], run_), max(best[1], score)
    text, item, best, top, _ = index.overlaps(corpus)
    assert len(want) and {(t, i): x for t, i, *x in zip(text, item, best, top)} == {p: list(x) for p, x in want.items()}


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lk, "BLOCK_BYTES", 200)
    items = [(i, f"item{i} " + ITEM) for i in range(9)]
    assert len(run(spark, [(1, ITEM)], items)) == 9


def test_sent_and_joined_items_give_the_same(spark):
    r = random.Random(8)
    items = [(i % 25, " ".join(f"w{r.randrange(6)}" for _ in range(r.randint(0, 70)))) for i in range(27)] + [(99, None), (98, "")]
    docs = [(i % 30, " ".join(f"w{r.randrange(6)}" if r.random() < 0.1 else x for x in r.choice(items[:27])[1].split())) for i in range(40)] + [(50, None), (51, "")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, words string")
    e = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id bigint, text string, no string")
    sent, joined = (sorted(map(tuple, lk.find_leaks(d, e, block_bytes=n).collect())) for n in (1 << 20, 0))
    assert sent == joined and len(sent) > 20 and any(x[2] < 13 for x in sent)
    assert lk.find_leaks(d.where("false"), e, block_bytes=0).count() == lk.find_leaks(d, e.where("item_id > 97"), block_bytes=0).count() == 0


def test_every_mask_ignores_something():
    assert all("0" in m and len(m) == lk.SPAN and m[0] == m[-1] == "1" for m in lk.MASKS)


def test_empty(spark):
    assert run(spark, [], [(1, ITEM)]) == {} and run(spark, [(1, ITEM)], []) == {}


def test_short_runs_are_refused(spark):
    with pytest.raises(ValueError):
        lk.find_leaks(spark.range(1), spark.range(1), min_words=5)
