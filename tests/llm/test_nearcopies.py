import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import nearcopies as nc

WORDS = [f"w{i}" for i in range(300)]


def variants(seed, n=30, copies=4):
    r, rows = random.Random(seed), []
    for g in range(n):
        base = [r.choice(WORDS) for _ in range(r.randint(15, 70))]
        for c in range(copies):
            x = base[:]
            for _ in range(c):
                x[r.randrange(len(x))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(x)))
    return rows


def brute(rows, t=0.6):
    sets = {}
    for i, text in rows:
        w = nc._WORD.findall((text or "").lower())
        if i is not None and len(w) >= 20:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "chunk_id bigint, text string, set string")
    links, members = nc.near_copies(df)
    return links, members, {(r.a, r.b) for r in nc.all_pairs(links, members).collect()}


def test_as_brute_force(spark):
    rows = variants(1)
    assert run(spark, rows)[2] == brute(rows)


def test_hot_groups_are_laid_out_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(nc, "TILE_ROWS", 5)
    rows = variants(2, n=3, copies=25)
    assert run(spark, rows)[2] == brute(rows)


@pytest.mark.parametrize("stream", [4, 1 << 20])
def test_hot_shingles_stream_through_several_tasks(spark, monkeypatch, stream):
    monkeypatch.setattr(nc, "TILE_ROWS", 3)
    monkeypatch.setattr(nc, "STREAM_ROWS", stream)
    rows = variants(5, n=9, copies=4)
    assert run(spark, rows)[2] == brute(rows)
    sets = nc.shingled(spark.createDataFrame(rows, "chunk_id bigint, text string"), "chunk_id", "text", 3, 20).dropDuplicates(["h1", "h2"])
    laid = nc.tiled(nc.prefixes(sets, nc.frequency_table(sets), 0.6, 7), 0.6, 3)
    tiles = [nc.Rows.unpack(bytes(r.tile)) for r in laid.where("tile is not null").collect()]
    assert tiles and max(len(t.ids) for t in tiles) <= 3 and all((t.n[1:] >= t.n[:-1]).all() for t in tiles)


def test_shingles_of_one_class_have_no_row(spark):
    rows = [(1, " ".join(WORDS[:30])), (2, " ".join(w + "q" for w in WORDS[:30]))]
    sets = nc.shingled(spark.createDataFrame(rows, "chunk_id bigint, text string"), "chunk_id", "text", 3, 20)
    assert nc.prefixes(sets, nc.frequency_table(sets), 0.6, 3).count() == 0


def test_dirty_rows(spark):
    long = " ".join(WORDS * 40)
    text = " ".join(WORDS[:30])
    rows = [(1, text), (2, text.upper()), (2, text.upper()), (3, None), (4, ""), (5, "few words"), (None, text), (6, text + ", !"), (7, long), (8, long + " end"), (9, " ".join(["same"] * 50)), (10, " ".join(["same"] * 90))]
    links, members, pairs = run(spark, rows)
    assert pairs == {(1, 2), (1, 6), (2, 6), (7, 8), (9, 10)}
    assert {r.id: r.rep for r in members.collect()} == {1: 1, 2: 1, 6: 1, 7: 7, 8: 8, 9: 9, 10: 9}


def test_exactly_the_threshold_counts(spark):
    a, b = WORDS[:22], WORDS[:17] + ["x1", "x2", "x3", "x4", "x5"]  # 20 shingles each, 15 shared: 15 / 25
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    assert run(spark, rows)[2] == {(1, 2)} == brute(rows)


def test_groups(spark):
    rows = variants(3, n=6)
    links, members, pairs = run(spark, rows)
    group = {r.id: r.group for r in nc.groups(links, members).collect()}
    want = {i: i for i in group}
    for _ in range(10):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert group == want


def test_sorted_sets_are_merged(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, -i, sorted(r.sample(range(-50, 50), r.randint(0, 60))), sorted(r.sample(range(-50, 50), r.randint(1, 60)))) for i in range(40)]
    monkeypatch.setattr(nc, "ROWS_AT_ONCE", 7)
    pairs = spark.createDataFrame(rows, "a bigint, b bigint, x array<bigint>, y array<bigint>")
    assert {tuple(x) for x in nc.intersected(pairs).collect()} == {(a, b, len({*x} & {*y}), len({*x} | {*y})) for a, b, x, y in rows}
    assert nc.intersected(pairs.where("false")).count() == 0


@pytest.mark.parametrize("order", ["shuffled", "falling"])
def test_long_chains_are_one_group(spark, monkeypatch, order):
    ids = [1, *range(200, 1, -1)]
    if order == "shuffled":
        random.Random(4).shuffle(ids)
    chain = list(zip(ids, ids[1:])) + [(301, 302)]
    links = spark.createDataFrame([(min(x), max(x), 0.7) for x in chain], "a bigint, b bigint, similarity double")
    members = spark.createDataFrame([(i, i) for i in [*ids, 301, 302, 303]] + [(400, 1)], "id bigint, rep bigint")
    rounds, write = [], nc.durable
    monkeypatch.setattr(nc, "durable", lambda df, name: rounds.append(name) or write(df, name))
    got = {r.id: (r.group, r.links) for r in nc.groups(links, members).collect()}
    assert {i: g for i, (g, _) in got.items()} == {**dict.fromkeys([*ids, 400], 1), 301: 301, 302: 301, 303: 303}
    assert sum(k for _, k in got.values()) == 2 * len(chain) + got[400][1] and got[303][1] == 0
    assert rounds.count("labels") <= 16  # the first labels count as one


def test_empty(spark):
    links, members, pairs = run(spark, [])
    assert pairs == set() and nc.groups(links, members).count() == 0


@pytest.mark.parametrize("n", [3, 1000])
def test_frequency_table_counts_all(spark, n):
    df = spark.range(n).select(F.array(F.lit(5).cast("bigint"), F.col("id") + 100).alias("set"))
    table = nc.frequency_table(df)
    assert (table > 0).sum() in (n + 1, n) and table.max() == min(255, int(-(-8 * __import__("math").log2(1 + n) // 1)))
