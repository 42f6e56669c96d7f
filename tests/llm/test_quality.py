import numpy as np

from marlstone.llm import quality as q

PROSE = "It is not clear whether the layers of the river are larger than those of the lake, as earlier work has shown. In the second part, we see that this is so."
LISTS = ["\n".join(f"- the {a} layers" for a in ("cold", "dense", "open", "rare", "thin")), "\n".join(f"word{chr(97 + i)}, {i}, {i + 7}, {i + 90}" for i in range(9)), "\n".join(f"{i}.1 Layers ............ {i * 7}" for i in range(1, 9))]
TABLES = ["\n".join(f"| Row{i} | {i}.5 | 99 | n/a |" for i in range(8)), "\n".join(f"Name,{i},{i * 3}.25,17" for i in range(8)), "\n".join(f"Name\t{i}\t{i * 3}.25\t17" for i in range(8))]
JUNK = ["=" * 60 + "\n" + "-" * 50, "\n".join(f"[00:00:0{i}.120] W{i} pump: id=99{i} rc=0 lag=12ms" for i in range(8)), "The layers The layers The layers The layers The layers The layers", "Dsj1XWF+pJA+j5Lo7RssCMtmDfDPBHls9sQQGuKJqJaC+zwNdepIb7oLYKPUDToB\neuogHkgHdWtnj", "Â© ;©1;Iâ:�œ| Ãœ�l »©:€l» ^ ~Ã1Ãâââ;©;Ã»|Âl:1"]


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id bigint, text string, patterns string")
    return {r.doc_id: r for r in q.text_types(df).collect()}


def test_types(spark):
    texts = [PROSE] * 20 + [PROSE.upper(), PROSE.replace(" ", "\n", 1), PROSE.replace(", ", ",\n")] + LISTS + TABLES + JUNK
    want = ["prose"] * 23 + ["list"] * 3 + ["table"] * 3 + ["junk"] * 5
    got = run(spark, texts)
    assert [got[i].text_type for i in range(len(texts))] == want
    assert all(abs(r.p_prose + r.p_list + r.p_table + r.p_junk - 1) < 1e-9 for r in got.values())


def test_forms_in_long_lines(spark):
    bit = lambda line, name: q.votes(line, False) >> [n for n, _ in q.FUNCTIONS].index(name) & 1
    index = " ".join(f"Abbott, Edward, {i}, {i + 9}-{i + 12}; Lakes, deep, {i + 3};" for i in range(40))
    references = " ".join(f"Smith, J. and Doe, K. ({1950 + i}) On the layers of lakes. River Studies {i}(2), {i}-{i + 9}." for i in range(30))
    contents = " ".join(f"{i}.1 Which Jumping Quick Zebras Mix ............ {i * 7}" for i in range(40)) + " end of the contents"
    assert [bit(x, "entry_form") for x in (index, references, contents)] == [1, 1, 1]
    few = " ".join(("abba", "baab", "acab")[i * 7 % 3] for i in range(200))
    prose = PROSE * 6 + " As was shown (1998), and then by Smith, J. in 2001, 12 of them are old. " + PROSE * 6
    assert bit(few, "few_signs") and not bit(prose, "few_signs") and not bit(prose, "entry_form")
    assert not bit(contents, "few_signs")
    got = run(spark, [PROSE] * 20 + [prose, index, few])
    assert [got[i].text_type for i in (20, 21, 22)] == ["prose", "list", "junk"]


def test_more_than_half_counts(spark):
    got = run(spark, [PROSE + "\n" + TABLES[0][:60], PROSE[:40] + "\n" + TABLES[0]])
    assert got[0].text_type == "prose" and got[1].text_type == "table"


def test_statistics(spark):
    r = run(spark, ["The cat sat.\nA 12!\nno"])[0]
    assert (r.n_chars, r.n_words) == (21, 5) and abs(r.mean_word_length - 12 / 5) < 1e-9
    assert abs(r.symbol_ratio - 2 / 16) < 1e-9 and abs(r.lines_ending_in_punctuation - 2 / 3) < 1e-9


def test_null_empty_and_long(spark):
    got = run(spark, [None, "", " \n ", " ".join(f"{PROSE} This was in {i}." for i in range(3000)), PROSE])
    assert got[0].n_chars is None and got[0].text_type is None
    assert got[1].text_type is None and got[2].text_type is None and got[2].n_chars == 3
    assert got[3].text_type == "prose"


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_fit_learns_from_agreement():
    bit = lambda *names: sum(1 << k for k, (n, _) in enumerate(q.FUNCTIONS) if n in names)
    patterns = np.array([bit("common_words", "sentence", "running_words"), bit("cells_numeric", "digit_share"), bit("cells_numeric", "digit_share", "symbol_share"), bit("symbol_share", "unspeakable")])
    share, rate = q.fit(patterns, np.array([700.0, 150.0, 50.0, 100.0]))
    names = [n for n, _ in q.FUNCTIONS]
    assert abs(share[q.PROSE] - 0.68) < 0.05 and rate[names.index("cells_numeric"), q.TABLE] > 0.8
    fired = (patterns[:, None] >> np.arange(len(names)) & 1).astype(float)
    assert q.posterior(fired, share, rate).argmax(1).tolist() == [q.PROSE, q.TABLE, q.TABLE, q.JUNK]
