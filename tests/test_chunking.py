import random

from marlstone.operators import chunking as ck


def sections(spark, rows):
    return spark.createDataFrame(rows, "doc string, heading string, page int, text string")


def greedy(sents, limit):
    out, cur, n = [], [], 0
    for s in sents:
        if n + len(s) > limit and cur:
            out.append(cur)
            cur, n = [], 0
        cur.append(s)
        n += len(s)
    return [*out, cur] if cur else out


def test_greedy_packing(spark):
    r = random.Random(1)
    sents = ["W" + "x" * r.randint(5, 900) + "." for _ in range(40)]
    got = ck.chunk_sections(sections(spark, [("d", "Head", 3, " ".join(sents)), ("e", None, 1, "One."), ("f", "H", 1, " \n\n ")])).orderBy("doc", "ordinal").collect()
    want = ["Head\n\n" + " ".join(g) for g in greedy(sents, 2000)]
    assert [g.text for g in got if g.doc == "d"] == want and {g.page for g in got if g.doc == "d"} == {3}
    assert [(g.section, g.text) for g in got if g.doc == "e"] == [("(preamble)", "One.")]
    assert not [g for g in got if g.doc == "f"]


def test_long_and_exact_sentences(spark):
    long, a, b = "L" * 2500 + ".", "A" * 999 + ".", "B" * 999 + "."
    got = [g.text for g in ck.chunk_sections(sections(spark, [("d", "", 1, f"{a} {b} {long} Short.")])).orderBy("ordinal").collect()]
    assert got == [f"{a} {b}", long, "Short."]


def test_small_to_big(spark):
    sents = ["S" + "y" * 250 + "." for _ in range(20)]
    big, small = ck.small_to_big(sections(spark, [("d", "H", 1, " ".join(sents))]))
    groups = greedy(sents, 2000)
    assert [b.text for b in big.orderBy("parent").collect()] == ["H\n\n" + " ".join(g) for g in groups]
    want = [(p, i, " ".join(s)) for p, g in enumerate(groups) for i, s in enumerate(greedy(g, 600))]
    assert [(s.parent, s.ordinal, s.text) for s in small.orderBy("parent", "ordinal").collect()] == want
    assert ck.with_parent(small, big, ["doc"]).count() == len(want)


def test_lines_from_glyphs(spark):
    rows = [("d", 1, 0.0, 700.2, "Hel", 15.0, 10.0, "A"), ("d", 1, 15.0, 700.0, "lo", 10.0, 10.0, "A"), ("d", 1, 30.0, 700.4, "world", None, 12.0, "A-Bold"), ("d", 1, 0.0, 680.0, "  ", 5.0, 10.0, None), ("d", 2, 0.0, 700.0, "next", 5.0, 0.0, None)]
    g = spark.createDataFrame(rows, "doc string, page int, x double, y double, text string, width double, size double, font string")
    got = [(r.page, r.line_no, r.text, r.size, r.bold) for r in ck.group_lines(g).orderBy("line_no").collect()]
    assert got == [(1, 1, "Hello world", 12.0, True), (2, 2, "next", 0.0, False)]


def test_sections_from_lines(spark):
    rows = [("body text one", 10.0, False), ("BIG TITLE", 14.0, False), ("Second big", 13.0, False), ("under it", 10.0, False), ("2.1 Numbers here", 10.0, False), ("text a", 10.0, False), ("text b", 10.2, False), ("bold", 10.0, True), ("ABC", 10.0, False), ("Methods", 10.0, False), ("end", 10.0, False)]
    df = spark.createDataFrame([("d", 1 + i // 6, i, t, s, b) for i, (t, s, b) in enumerate(rows)], "doc string, page int, line_no int, text string, size double, bold boolean")
    got = [(r.heading, r.page, r.text) for r in ck.detect_sections(df).orderBy("ordinal").collect()]
    assert got == [("", 1, "body text one"), ("Second big", 1, "under it"), ("2.1 Numbers here", 1, "text a\ntext b"), ("Methods", 2, "end")]


def test_body_size_ties(spark):
    df = spark.createDataFrame([("d", 1, i, "t", s, False) for i, s in enumerate([12.0, 9.0, 9.1, 12.0])], "doc string, page int, line_no int, text string, size double, bold boolean")
    assert ck.body_size(df).first().body == 12.0


def test_markdown(spark):
    df = spark.createDataFrame([("d", "intro\n# One\na\nb\n## \nc\n# Empty\n##### five\n"), ("e", "plain")], "doc string, text string")
    got = [(r.doc, r.heading, r.text) for r in ck.markdown_sections(df).orderBy("doc", "ordinal").collect()]
    assert got == [("d", "", "intro"), ("d", "One", "a\nb"), ("d", "(section)", "c"), ("d", "Empty", "##### five"), ("e", "", "plain")]


def test_markdown_by_pages_or_whole(spark):
    df = spark.createDataFrame([("p", "zero\n<!-- page 7 -->\n# Not a heading\n<!-- page 9 -->\nlast"), ("q", "<!-- page 1 -->\n# H\nx"), ("w", "# only heading"), ("z", ""), ("n", None), ("r", "# A\r\nb")], "doc string, text string")
    got = [(r.doc, r.heading, r.page, r.text) for r in ck.markdown_sections(df).orderBy("doc", "ordinal").collect()]
    want = [("p", "Page 1", 1, "zero"), ("p", "Page 2", 2, "# Not a heading"), ("p", "Page 3", 3, "last"), ("q", "", 1, "<!-- page 1 -->"), ("q", "H", 1, "x")]
    assert got == [*want, ("r", "", 1, "# A\r\nb"), ("w", "", 1, "# only heading"), ("z", "", 1, "")]
    assert {r.doc: r.pages for r in ck.page_count(ck.markdown_sections(df)).collect()} == {"p": 3, "q": 1, "r": 1, "w": 1, "z": 1}


def test_scanned(spark):
    df = spark.createDataFrame([("a", "x" * 50), ("a", ""), ("b", "x" * 40), ("c", "x")], "doc string, text string")
    pages = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0), ("d", 3)], "doc string, pages int")
    assert {r.doc: r.scanned for r in ck.scanned(df, pages).collect()} == {"a": True, "b": False, "c": False, "d": True}
