import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions import tokens as tk


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values[k] for k in names)], schema).select(column.alias("x")).first().x


def t(spark, f, value):
    return one(spark, f(F.col("t")), t=value)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see 10.1234/ab.c, then", ["10.1234/ab.c"]),
        ("arXiv:2004.14974v2 here", ["arxiv:2004.14974v2"] * 2),  # also an identifier with an operator
        ("C++ is", []),
        ("a=b", ["a=b"]),
        ("NaCl and H2O", ["nacl", "h2o"]),
        ("m_pq x^2", ["m_pq", "x^2"]),
        ("ÉTION", ["tion"]),
        ("", []),
    ],
)
def test_raw_tokens(spark, text, want):
    assert t(spark, tk.raw_tokens, text) == want


def test_word_tokens(spark):
    assert t(spark, tk.word_tokens, "The quick brown Fox jumps") == ["quick", "brown", "fox", "jumps"]
    assert t(spark, tk.word_tokens, "the of a") == [] == t(spark, tk.word_tokens, None)
    assert t(spark, tk.plain_tokens, "The a x2") == ["the", "x2"]
    assert t(spark, tk.tokens, "NaCl H2O") == ["nacl", "h2o", "nacl", "h2o"]
    assert len(tk.STOP_WORDS) == 59


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One. Two here! three (no). (Four) \"q\". \"Five\"", ["One.", "Two here! three (no).", "(Four) \"q\".", "\"Five\""]),
        ("A b\n\nC d", ["A b", "C d"]),
        ("  \n\n ", []),
        ("end. lower", ["end. lower"]),
    ],
)
def test_sentences(spark, text, want):
    assert t(spark, tx.sentences, text) == want


def test_identifiers(spark):
    assert t(spark, tx.to_doi, "DOI: 10.1000/xyz") == "10.1000/xyz"
    assert t(spark, tx.to_doi, "https://doi.org/10.1000/xyz") == "10.1000/xyz"
    assert t(spark, tx.to_doi, "arXiv: 2004.14974") == "10.48550/arXiv.2004.14974"
    assert t(spark, tx.to_doi, "paper.pdf") is None and t(spark, tx.to_doi, "arXiv:foo") is None
    assert t(spark, tx.to_doi, "DOI: https://doi.org/10.1234/ab") == "10.1234/ab"
    assert t(spark, tx.to_doi, "ARXIV:2004.14974v2") == "10.48550/arXiv.2004.14974v2"
    assert [t(spark, tx.source_slug, s) for s in ("http://x/a b.pdf", "http://x/", "2004.14974", "/srv/My paper.PDF", "doi:10.1000/xy")] == ["a-b", "document", "2004-14974", "My-paper", "doi-10-1000-xy"]
    assert [t(spark, tx.source_kind, s) for s in ("http://x/y.pdf", "2004.14974", "10.1/x", "10.1000/x", "a/b.pdf")] == ["url", "arxiv", "file", "doi", "file"]
    assert t(spark, tx.base_name, "/srv/a b.PDF") == "a b"
    assert t(spark, tx.safe_stem, "a b(1).pdf") == "a_b_1_"


def test_slug_and_hash(spark):
    h = 5381
    for c in "héllo":
        h = (h * 33 + ord(c)) % 2**32
    assert t(spark, tx.simple_hash, "héllo") == str(h)
    assert t(spark, tx.simple_hash, "") == "5381"
    h = 5381
    for c in (0x61, 0xD83D, 0xDE00):  # beyond the basic plane a sign has two units
        h = (h * 33 + c) % 2**32
    assert t(spark, tx.simple_hash, "a\U0001f600") == str(h)
    assert t(spark, tx.slugify, "--A b!c--") == "A-b-c" and t(spark, tx.slugify, "!!") == "paper"
    long = t(spark, tx.slugify, "x" * 70)
    assert len(long) == 60 and long.startswith("x" * 51 + "-")


def test_markup(spark):
    assert t(spark, tx.strip_xml, "<p>a &lt; b</p>\n<i>c</i>") == "a < b c"
    assert t(spark, tx.strip_xml, "x &amp;quot; y &apos;z&apos;&nbsp;<>") == "x \" y 'z'&nbsp;<>"
    assert t(spark, tx.strip_xml, "a\u00a0\u2003b") == "a b" and t(spark, tx.strip_xml, None) is None
    assert t(spark, tx.leaf_markdown, "&eacute;&hellip;&#x41; <b>open") == "é…A open"
    assert t(spark, tx.leaf_markdown, "<b class='x'>p</b><span>q</span>") == "pq"
    assert t(spark, tx.leaf_markdown, "<p><b>x</b> <i>y</i><br/>z &amp; w</p>") == "**x** *y*\nz & w"
    assert t(spark, tx.leaf_markdown, "<tr><td>a</td><td>b</td></tr>") == "a | b |"
    assert t(spark, tx.leaf_markdown, '<math display="block"> x^2 </math>') == "$$\nx^2\n$$"
    assert t(spark, tx.leaf_markdown, "<math>y</math>") == "$y$"


@pytest.mark.parametrize("mark", ["<!-- page 2 -->", "----- page 2 -----", "===== Page 2 =====", "## page 2", "\f"])
def test_page_markers(spark, mark):
    assert t(spark, tx.page_pieces, f"first\n{mark}\nsecond") == ["first", "second"]
    assert t(spark, tx.page_pieces, f"{mark}\n \n{mark} only") == ["only"]


def test_marked_pages(spark):
    got = t(spark, tx.marked_pages, "zero <!-- page 3 --> three <!-- page 4 -->  <!-- page 9 -->nine")
    assert [(p.page, p.text) for p in got] == [(3, "three"), (9, "nine")]
    assert [(p.page, p.text) for p in t(spark, tx.marked_pages, " no marker ")] == [(1, "no marker")]
    assert [(p.page, p.text) for p in t(spark, tx.marked_pages, "")] == [(1, "")]
    assert t(spark, tx.guessed_pages, "<!-- page 3 --> as shown on page 412") == 3
    assert t(spark, tx.guessed_pages, "## Page 7\n===== page 9 =====\n\f") == 9 and t(spark, tx.guessed_pages, "----- page 0 -----") == 1
    assert t(spark, tx.guessed_pages, "<!-- page 3 --> <!-- page 12 -->") == 12 and t(spark, tx.guessed_pages, "none") == 1


def test_small_things(spark):
    assert t(spark, tx.chunk_title, "\n<!-- page 1 -->\n## Title here\nrest") == "Title here"
    assert t(spark, tx.chunk_title, "see ----- page 3 ----- of it") == "see ----- page 3 ----- of it" and t(spark, tx.chunk_title, " \n<!-- page 2 -->") == ""
    assert one(spark, tx.page_set(F.col("s"), F.col("n")), s="3rd, 5abc, 2, -4, 99999999999, x", n=8) == [2, 3, 5]
    assert one(spark, tx.page_set(F.col("s"), F.col("n")), s="9999999999-6", n=8) == [6, 7, 8] and one(spark, tx.page_set(F.col("s"), F.col("n")), s="1", n=0) == []
    assert one(spark, tx.page_set(F.col("s"), F.col("n")), s="5-1,7,99", n=8) == [1, 2, 3, 4, 5, 7]
    assert one(spark, tx.page_set(F.col("s"), F.col("n")), s="all", n=3) == [1, 2, 3]
    assert t(spark, tx.csv_list, " a, ,b ") == ["a", "b"] and t(spark, tx.csv_list, None) == []
    assert one(spark, tx.clamped(F.col("n"), 1, 20, 10), n=99) == 20
    assert [one(spark, tx.backoff_ms(F.col("n")), n=n) for n in (1, 5, 6)] == [30000, 480000, 600000]
    assert t(spark, tx.retryable, "HTTP 503 from server") and not t(spark, tx.retryable, "bad pdf") and t(spark, tx.retryable, None) is False
    assert t(spark, tx.ocr_label, "pdfjs") == "none (pdfjs)" and t(spark, tx.ocr_label, "new") == "new"
