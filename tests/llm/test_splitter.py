import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm.splitter import _PATTERNS, IMBALANCE, KINDS, PENALTY, PIECE_CHARGE, cut_positions, split_oversized


def pieces(text, limit, overlap):
    out, start = [], 0
    for end, kind in cut_positions(text, limit, overlap):
        out.append((text[max(0, start - overlap) : end], start, KINDS[kind]))
        start = end
    return out


def check(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert all(len(p) <= limit for p, _, _ in got)
    assert "".join(p[min(overlap, s) :] for p, s, _ in got) == text
    return got


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n,é漢", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_places_first():
    text = "\n\n".join("This is a sentence of some words. " * 12 for _ in range(12))
    assert {k for _, _, k in check(text, 2000, 200)} <= {"paragraph", "end"}
    assert {k for _, _, k in check("word " * 2000, 2000, 200)} <= {"word", "end"}
    assert "hard" in {k for _, _, k in check("x" * 5000, 2000, 200)}


@pytest.mark.parametrize("words", range(400, 410))
def test_long_runs_with_a_natural_cover_are_not_cut(words):
    text = "ab " * words + "x" * 1799 + " " + "ab " * 400
    assert "hard" not in {k for _, _, k in check(text, 2000, 200)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aab .\n,", min_size=40, max_size=260), st.integers(30, 60), st.integers(0, 4))
def test_least_cost_of_all_boundaries(text, limit, overlap):
    if len(text) <= limit:
        return
    reach = limit - overlap
    kind_at = {0: 0, len(text): 0}
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            kind_at.setdefault(m.end(), kind)
    pos = sorted(kind_at)
    target = len(text) / (1 + -(-(len(text) - limit) // reach))
    price = lambda a, b, k: IMBALANCE * ((b - a - target) / target) ** 2 + PENALTY[k] + PIECE_CHARGE
    best = {0: 0.0}
    for b in pos[1:]:
        best[b] = min((best[a] + price(a, b, kind_at[b]) for a in pos if a < b and b - a <= (reach if a else limit)), default=float("inf"))
    cuts = cut_positions(text, limit, overlap)
    got = sum(price(a, b, k) for a, (b, k) in zip([0, *(p for p, _ in cuts)], cuts))
    assert got <= best[len(text)] + 1e-6


def test_exactly_the_limit_is_one_piece():
    assert len(cut_positions("a" * 2000)) == 1 and len(cut_positions("a" * 2001)) == 2


def test_very_long_text():
    check("A sentence here. " * 60_000, 2000, 200)


def test_rows(spark):
    rows = [(1, "Head", "  \n" + "A b c. " * 400 + "\n"), (2, "", "short"), (3, None, None), (4, "x", " \t\n"), (5, "H", "y" * 2000), (2, "", "short")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, heading string, text string, piece string")
    got = split_oversized(df, label="heading").orderBy("id", "piece").collect()
    assert {r.id for r in got} == {1, 2, 5}
    assert [r.piece_text for r in got if r.id == 2] == ["short", "short"]
    one = [r for r in got if r.id == 1]
    text = ("A b c. " * 400).strip()
    assert one[0].n_pieces == len(one) == 2 and one[0].piece_label == "Head" and one[0].piece_in == "clash"
    assert one[1].piece_text[:200] == one[0].piece_text[-200:] and one[0].piece_text + one[1].piece_text[200:] == text
    assert [r.piece_label for r in got if r.id == 2] == ["(preamble)"] * 2
    assert split_oversized(df.where("false")).count() == 0


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        split_oversized(spark.range(1).selectExpr("'a' as text"), limit=10, overlap=10)
