"""Cutting oversized texts at natural boundaries, by dynamic programming over boundary positions.

A text longer than `limit` code points is covered by pieces of at most `limit`; every piece after the
first repeats exactly the last `overlap` characters of the piece before. Among all such covers the one
with the least sum of cut penalties, imbalance and a charge per piece is taken. Cut kinds in order of
preference: paragraph, line, sentence, clause, word, and `hard` where no other place is in reach.

Only texts over the limit travel to Python, and only their cut positions come back; the pieces are
taken as substrings on the JVM side. A row is worked on by itself: no shuffle, any input size.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
BLANKS = " \t\r\n"
KINDS = ("end", "paragraph", "line", "sentence", "clause", "word", "hard")
PENALTY = (0.0, 0.0, 1.0, 1.2, 4.0, 8.0, 60.0)
OUT = ("piece_label", "piece", "n_pieces", "piece_start", "piece_end", "piece_cut", "piece_text")
PIECE_CHARGE, IMBALANCE = 2.0, 6.0

_PATTERNS = (
    (1, re.compile(r"\n[ \t\r]*\n\s*")),
    (2, re.compile(r"[\r\n]+[ \t]*")),
    (3, re.compile(r"""[.!?…。][\])"'”’»]*\s+""")),
    (4, re.compile(r"[,;:–—]\s+")),
    (5, re.compile(r"\s+")),
)


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Every natural cut position with its strongest kind, and hard ones, a quarter of `reach` apart, where natural
    ones lie more than half of `reach` apart."""
    n = len(text)
    kind_at = {0: 0, n: 0}
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            kind_at.setdefault(m.end(), kind)
    pos = sorted(kind_at)
    step = max(1, reach // 4)
    for a, b in zip(pos, pos[1:]):
        for p in range(a + step, b, step) if b - a > reach // 2 else ():
            kind_at[p] = 6
    pos = sorted(kind_at)
    return np.array(pos, np.int64), np.array([kind_at[p] for p in pos], np.int64)


def least_cover(pos: np.ndarray, kind: np.ndarray, limit: int, reach: int, target: float) -> tuple[list[tuple[int, int]], float]:
    """The cover of least cost whose cuts are among the given positions, and its cost; infinite where there is none."""
    charge = np.array(PENALTY)[kind]
    best = np.full(len(pos), np.inf)
    best[0] = 0.0
    back = np.zeros(len(pos), np.int64)
    low = 1
    for i in range(1, len(pos)):
        while low < i and pos[i] - pos[low] > reach:
            low += 1
        size = pos[i] - pos[low:i]
        cost = best[low:i] + IMBALANCE * ((size - target) / target) ** 2
        if len(cost):
            j = int(cost.argmin())
            best[i], back[i] = cost[j], low + j
        if pos[i] <= limit:  # the first piece repeats nothing and may fill the limit
            first = IMBALANCE * ((pos[i] - target) / target) ** 2
            if first <= best[i]:
                best[i], back[i] = first, 0
        best[i] += charge[i] + PIECE_CHARGE
    cuts, i = [], len(pos) - 1
    while i:
        cuts.append((int(pos[i]), int(kind[i])))
        i = int(back[i])
    return cuts[::-1], float(best[-1])


def cut_positions(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(position, kind) of every cut, the end of the text last. Texts within the limit have no other.

    Weaker kinds are left out as long as a cover with one of them would cost more than the one found: it has no fewer
    than the least number of pieces, and no cut is cheaper than the cheapest kind in the text.
    """
    n, reach = len(text), limit - overlap
    if n <= limit:
        return [(n, 0)]
    pos, kind = boundaries(text, reach)
    pieces = 1 + -(-(n - limit) // reach)
    cheapest = min((PENALTY[k] for k in set(kind[1:-1].tolist())), default=0.0)
    for weakest in (3, 4, 6):
        kept = kind <= weakest
        cuts, cost = least_cover(pos[kept], kind[kept], limit, reach, n / pieces)
        if weakest == 6 or cost < PIECE_CHARGE * pieces + PENALTY[weakest + 1] + (pieces - 2) * cheapest:
            break
    return cuts


def _cuts_udf(limit: int, overlap: int):
    @F.pandas_udf("array<int>")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [x for c in cut_positions(t, limit, overlap) for x in c])

    # so that the plan computes it once, not for each place that reads its column
    return cuts.asNondeterministic()


def split_oversized(items: DataFrame, text: str = "text", label: str | Column | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: the columns of items but text, then piece_label, piece, n_pieces, piece_start,
    piece_end, piece_cut, piece_text.

    Texts lose blanks, tabs and line ends at their two ends first. Null and blank texts have no pieces;
    a blank or null label becomes `(preamble)`. Rows equal in all columns stay as often as they come.
    A column of items that has one of these names comes out with `_in` after it.
    piece_text is text[piece_start - overlap : piece_end] (from 0 in the first piece).
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    keep = [c for c in items.columns if c != text]
    label = F.col(label) if isinstance(label, str) else F.lit(None).cast("string") if label is None else label
    named = F.when(F.btrim(label, F.lit(BLANKS)) != "", F.btrim(label, F.lit(BLANKS))).otherwise("(preamble)")
    base = items.select(
        F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep))).alias("_row") if keep else F.lit(None).alias("_row"), named.alias("_label"), F.btrim(F.col(text), F.lit(BLANKS)).alias("_text")
    ).where("_text <> ''")
    long = F.length("_text") > limit
    flat = base.withColumn("_flat", _cuts_udf(limit, overlap)(F.when(long, F.col("_text"))))
    flat = flat.withColumn("_flat", F.coalesce("_flat", F.array(F.length("_text"), F.lit(0))))
    cuts = flat.withColumn("_n", (F.size("_flat") / 2).cast("int")).select("*", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k", "_unused"))
    start = F.when(F.col("_k") == 0, 0).otherwise(F.col("_flat")[F.col("_k") * 2 - 2])
    end = F.col("_flat")[F.col("_k") * 2]
    begin = F.greatest(start - overlap, F.lit(0))
    return cuts.select(
        *[F.col("_row")[f"c{i}"].alias(f"{c}_in" if c in OUT else c) for i, c in enumerate(keep)],
        F.col("_label").alias("piece_label"),
        F.col("_k").alias("piece"),
        F.col("_n").alias("n_pieces"),
        start.alias("piece_start"),
        end.alias("piece_end"),
        F.element_at(F.array(*map(F.lit, KINDS)), F.col("_flat")[F.col("_k") * 2 + 1] + 1).alias("piece_cut"),
        F.substring(F.col("_text"), begin + 1, end - begin).alias("piece_text"),
    )
