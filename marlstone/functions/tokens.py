"""Tokenising for lexical search, as column expressions inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the words that lexical search leaves out
STOP_WORDS = (
    "a about also an and are as at be been being between but by can could during for from he her him i if "
    "in into is it its may not of on or over she should so than that the them then these they this those "
    "through to under using via was we were will with would you"
).split()

# word boundaries are ASCII ones
_START = r"(?<![A-Za-z0-9_])"
_END = r"(?![A-Za-z0-9_])"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
# fixed values: identifiers that keep their punctuation
RAW_PATTERNS = (
    r"(?i)" + _START + r"(?:10\.\d{4,9}/[^\s,;)\]\"']+|arXiv:\d{4}\.\d{4,5}(?:v\d+)?)",
    _START + r"[a-zA-Z][a-zA-Z0-9_]*(?:[+*/=<>!&%#@:|][+*/=<>!&%#@:|A-Za-z0-9_.]*)+" + _EDGE,
    _START + r"(?:[A-Z][a-z]?\d*){2,}" + _END,
    _START + r"[a-zA-Z][a-zA-Z0-9]*[_^][a-zA-Z0-9]+" + _END,
)


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits longer than one character, without stop words; null gives none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def raw_tokens(text: Column) -> Column:
    """DOIs and arXiv ids, identifiers with operators, chemical formulae, sub- and superscripts; in this order."""
    text = F.coalesce(text, F.lit(""))
    # cheap tests of what each pattern can't do without; few texts pass them
    may = (
        F.contains(text, F.lit("10.")) | text.rlike("(?i)arxiv:"),
        text.rlike("[A-Za-z0-9_][+*/=<>!&%#@:|]"),
        text.rlike("[A-Z][a-z]?[0-9]*[A-Z]"),
        F.contains(text, F.lit("_")) | F.contains(text, F.lit("^")),
    )
    none = F.array().cast("array<string>")
    found = F.concat(*(F.when(m, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for m, p in zip(may, RAW_PATTERNS)))
    return F.filter(F.transform(found, lambda t: F.lower(F.trim(t))), lambda t: F.length(t) >= 2)


def tokens(text: Column) -> Column:
    """Word tokens, then raw tokens: what a raw token repeats counts again."""
    return F.concat(word_tokens(text), raw_tokens(text))


def plain_tokens(text: Column) -> Column:
    """Runs of two or more ASCII letters and digits; no stop words, no raw tokens."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2)
