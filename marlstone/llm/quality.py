"""Text statistics of every document, and its text type: prose, list, table or junk.

Statistics are taken of each document and of each line. Thresholds on them are noisy labelling functions: each votes for one
type or abstains, and a line's votes, with those of its document, are one bit pattern. How often each function fires on each type is
learned by expectation-maximization from how the functions agree, over the characters of all
documents; the posterior of a pattern then gives each line's type, and the sums over its lines the document's.

Plan: one map step over the texts leaves a row per document with its few distinct patterns (written to
the shared folder, as it is used twice); one aggregation over patterns, at most 2^19 rows whatever
the input; and one map step. No document is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.wordlists import COMMON_WORDS
from marlstone.session import durable

TYPES = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words.split())
#: name and the type voted for, in the order of the bits
FUNCTIONS = (
    ("cells_numeric", TABLE), ("cells_separated", TABLE), ("digit_share", TABLE),
    ("common_words", PROSE), ("sentence", PROSE), ("running_words", PROSE),
    ("enumerated", LIST), ("entry_form", LIST), ("short_items", LIST),
    ("symbol_share", JUNK), ("few_signs", JUNK), ("unspeakable", JUNK), ("machine_form", JUNK), ("broken_signs", JUNK), ("repeated", JUNK),
    ("document_common_words", PROSE), ("document_sentences", PROSE), ("document_symbols", JUNK), ("document_word_length", JUNK),
)
LINE_FUNCTIONS = 15
#: thresholds on a document's statistics: common words, lines that end in punctuation, symbols, and the bounds of the mean word length
MANY_COMMON, MANY_SENTENCES, MANY_SYMBOLS, WORD_LENGTHS = 0.2, 0.8, 0.25, (3.2, 11.0)
N_PATTERNS = 1 << len(FUNCTIONS)
MIN_CHARS = 20
LONG, WINDOW = 400, 240

_WORD = re.compile(r"[^\W\d_]+")
_CELL = re.compile(r"\t|\s*\|\s*|\s+&\s+| {2,}|;|,(?=\S)")
_NUMERIC = re.compile(r"[<>~≈±+-]?\d[\d.,%]*|n/?a|[-–—]{0,3}|:?-+:?|", re.I)
_NONE = re.compile(r"\bn/a\b")
_CITED = re.compile(r"\s?\[(?:\d{1,3}|[^\W\d_][^\[\]]{0,60})\](?!\S*\w)")
_ENUM = re.compile(r"\s*(?:[-*•‣◦·–+]\s+\S|\(?(?:\d{1,3}|[a-z]|[ivx]{1,5})[.)]\s+\S|\[\d{1,4}\]\s+\S|\d+(?:\.\d+)+\.?\s+\S)", re.I)
_LEADER = re.compile(r"(?:\.\s?){4,}\s*\d+\s*$|…+\s*\d+\s*$")
_INDEX = re.compile(r"\s*\D{2,40}?(?:,\s*\d{1,4}(?:[-–]\d{1,4})?){1,12}\s*[.;]?\s*$")
_REFERENCE = re.compile(r"\(\d{4}[a-z]?\)[,.:]?\s*(?:pp?\.\s*)?\d+\s*[-–]\s*\d+|^\s*\S+, \S{1,3}\. .*\(?\d{4}\)?|doi:|\b\d+\s*\(\d{4}\)", re.I)
#: the same forms inside lines of LONG signs and more, where several follow each other; bounded, so that the time is linear
_LEADERS = re.compile(r"(?:(?:\.\s?){4}|…)\s{0,20}\d+")
_ENTRIES = re.compile(r"\D{2,40}?(?:,\s{0,4}\d{1,4}(?:[-–]\d{1,4})?){1,12}(?!\d)\s{0,4}[.;]?\s{0,4}")
_REFERENCES = re.compile(r"\(\d{4}[a-z]?\)[,.:]?\s{0,4}(?:pp?\.\s{0,4})?\d{1,9}\s{0,4}[-–]\s{0,4}\d+|(?<!\S)\S{1,40}, \S{1,3}\. .{0,200}?\d{4}|doi:|\b\d{1,9}\s{0,4}\(\d{4}\)", re.I)
_NUMBERS, _YEARS = re.compile(r",\s{0,4}\d"), re.compile(r"\d{4}")
_KEYS = re.compile(r"^\s*(?:key ?words|index terms|schlüsselwörter|mots[- ]clés|palabras clave|parole chiave)\b", re.I)
_MACHINE = re.compile(r"<[a-z/!][^<>]{0,200}>|^\W{0,2}[\dT:.\- ]{8,26}\W|^[0-9a-f]{6,16}[: ]\s*(?:[0-9a-f]{2,8} ){3}|\b\w+=\S+ \w+=\S+|[{}\[\]\"]{2}.*:|https?://\S{30}|\\x[0-9a-f]{2}", re.I)
_SENTENCE = re.compile(r"(?:[^\W\d_]{2,}[,;:]?\s+){4}")
_SENTENCE_END = re.compile(r"""[.!?…:][\])"'”’»]*$""")
_CLOSERS = frozenset(".!?…:)]\"'”’»*")
_MISPLACED = re.compile(r"(?:^|\s)[.,;:~^!|]+(?=[^\W\d_])|[^\W\d_][|~;.,^](?=[^\W\d_])|\s~+\s")
_RUN = re.compile(r"(\S)\1{5,}")
_VOWELS = frozenset("aeiouyäöüáéíóúàèìòùâêîôûãõåæøœąęóыаеёиоуэюяïë")
_BROKEN = re.compile("[�ÃÂâ€œ™©¤¢¬žŸ\x00\x01\x02]")
_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")


def long_contents(s: str) -> bool:
    """Whether leaders to a number come more than once in LONG signs."""
    return ("..." in s or ". ." in s or "…" in s) and sum(1 for _ in _LEADERS.finditer(s)) * LONG > len(s)


def long_entries(s: str) -> bool:
    """Whether a long line is made of index entries, references or contents: as one of them fills a short line, they
    cover nearly all of it, or come more than once in LONG signs."""
    # an entry has at most 49 signs and 14 for each of its numbers; every reference but a doi has four digits in a row
    if len(_NUMBERS.findall(s)) * 63 >= 0.9 * len(s) and sum(m.end() - m.start() for m in _ENTRIES.finditer(s)) >= 0.9 * len(s):
        return True
    if long_contents(s):
        return True
    if "19" in s or "20" in s or "18" in s or "doi" in s.lower():
        most = len(_YEARS.findall(s)) + s.lower().count("doi:")
        return most * LONG > len(s) and sum(1 for _ in _REFERENCES.finditer(s)) * LONG > len(s)
    return False


def long_few_signs(s: str) -> bool:
    """Whether more than half of a long line's windows have as few different signs as a short line of that length may."""
    starts = [*range(0, len(s) - WINDOW, WINDOW), len(s) - WINDOW]
    return 2 * sum(len(set(s[k : k + WINDOW])) <= WINDOW // 12 for k in starts) > len(starts)


def votes(line: str, repeated: bool) -> int:
    """Bits of the labelling functions that fire on a line. On repeated lines those for prose abstain."""
    s = line.strip()
    if "[" in s:
        s = _CITED.sub("", s).strip() or s
    n = len(s)
    words = _WORD.findall(_NONE.sub(" ", s.lower()) if "/" in s else s.lower())
    letters = sum(map(len, words))
    solid = max(1, n - s.count(" ") - s.count("\t"))
    digits = sum(map(s.count, "0123456789")) if letters < solid else 0
    symbols = solid - letters - digits
    common = len([1 for w in words if w in COMMON])
    usual = common >= 0.12 * len(words) if len(words) >= 4 else common * 2 >= len(words) > 0
    bits = 0
    if (digits or symbols > 2) and not (usual and letters > 0.8 * solid):
        cells = _CELL.split(s.strip("|\\ "))
        if len(cells) >= 3:
            numeric = len([1 for c in cells if _NUMERIC.fullmatch(c.strip())])
            bits |= (numeric >= 2 and numeric * 2 >= len(cells)) << 0
            bits |= (("\t" in s or " & " in s or s[0] == "|" or "   " in s) and common * 4 <= len(words)) << 1
        bits |= (digits > 0.3 * solid and common == 0) << 2
    if not repeated:
        bits |= usual << 3
        bits |= (symbols < 0.12 * solid and len(words) >= 4 and (n >= 40 or s[-1] in _CLOSERS) and _SENTENCE.search(s) is not None and (n >= 40 or _SENTENCE_END.search(s) is not None)) << 4
        bits |= (len(words) >= 3 and letters > 0.85 * solid and 2.5 <= letters / len(words) <= 12 and s.count(";") < 2) << 5
    bits |= (_ENUM.match(line) is not None) << 6
    if digits:
        leader = ("..." in s or ". ." in s or "…" in s) and _LEADER.search(s[-200:]) is not None
        bits |= bool(leader or n >= LONG and long_entries(s) or n < LONG and (_INDEX.fullmatch(s) or ("19" in s or "20" in s or "18" in s or "doi" in s) and _REFERENCE.search(s))) << 7
    elif _KEYS.match(s):
        bits |= 1 << 7
    separators = max(s.count(";"), s.count(",") if not digits else 0)
    bits |= (separators >= 2 and len(words) <= 3 * (separators + 1) and common * 6 <= len(words)) << 8
    bits |= (symbols > 0.28 * solid) << 9
    bits |= ((long_few_signs(s) if n >= LONG else n >= 8 and len(set(s)) <= max(3, n // 12)) or symbols > 0.1 * solid and _RUN.search(s) is not None and _LEADER.search(s) is None and not (n >= LONG and long_contents(s))) << 10
    if n >= 8 and (not usual or symbols > 0.2 * solid):
        odd = sum(len(w) for w in words if len(w) > 22 or len(w) > 1 and _VOWELS.isdisjoint(w))
        mixed = sum(len(t) for t in s.split() if len(t) > 24) if n > 24 else 0
        single = len([1 for w in words if len(w) == 1])
        misplaced = len(_MISPLACED.findall(s)) if symbols > 3 else 0
        bits |= (odd > 0.3 * solid or misplaced >= 3 and misplaced * 20 > n or mixed > 0.5 * solid or single > 0.4 * len(words) > 1.5) << 11
    if "<" in s or "=" in s or "{" in s or "//" in s or "\\" in s or digits > 0.2 * solid:
        bits |= (_MACHINE.search(s) is not None) << 12
    if n >= 8 and not s.isascii():
        bits |= (len(_BROKEN.findall(s)) > 0.12 * n) << 13
    return bits | repeated << 14


def _periodic(line: str) -> bool:
    """Whether a line is a fragment of its beginning over and over."""
    period = line.find(line[:10], 1)
    return 0 < period <= len(line) // 2 and line[period:] == line[:-period]


def line_patterns(text: str) -> dict[int, int]:
    """Characters (line ends included) by bit pattern; blank lines count for nothing."""
    if not text.isascii():
        text = text.replace("\u00ad", "").replace("\u200b", "")
    lines = [x for x in _LINE_END.split(text) if x and not x.isspace()]
    same = Counter(x.strip() for x in lines if len(x) >= 8) if len(lines) > 2 else {}
    many = {x for x, k in same.items() if k > 2}
    out: dict[int, int] = {}
    for x in lines:
        k = votes(x, bool(many) and x.strip() in many or len(x) >= 24 and _periodic(x.strip()))
        out[k] = out.get(k, 0) + len(x) + 1
    return out


def statistics(text: str) -> tuple:
    words = _WORD.findall(text)
    lines = [x for x in text.splitlines() if x.strip()]
    solid = sum(not c.isspace() for c in text) if not text.isascii() else len(text) - sum(map(text.count, " \n\t\r"))
    digits = sum(map(text.count, "0123456789"))
    letters = sum(map(len, words))
    return (
        len(words),
        letters / len(words) if words else None,
        max(0, solid - letters - digits) / solid if solid else None,
        sum(_SENTENCE_END.search(x.rstrip()) is not None for x in lines) / len(lines) if lines else None,
        sum(w.lower() in COMMON for w in words) / len(words) if words else None,
    )


def document_votes(stats: tuple) -> int:
    """Bits of the labelling functions on a document's statistics (see statistics)."""
    _, length, symbols, ending, common = stats
    bits = (common is not None and common >= MANY_COMMON) | (ending is not None and ending >= MANY_SENTENCES) << 1
    bits |= (symbols is not None and symbols > MANY_SYMBOLS) << 2 | (length is not None and not WORD_LENGTHS[0] <= length <= WORD_LENGTHS[1]) << 3
    return bits << LINE_FUNCTIONS


_STATS = "n_chars bigint, n_words bigint, mean_word_length double, symbol_ratio double, lines_ending_in_punctuation double, common_word_share double"


def document_patterns(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of documents: its id, statistics, and its patterns with their characters."""
    key = documents.select(doc_id).schema[0]
    source = documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    schema = f"_doc {key.dataType.simpleString()}, {_STATS}, patterns array<int>, chars array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            stats = [statistics(t or "") for t in texts]
            each = [{k | v: n for k, n in line_patterns(t).items()} if t else {} for t, v in zip(texts, map(document_votes, stats))]
            columns = [pa.array([len(t) if t is not None else None for t in texts], pa.int64()), pa.array([s[0] for s in stats], pa.int64())]
            columns += [pa.array([s[k] for s in stats], pa.float64()) for k in range(1, 5)]
            columns += [pa.array([[*e] for e in each], pa.list_(pa.int32())), pa.array([[*e.values()] for e in each], pa.list_(pa.int32()))]
            names = [x.split()[0] for x in _STATS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_doc", *names, "patterns", "chars"])

    return source.mapInArrow(run, schema)


def fit(patterns: np.ndarray, weight: np.ndarray, rounds: int = 60, anchor: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Type shares, and each function's rate of firing on each type, by expectation-maximization.

    A function has two rates: on the type it votes for, and a wrong one on all other types together.
    It starts as right more often than not; pseudo-counts in proportion to the whole weight (anchor)
    keep types from trading places and behave alike at every size.
    """
    voted = np.array([t for _, t in FUNCTIONS])
    right = np.where(voted == PROSE, 0.85, 0.4)  # signs of prose come together, those of the rest one by one
    wrong = np.where(voted == PROSE, 0.1, 0.03)
    # a document's figures say less of a single line
    wrong[LINE_FUNCTIONS:] = np.where(voted[LINE_FUNCTIONS:] == PROSE, 0.4, 0.05)
    start = np.where(voted[:, None] == np.arange(len(TYPES))[None, :], right[:, None], wrong[:, None])
    rate, share = start.copy(), np.full(len(TYPES), 1 / len(TYPES))
    if not len(patterns):
        return share, rate
    fired = (patterns[:, None] >> np.arange(len(FUNCTIONS)) & 1).astype(float)
    every = np.arange(len(FUNCTIONS))
    pseudo = anchor * weight.sum() / len(TYPES)
    for _ in range(rounds):
        post = posterior(fired, share, rate)
        mass = weight[:, None] * post
        total = mass.sum(0)
        share = (total + pseudo) / (total + pseudo).sum()
        hits = fired.T @ mass + pseudo * start
        right = hits[every, voted] / (total + pseudo)[voted]
        wrong = (hits.sum(1) - hits[every, voted]) / ((total + pseudo).sum() - (total + pseudo)[voted])
        rate = np.repeat(np.minimum(wrong, 0.5 * right)[:, None], len(TYPES), 1)
        rate[every, voted] = right
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
    return share, rate


def posterior(fired: np.ndarray, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    log = np.log(share) + fired @ np.log(rate) + (1 - fired) @ np.log1p(-rate)
    log -= log.max(1, keepdims=True)
    p = np.exp(log)
    return p / p.sum(1, keepdims=True)


def text_types(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of documents: doc_id, the statistics, p_prose, p_list, p_table, p_junk, text_type.

    p_x is the expected share of the characters (of non-blank lines) that are of type x. text_type is
    prose unless more than half of the characters are expected not to be; then the largest other type.
    Null, empty and blank texts have null shares and type; null text has null n_chars, too.
    """
    each = durable(document_patterns(documents, doc_id, text), "patterns")
    counts = (
        each.select(F.explode(F.arrays_zip("patterns", "chars")).alias("x"))
        .groupBy(F.col("x.patterns").alias("pattern"))
        .agg(F.sum("x.chars").alias("chars"))
        .toArrow()  # at most N_PATTERNS rows
    )
    share, rate = fit(counts.column("pattern").to_numpy().astype(np.int64), counts.column("chars").to_numpy().astype(float))
    every = (np.arange(N_PATTERNS)[:, None] >> np.arange(len(FUNCTIONS)) & 1).astype(float)
    shipped = each.sparkSession.sparkContext.broadcast(posterior(every, share, rate))
    names = [x.split()[0] for x in _STATS.split(", ")]
    kept = ["_doc", *names]
    schema = f"_doc {each.schema['_doc'].dataType.simpleString()}, {_STATS}, p_prose double, p_list double, p_table double, p_junk double, text_type string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in batches:
            p, c = batch.column(len(kept)), batch.column(len(kept) + 1)
            size = np.diff(p.offsets.to_numpy())
            mass = table[p.flatten().to_numpy()] * c.flatten().to_numpy()[:, None]
            sums = np.zeros((len(size), len(TYPES)))
            np.add.at(sums, np.repeat(np.arange(len(size)), size), mass)
            with np.errstate(invalid="ignore"):
                sums /= sums.sum(1, keepdims=True)
            kind = np.where(sums[:, 0] < 0.5, 1 + sums[:, 1:].argmax(1), 0)
            none = size == 0
            columns = [pa.array(sums[:, k], mask=none) for k in range(len(TYPES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns, pa.array(np.array(TYPES, object)[kind], pa.string(), mask=none)], [*kept, "p_prose", "p_list", "p_table", "p_junk", "text_type"])

    return each.mapInArrow(run, schema).withColumnRenamed("_doc", doc_id)
