"""Repair of text from scanned pages: cut words, misread characters, running headers, page numbers.

Lines are judged by form and place (a page number alone; a short title-like line between or beside lines of
running text), and by repetition: what stands as a short line of its own on several pages of a document is its running header.

What remains is running text. Its words are counted over the whole collection, and rare words
are joined with frequent ones by anagram hashes: the hash of a word is the sum of a value of each of its
characters, so what is left of it without one or two characters is a difference of numbers. Two words that leave the same rest at the
same place differ by one confusion (`e` read as `c`, `m` as `rn`): an equi-join on numbers, in SQL; the letters are compared after.
Which confusions there are is learned from these pairs: one that many rare words show, and that frequent words
don't show among each other, is a misreading and no inflection. A short table of known ones is the prior: they need a single pair.
Corrections are ranked by the support of their confusion, then by how frequent the other word is. A word cut at a line end is joined
unless the collection has it with a hyphen more often than without.

Plan: one map step over the texts, written as narrow rows; word counts pre-aggregated; joins on hashes and words. The most frequent
words can have no correction and are dropped before words are joined, so no hot word is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import durable, sent_if_small

#: (what is printed, what is read instead), in lower case
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("l", "!"), ("i", "!"), ("l", "|"), ("i", "|"), ("i", "j"), ("t", "l"), ("f", "t"),
    ("o", "0"), ("о", "0"), ("s", "5"), ("s", "$"), ("a", "@"), ("t", "†"), ("g", "9"), ("q", "9"), ("b", "8"), ("b", "6"), ("б", "6"), ("в", "8"), ("з", "3"), ("ч", "4"), ("z", "2"), ("e", "€"),
    ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("vv", "w"), ("u", "ii"), ("ii", "u"), ("n", "ri"), ("h", "li"), ("k", "lc"), ("li", "h"), ("m", "in"), ("in", "m"), ("u", "li"), ("nn", "rm"),
    ("n", "u"), ("u", "n"), ("h", "b"), ("b", "h"), ("o", "c"), ("c", "o"), ("a", "o"), ("v", "y"), ("y", "v"), ("fi", "h"), ("tt", "it"),
    ("и", "п"), ("п", "и"), ("и", "н"), ("н", "и"), ("н", "п"), ("п", "н"), ("ш", "щ"), ("щ", "ш"), ("ц", "п"), ("е", "с"), ("с", "е"), ("о", "с"), ("ы", "ьі"), ("ы", "ы1"), ("м", "и"), ("л", "п"), ("т", "г"), ("ю", "10"), ("ж", "*"), ("я", "л"),
    ("ü", "ii"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ß", "b"), ("ß", "8"), ("ł", "t"), ("ł", "l"), ("ę", "e"), ("ą", "a"),
)
#: a correction must be this much more frequent: for words with a sign among the letters, and for plain words
SIGN_RATIO, PLAIN_RATIO, MIN_FREQUENT, MIN_LENGTH = 10, 40, 5, 3
#: letters that two words must share outside of a confusion, one more for plain words, as those of three letters are often alike; pairs that a confusion not in the table needs, and how many times as many as among frequent words
MIN_REST, MIN_SUPPORT, NATURAL = 2, 5, 3
RARE_SHARE = 1e-5
#: pages of a document on which a line must stand to be its running header whatever its form
HEADER_PAGES = 3
SENT_WORDS = 300_000

_NUMBER = r"(?:\d{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})"
_PAGE = re.compile(
    rf"""\s*(?:[-–—~*·•=_|<{{\[(]\s*)*(?:(?:p(?:age|ag|g|p)?|s(?:eite)?|str(?:ona)?|с(?:тр)?|blz|pagina|página|pág)\b[.:]?\s*)?
        {_NUMBER}(?:\s*(?:/|of|von|de|di|van|z|из|sur)\s*\d{{1,5}})?(?:\s*[-–—~*·•=_|>}}\])])*\s*""",
    re.X | re.I,
)
_OPEN_LEFT = re.compile(r"^\s*[^\[({<|]*[\])}]")
_PAGE_BESIDE = re.compile(r"^\s*[\[(–-]?\s*(?:\d{1,4}|[ivxlc]{1,6})\s*[\])–-]?\s{2,}|\s{2,}[\[(–-]?\s*(?:\d{1,4}|[ivxlc]{1,6})\s*[\])–-]?\s*$")
_TOKEN = re.compile(r"(?:[^\W_]|[@†$€])+(?:[!|](?=[^\W\d_])(?:[^\W_]|[@†$€])+)*")
_FORMULA = re.compile(r"(?:[A-Z][a-z]?\d*){2,}")
_MAY_BE_FORMULA = re.compile(r"[A-Z][a-z]?\d*[A-Z]")
_COMPOUND = re.compile(r"[^\W\d_]{2,}-[^\W\d_]{2,}")
_CUT_END = re.compile(r"((?:[^\W_]|[@†$€])+)[-‐‑¬\xad=~]\s*$")
_CUT_START = re.compile(r"\s*((?:[^\W_]|[@†$€])+)")
_CELLS = re.compile(r"\||\t|\s&\s|;|\s{3,}\S+\s{3,}|,\S")
_ITEM = re.compile(r"\s*(?:[-*•]|\(?\w{1,3}[.)]|\d+(?:\.\d+)+)\s")


def _title_like(core: str) -> bool:
    words = [w for w in re.findall(r"[\w$@†8]+", core) if any(c.isalpha() for c in w)]
    long = [w for w in words if len(w) >= 4]
    if len(words) < 2 or not long or len(words) > 9 or _CELLS.search(core):
        return False
    small = sum(w[0].islower() for w in words)
    return small <= 1 and not re.search(r"[^\W\d_]{2}[.:;!?] ", core) and all(w[0].isupper() or not w[0].isalpha() for w in long)


def judge(text: str, section: str | None) -> tuple[list[str], list[str]]:
    """Lines of a chunk, and what each is: `head`, `blank`, `header`, `pageno` or `text`."""
    lines = text.replace("\r\n", "\n").split("\n")
    kinds = ["blank" if not x.strip() else "text" for x in lines]
    first = next((i for i, k in enumerate(kinds) if k == "text"), None)
    if first is None:
        return lines, kinds
    heading = (section or "").strip()
    if heading and heading != "(preamble)":
        own, named = lines[first].strip().casefold(), heading.casefold()
        if own == named or SequenceMatcher(None, own, named).ratio() > 0.75:
            kinds[first] = "head"
    body = [i for i, k in enumerate(kinds) if k == "text"]
    width = max((len(lines[i]) for i in body), default=0)
    capital = sum(lines[i].isupper() for i in body) > 0.5 * len(body)
    numeric = [i for i in body if _PAGE.fullmatch(lines[i]) and not _OPEN_LEFT.match(lines[i])]
    few = len(numeric) * 4 <= max(4, len(body)) + 4
    place = {i: k for k, i in enumerate(body)}
    for i in numeric:
        # a page number stands alone, numbers below each other are a column
        if few or not {place[i] - 1, place[i] + 1} & {place[j] for j in numeric}:
            kinds[i] = "pageno"
    for i in body:
        line = lines[i].strip()
        if kinds[i] != "text" or len(line) > 80 or len(body) < 2:
            continue
        core = _PAGE_BESIDE.sub("", line).strip()
        beside = core != line
        if not _title_like(core) or core[-1] in ".,;:?" and not beside:
            continue
        upper = core.upper() == core
        if upper and capital and not beside:
            continue  # capitals throughout: a line of the text
        if not upper and not beside and len(line) > 0.8 * width:
            continue
        kinds[i] = "header"
    return lines, kinds


def running_text(lines: list[str], kinds: list[str]) -> tuple[list[str], list[tuple[str, str]], list[tuple[int, int]]]:
    """Words of the text lines (cut words left out), the cut words' two parts, and the line pairs they join."""
    rows = [i for i, k in enumerate(kinds) if k in ("text", "head")]
    words, cuts, joins, skip = [], [], [], 0
    for i, j in zip(rows, [*rows[1:], None]):
        line, carried = lines[i], skip
        skip = 0
        end = _CUT_END.search(line) if j is not None and kinds[i] == "text" else None
        start = _CUT_START.match(lines[j]) if end else None
        good = start and end[1][-1].isalpha() and start[1][0].isalpha() and not (start[1][0].isupper() and not end[1].isupper())
        if good and sum(c.isalpha() for c in end[1]) >= 1:
            cuts.append((end[1].lower(), start[1].lower()))
            joins.append((i, j))
            skip = start.end()
            line = line[: end.start()]
            if carried > len(line):
                continue
        if kinds[i] == "text":
            part = line[carried:]
            if _MAY_BE_FORMULA.search(part):
                words += [w.lower() for w in _TOKEN.findall(part) if not (_FORMULA.fullmatch(w) and (len(w) <= 5 or sum(map(str.isdigit, w)) > 1))]
            else:
                words += _TOKEN.findall(part.lower())
            if "-" in part:
                words += [w.lower() for w in _COMPOUND.findall(part)]
    return words, cuts, joins


_FOLDED = str.maketrans({"8": "b", "$": "s", "5": "s", "0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "@": "a", "c": "e", "€": "e", "†": "t", "9": "g", "6": "b"})


def apart(lines: list[str], kinds: list[str]) -> list[tuple[int, str]]:
    """Short lines that stand apart from the running text, or are headers by their form, with a key that page numbers and look-alike signs don't change.

    Apart are a chunk's first and last line (a heading is none) and lines between blank ones, if they have two words or more.
    """
    out = []
    filled = [i for i, k in enumerate(kinds) if k not in ("blank", "head")]
    for i in filled:
        line = lines[i].strip()
        if kinds[i] not in ("text", "header") or len(line) > 80 or len(filled) < 2:
            continue
        alone = (i == 0 or kinds[i - 1] == "blank") and (i + 1 == len(lines) or kinds[i + 1] == "blank")
        if kinds[i] == "header" or alone or i in (filled[0], filled[-1]):
            core = _PAGE_BESIDE.sub("", line).casefold()
            words = [w for w in core.split() if sum(map(str.isalpha, w)) >= 3]
            if len(words) >= 2 and not _ITEM.match(line) and (kinds[i] == "header" or line[-1] not in ".,;:!?"):
                out.append((i, "".join(c for c in core.translate(_FOLDED) if c.isalpha())))
    return out


def examine(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc, page, key, header, pageno, words, cuts, lines) of every chunk; null texts have none. lines: the keys of lines apart; key: a hash of section and text."""
    place = [F.col(c).cast(t).alias(c) if c in chunks.columns else F.lit(None).cast(t).alias(c) for c, t in (("doc", "string"), ("page", "int"))]
    source = chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "section", "text", *place, F.xxhash64("section", "text").alias("key")).where("text is not null")
    cut = pa.struct([("a", pa.string()), ("b", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            header, pageno, words, cuts, keys = [], [], [], [], []
            for section, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines, kinds = judge(text, section)
                w, c, _ = running_text(lines, kinds)
                header.append("header" in kinds), pageno.append("pageno" in kinds), words.append(w), cuts.append([{"a": a, "b": b} for a, b in c])
                keys.append([k for _, k in apart(lines, kinds)])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), batch.column(4), batch.column(5), pa.array(header, pa.bool_()), pa.array(pageno, pa.bool_()), pa.array(words, strings), pa.array(cuts, pa.list_(cut)), pa.array(keys, strings)],
                ["chunk_id", "doc", "page", "key", "header", "pageno", "words", "cuts", "lines"],
            )

    return source.mapInArrow(run, "chunk_id bigint, doc string, page int, key bigint, header boolean, pageno boolean, words array<string>, cuts array<struct<a:string,b:string>>, lines array<string>")


def without_repeats(seen: DataFrame) -> DataFrame:
    """Each chunk once. Only ids and hashes are brought together; the words stay where they are as long as the repeats are few enough to be sent."""
    same = ["chunk_id", "key", "doc", "page"]
    again = seen.groupBy(*same).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    matched = [seen[c].eqNullSafe(again[c]) for c in same]
    repeats, _ = sent_if_small(seen.select(*same, "_row").join(again, matched).where(F.col("_row") > F.col("_first")).select("_row"), SENT_WORDS, "repeats")
    return seen.join(repeats, "_row", "left_anti").drop("_row", "key")


def running_headers(seen: DataFrame) -> DataFrame:
    """(chunk_id, line): keys of lines that stand apart on HEADER_PAGES pages of their document at least. Nothing for chunks without a document or page.

    Pages are counted by (doc, line) after partial aggregation; the hits are salted by chunk, as one document may hold a large share of them.
    """
    each = seen.where("doc is not null and page is not null").select("chunk_id", "doc", "page", F.explode("lines").alias("line"))
    often = each.select("doc", "line", "page").distinct().groupBy("doc", "line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= HEADER_PAGES).select("doc", "line")
    salts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt")
    salted = each.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(16)).cast("int"))
    return salted.join(often.select("doc", "line", salts), ["doc", "line", "_salt"]).select("chunk_id", "line").distinct()


# anagram hashes: each character has a value of 44 bits, a word the sum of those of its characters
def _values(word: Column) -> Column:
    return F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.shiftrightunsigned(F.xxhash64(c), 20))


def windows(words: DataFrame) -> DataFrame:
    """words (word, ...) with (at, size, piece, rest): every place of one or two characters, and the word's anagram hash without them."""
    hashed = words.withColumn("_v", _values(F.col("word"))).withColumn("_h", F.aggregate("_v", F.lit(0).cast("bigint"), lambda s, x: s + x)).withColumn("_l", F.size("_v"))

    def places(size: int) -> Column:
        return F.when(F.col("_l") >= size + MIN_REST, F.transform(F.sequence(F.lit(1), F.col("_l") - size + 1), lambda i: F.struct(
            i.alias("at"), F.lit(size).alias("size"), F.substring("word", i, F.lit(size)).alias("piece"),
            (F.col("_h") - F.aggregate(F.slice("_v", i, F.lit(size)), F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("rest"),
        ))).otherwise(F.array().cast("array<struct<at:int,size:int,piece:string,rest:bigint>>"))

    return hashed.select(*words.columns, F.explode(F.concat(places(1), places(2))).alias("_p")).select(*words.columns, "_p.at", "_p.size", "_p.piece", "_p.rest")


_SIGNED = r"[^\p{L}-]"


def confusions(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of words that one confusion separates, (word, n, correction, m, misread, printed); and the confusions learned
    from them, (misread, printed, support). vocabulary: (word, n)."""
    most = vocabulary.where(~F.col("word").rlike(_SIGNED)).agg(F.coalesce(F.max("n"), F.lit(0)).alias("_most"))
    # a word with this many occurrences has none that is SIGN_RATIO times as frequent
    rare = vocabulary.where(F.length("word") >= MIN_LENGTH).crossJoin(F.broadcast(most)).where(F.col("n") * SIGN_RATIO <= F.col("_most")).select("word", "n")
    frequent = vocabulary.where((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_FREQUENT) & ~F.col("word").rlike(_SIGNED)).select(F.col("word"), F.col("n"))
    left = windows(rare).withColumnRenamed("piece", "misread")
    right = windows(frequent).select(F.col("word").alias("correction"), F.col("n").alias("m"), "at", F.col("piece").alias("printed"), F.col("size").alias("_size"), "rest")
    met = left.join(right, ["rest", "at"]).where("misread <> printed")
    # the same letters before and after, and nothing in the confusion itself that both have at its edges
    before = F.substring("word", F.lit(1), F.col("at") - 1) == F.substring("correction", F.lit(1), F.col("at") - 1)
    after = F.substring("word", F.col("at") + F.col("size"), F.length("word")) == F.substring("correction", F.col("at") + F.col("_size"), F.length("correction"))
    edges = (F.left("misread", F.lit(1)) != F.left("printed", F.lit(1))) & (F.right("misread", F.lit(1)) != F.right("printed", F.lit(1)))
    one = ((F.length("misread") == 1) & (F.length("printed") == 1)) | edges | F.col("misread").rlike(_SIGNED)
    enough = F.col("word").rlike(_SIGNED) | (F.length("word") - F.col("size") > MIN_REST)
    pairs = durable(met.where(before & after & one & enough).select("word", "n", "correction", "m", "misread", "printed"), "pairs")
    ratio = F.when(F.col("word").rlike(_SIGNED), SIGN_RATIO).otherwise(PLAIN_RATIO)
    odd = F.col("m") >= ratio * F.col("n")
    counts = pairs.groupBy("misread", "printed").agg(F.countDistinct(F.when(odd, F.col("word"))).alias("support"), F.countDistinct(F.when(~odd & (F.col("n") >= MIN_FREQUENT), F.col("word"))).alias("natural"))
    table = pairs.sparkSession.createDataFrame([(x, y, True) for y, x in CONFUSIONS if x != y], "misread string, printed string, known boolean")  # a fixed table
    learned = counts.join(F.broadcast(table), ["misread", "printed"], "left").where(
        (F.col("support") > 0) & (F.col("known") | (F.col("support") >= MIN_SUPPORT) & (F.col("support") > NATURAL * F.col("natural")))
    ).select("misread", "printed", "support")
    return pairs.where(odd), learned


def corrections(pairs: DataFrame, learned: DataFrame) -> DataFrame:
    """(word, correction): for every word the pair whose confusion has the most support, then the most frequent correction."""
    best = Window.partitionBy("word").orderBy(F.desc("support"), F.desc("m"), "correction")
    return pairs.join(learned, ["misread", "printed"]).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("word", "correction")


#: a word of small letters with one or two other signs among them
FORM = r"^(?=(?:.*\p{Ll}){3})\p{L}*[^\p{L}-](?:\p{L}+[^\p{L}-])?\p{L}*$"


def misread_names(vocabulary: DataFrame, learned: DataFrame) -> DataFrame:
    """(word): rare words with signs among their letters that have no frequent counterpart, such as names: if all the signs are known,
    from the table or from the collection's own confusions, to be read in the place of letters."""
    signs = learned.where(F.col("misread").rlike(r"^[^\p{L}]$")).select("misread")
    table = vocabulary.sparkSession.createDataFrame([(x,) for x in sorted({x for y, x in CONFUSIONS if len(x) == 1 and (not x.isalpha() or x in "ﬁﬂ")})], "misread string")
    known = F.broadcast(signs.unionByName(table).distinct().agg(F.sort_array(F.collect_set("misread")).alias("_signs")))  # one row, as many entries as there are signs
    total = F.broadcast(vocabulary.agg(F.sum("n").alias("_total")))  # one row
    own = F.filter(F.split("word", ""), lambda c: (c != "") & (~c.rlike(r"\p{L}") | c.isin("ﬁ", "ﬂ")))
    form = vocabulary.where((F.col("word").rlike(FORM) | F.col("word").rlike("^\\p{L}+[ﬁﬂ]\\p{L}+$")) & (F.length("word") >= 5)).crossJoin(total).crossJoin(known)
    return form.where((F.col("n") <= 3 + RARE_SHARE * F.col("_total")) & (F.size(F.array_except(own, "_signs")) == 0)).select("word")


def findings(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Flags by chunk; (chunk_id, word, correction or null) of misread words; (chunk_id, a, b, joined) of cut words; (chunk_id, line) of running headers."""
    seen = without_repeats(durable(examine(chunks).withColumn("_row", F.monotonically_increasing_id()), "scans"))
    words = seen.select("chunk_id", F.explode("words").alias("word"))
    vocabulary = durable(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "vocabulary")
    pairs, learned = confusions(vocabulary)
    learned = durable(learned, "confusions")
    fixes = corrections(pairs, learned)
    names = misread_names(vocabulary, learned).join(fixes, "word", "left_anti").select("word", F.lit(None).cast("string").alias("correction"))
    all_fixes, small = sent_if_small(fixes.unionByName(names), SENT_WORDS, "corrections")
    occurring = words
    if not small:
        # words above a tenth of the most frequent one have no correction; there are few of them, whatever the input
        heavy, _ = sent_if_small(vocabulary.crossJoin(F.broadcast(vocabulary.agg(F.max("n").alias("_most")))).where(F.col("n") * SIGN_RATIO > F.col("_most")).select("word"), SENT_WORDS, "heavy")
        occurring = words.join(heavy, "word", "left_anti")
    misread = occurring.join(all_fixes, "word").select("chunk_id", "word", "correction").distinct()
    parts = seen.select("chunk_id", F.explode("cuts").alias("c")).select("chunk_id", F.col("c.a").alias("a"), F.col("c.b").alias("b")).withColumn("joined", F.concat("a", "b")).withColumn("dashed", F.concat_ws("-", "a", "b"))
    forms = parts.select("joined", "dashed").distinct()
    n = vocabulary.select("word", "n")
    evidence = (
        forms.join(n.select(F.col("word").alias("joined"), F.col("n").alias("whole")), "joined", "left")
        .join(n.select(F.col("word").alias("dashed"), F.col("n").alias("split")), "dashed", "left")
        .select("joined", "dashed", (F.coalesce("split", F.lit(0)) > F.coalesce("whole", F.lit(0))).alias("compound"))
    )
    cuts = parts.join(evidence, ["joined", "dashed"]).select("chunk_id", "a", "b", "joined", "compound")
    return seen.select("chunk_id", "header", "pageno"), misread, cuts, running_headers(seen)


def scan_traces(chunks: DataFrame) -> DataFrame:
    """(chunk_id, kind), distinct: `hyphen`, `misread`, `header` or `pageno`. Null and blank texts have none."""
    flags, misread, cuts, headers = findings(chunks)
    return (
        flags.where("header").select("chunk_id", F.lit("header").alias("kind"))
        .unionByName(headers.select("chunk_id", F.lit("header").alias("kind")))
        .unionByName(flags.where("pageno").select("chunk_id", F.lit("pageno").alias("kind")))
        .unionByName(misread.select("chunk_id", F.lit("misread").alias("kind")))
        .unionByName(cuts.where("not compound").select("chunk_id", F.lit("hyphen").alias("kind")))
        .where("chunk_id is not null")
        .distinct()
    )


def repaired(text: str, section: str | None, fixes: dict[str, str], compounds: set[str], headers: set[str] = frozenset()) -> str:
    """The text in paragraphs: no headers and page numbers, words joined and corrected, lines run on. Tables and lists keep their lines.

    headers: keys of lines (see apart) that are running headers of the document.
    """
    lines, kinds = judge(text, section)
    for i, key in apart(lines, kinds) if headers else ():
        if key in headers:
            kinds[i] = "header"
    _, cuts, joins = running_text(lines, kinds)
    glue = {i: f"{a}-{b}" in compounds for (i, _j), (a, b) in zip(joins, cuts)}
    follows = dict(joins)

    def mend(m: re.Match) -> str:
        w = m[0]
        fix = fixes.get(w.lower())
        if not fix:
            return w
        return fix.upper() if w.upper() == w and sum(c.isalpha() for c in w) > 1 else fix[0].upper() + fix[1:] if w[0].isupper() else fix

    out, paragraph = [], ""

    def flush() -> None:
        nonlocal paragraph
        if paragraph.strip():
            out.append(_TOKEN.sub(mend, paragraph.strip()))
        paragraph = ""

    table = sum(bool(_CELLS.search(x)) for x in lines) > 0.5 * max(1, kinds.count("text"))
    listed = sum(bool(_ITEM.match(x)) for x in lines) > 0.5 * max(1, kinds.count("text"))
    taken: dict[int, int] = {}  # signs at the beginning of a line that the line before has taken
    for i, (line, kind) in enumerate(zip(lines, kinds)):
        if kind == "head":
            flush()
            out.append(line.strip())
        elif kind == "text":
            begin = taken.get(i, 0)
            if table or listed:
                if i in glue:
                    cut, rest = _CUT_END.search(line), _CUT_START.match(lines[follows[i]])
                    taken[follows[i]] = rest.end()
                    line = line[: cut.end(1)] + ("-" if glue[i] else "") + rest[1]
                if line[begin:].strip():
                    out.append(_TOKEN.sub(mend, line[begin:].rstrip()))
                continue
            if i in glue:
                cut = _CUT_END.search(line)
                paragraph += line[: cut.end(1)].lstrip() + ("-" if glue[i] else "")
            else:
                paragraph += line.strip() + " "
        elif kind == "blank" and paragraph.rstrip()[-1:] in tuple(".!?:”»\")]") and paragraph.endswith(" "):
            flush()  # a blank line within a sentence is a trace of the page
    flush()
    if table or listed:
        return "\n".join(out)
    return "\n\n".join(out)


def repair(chunks: DataFrame) -> DataFrame:
    """(chunk_id, section, repaired): the text of every distinct chunk, repaired. Null texts stay null."""
    _, misread, cuts, headers = findings(chunks)
    fixes = misread.where("correction is not null").groupBy("chunk_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "correction"))).alias("fixes"))
    kept = cuts.where("compound").groupBy("chunk_id").agg(F.collect_set(F.concat_ws("-", "a", "b")).alias("compounds"))
    heads = headers.groupBy("chunk_id").agg(F.collect_set("line").alias("heads"))
    rows = chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "section", "text").distinct()

    @F.pandas_udf("string")
    def mend(text: pd.Series, section: pd.Series, fixes: pd.Series, compounds: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else repaired(t, s, dict(f) if f is not None else {}, set(c) if c is not None else set(), set(h) if h is not None else set())
            for t, s, f, c, h in zip(text, section, fixes, compounds, heads)
        ], dtype=object)

    joined = rows.join(fixes, "chunk_id", "left").join(kept, "chunk_id", "left").join(heads, "chunk_id", "left")
    return joined.select("chunk_id", "section", mend("text", "section", "fixes", "compounds", "heads").alias("repaired"))
