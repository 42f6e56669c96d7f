"""Language of documents and of passages in another language, by compression.

A text is in the language whose dictionary compresses it best: every language has a raw-content zstandard
dictionary, each sentence is compressed with all of them, and a chunk is cut into runs of sentences so
that the compressed bytes, plus a charge for each change of language, are least. A run whose best and
second best sizes differ by less than MIN_MARGIN stays without a language.

A sentence is first compressed with the likely dictionaries only: that of the sentence before, those its function words speak for,
and the rival of each, which is the dictionary that compresses the other's content best. Wrong dictionaries compress about equally badly,
so where the best of these lies SURE_MARGIN below the next one, the rest are not tried and count as the worst of those tried; else all are.

Fitting takes a bounded sample of labelled rows (SAMPLE_DOCS documents a language, SAMPLE_CHUNKS chunks of
each, of up to SAMPLE_CHARS characters). Labels are noisy and documents mixed, so each sentence of the sample
is first put where its words fit best, and dropped where that isn't the language of its label.

Plan: the texts pass one map step and are not shuffled; what follows are narrow rows, one per run.
Sums by document are pre-aggregated; the join back to the documents is salted, unless these are few enough, by their number, to be sent.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.wordlists import COMMON_WORDS
from marlstone.session import durable, sent_if_small

# fixed values: ISO 639-1, 639-2 (both forms) and the English name
NAMES = {
    "de": ("de", "deu", "ger", "german"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "fre", "french"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "pl": ("pl", "pol", "polish"),
    "pt": ("pt", "por", "portuguese"),
    "ru": ("ru", "rus", "russian"),
}
SAMPLE_DOCS, SAMPLE_CHUNKS, SAMPLE_CHARS = 150, 2, 20_000
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
CHANGE_BYTES, MIN_MARGIN, MIN_WORDS = 10, 0.06, 4
SURE_MARGIN, RIVAL_BYTES, KEPT_SENTENCES = 0.15, 4000, 1 << 15
SALTS = 16
_END = re.compile(r"""(?<=[.!?…])["»”’)\]]*\s+(?=["«“‘(\[¿¡]*[^\W_a-zà-öø-ÿ])""")
_CUT = re.compile(r"(?<=\w)[-‐¬\xad]\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def label_language(label: Column) -> Column:
    """The language a label names, or null: code or English name, any case, with or without a region."""
    plain = F.lower(F.btrim(label, F.lit(" \t\r\n")))
    head = F.regexp_extract(plain, r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(head.isin(*names), code).otherwise(out)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text; together they cover it."""
    edges = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def plain(text: str) -> str:
    """One lower-cased line, words joined that a hyphen cuts at a line end."""
    return " ".join(_CUT.sub("", text).lower().split())


def clean_sample(rows: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Sentences by language, of (language, text) rows with noisy labels; two rounds of naive Bayes on words."""
    known: dict[str, int] = {}
    common = {k: [known.setdefault(w, len(known)) for w in v.split()] for k, v in COMMON_WORDS.items()}
    units = [
        (lang, s, np.array([known.setdefault(w, len(known)) for w in _WORD.findall(s)], np.int32)) for lang, t in rows for a, b in sentences(t) if len(s := plain(t[a:b])) > 20
    ]  # numbers: the sample's words as strings take a multiple of its texts
    kept = units
    for _ in range(2):
        counts = {k: np.zeros(len(known), np.int64) for k in NAMES}
        for k, v in common.items():
            counts[k][v] = 20
        for lang, _s, words in kept:
            np.add.at(counts[lang], words, 1)
        logs = {k: np.array([math.log(x) for x in ((c + 0.5) / (int(c.sum()) + 20_000)).tolist()]) for k, c in counts.items()}

        def score(words: np.ndarray, k: str) -> float:
            return sum(logs[k][words].tolist())

        best = [max(NAMES, key=lambda k: score(words, k)) if len(words) >= MIN_WORDS else None for _, _, words in units]
        kept = [u for u, k in zip(units, best) if u[0] == k]
    out: dict[str, list[str]] = {k: [] for k in NAMES}
    for lang, s, _w in kept:
        out[lang].append(s)
    return out


def dictionaries(samples: dict[str, list[str]], size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """The last `size` bytes of each language's sentences, after its function words."""
    return {k: " ".join([COMMON_WORDS[k], *samples.get(k, [])]).encode()[-size:] for k in NAMES}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        import zstandard

        self.langs, self._by, self._kept = [*content], [], {}
        for data in content.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self._by.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))
        self._speaks: dict[str, list[int]] = {}
        for k, lang in enumerate(self.langs):
            for w in COMMON_WORDS.get(lang, "").split():
                self._speaks.setdefault(w, []).append(k)
        self._rival = []
        for k, data in enumerate(content.values()):
            size = [len(c.compress(data[-RIVAL_BYTES:])) if j != k else 1 << 30 for j, c in enumerate(self._by)]
            self._rival.append(size.index(min(size)))

    def sizes(self, text: str) -> list[int]:
        data = text.encode("utf-8", "replace")
        return [len(c.compress(data)) for c in self._by]

    def likely_sizes(self, text: str, words: list[str], before: int | None) -> list[int]:
        """sizes(), with the worst size tried in the place of those that need not be tried."""
        votes = [0] * len(self._by)
        for w in words:
            for k in self._speaks.get(w, ()):
                votes[k] += 1
        first = votes.index(max(votes))
        tried = {first, self._rival[first]}
        if before is not None:
            tried |= {before, self._rival[before]}
        votes[first] = -1
        tried.add(votes.index(max(votes)))
        data = text.encode("utf-8", "replace")
        got = {k: len(self._by[k].compress(data)) for k in tried}
        best, second = sorted(got.values())[:2]
        if second - best < SURE_MARGIN * second:
            return [got[k] if k in got else len(c.compress(data)) for k, c in enumerate(self._by)]
        worst = max(got.values())
        return [got.get(k, worst) for k in range(len(self._by))]

    def runs(self, text: str) -> list[tuple]:
        """(start, end, sentences, letters, language or None, confidence) of every run of sentences.

        Stretches with fewer than MIN_WORDS words belong to the run before (or the first run).
        """
        spans, units, before = sentences(text), [], None
        for a, b in spans:
            s = plain(text[a:b])
            got = self._kept.get((s, before))
            if got is None:
                words = _WORD.findall(s)
                letters = sum(map(len, words))
                got = (letters, self.likely_sizes(s, words, before)) if len(words) >= MIN_WORDS and letters * 2 >= len(s.replace(" ", "")) else (letters, None)
                if len(self._kept) >= KEPT_SENTENCES:
                    self._kept.clear()
                self._kept[s, before] = got
            if got[1] is not None:
                units.append((a, b, *got))
                before = got[1].index(min(got[1]))
        if not units:
            return []
        firsts = [u[3].index(min(u[3])) for u in units]
        path = firsts
        if any(k != firsts[0] for k in firsts):
            path = self._path(np.array([u[3] for u in units], float))
        out, i = [], 0
        while i < len(path):
            j = i
            while j < len(path) and path[j] == path[i]:
                j += 1
            total = [sum(x) for x in zip(*(u[3] for u in units[i:j]))] if j - i > 1 else units[i][3]
            second = sorted(total)[1]
            margin = (second - total[path[i]]) / second
            lang = self.langs[path[i]] if margin >= MIN_MARGIN else None
            end = units[j][0] if j < len(units) else len(text)
            out.append((units[i][0] if i else 0, end, j - i, sum(u[2] for u in units[i:j]), lang, float(margin)))
            i = j
        return out

    @staticmethod
    def _path(cost: np.ndarray) -> list[int]:
        """The language of each sentence for the least sum of sizes and charges."""
        best, back = cost[0].copy(), []
        for row in cost[1:]:
            k = int(best.argmin())
            change = best[k] + CHANGE_BYTES < best
            back.append(np.where(change, k, np.arange(len(best))))
            best = np.where(change, best[k] + CHANGE_BYTES, best) + row
        path = [int(best.argmin())]
        for step in back[::-1]:
            path.append(int(step[path[-1]]))
        return path[::-1]


def latest_docs(docs: DataFrame, slug: str = "slug", lang: str = "lang", at: str = "created_at") -> DataFrame:
    """(doc, named): the language named by the row with the latest time; of equal times the greater label holds."""
    return docs.where(F.col(slug).isNotNull()).groupBy(F.col(slug).alias("doc")).agg(F.max(F.struct(F.col(at).alias("at"), F.col(lang).alias("label"))).alias("m")).select("doc", label_language(F.col("m.label")).alias("named"))


def fit(docs: DataFrame, chunks: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the bounded sample of labelled rows (see the module's head)."""
    order = Window.partitionBy("named").orderBy(F.xxhash64("doc"), "doc")
    some = latest_docs(docs).where("named is not null").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE_DOCS).select("doc", "named")
    rows = chunks.select("doc", "chunk_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    first = Window.partitionBy("doc").orderBy(F.xxhash64("chunk_id"), "chunk_id", "text")
    # broadcast: at most SAMPLE_DOCS rows a language
    picked = rows.join(F.broadcast(some), "doc").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= SAMPLE_CHUNKS)
    got = picked.select("named", "text", "chunk_id").toArrow().to_pylist()
    got.sort(key=lambda r: (r["named"], r["chunk_id"] if r["chunk_id"] is not None else -1, r["text"]))
    return dictionaries(clean_sample([(r["named"], r["text"]) for r in got]))


def passages(chunks: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """(chunk_id, doc, run, start, end, sentences, letters, lang, confidence), one row per run of sentences.

    Null, blank and wordless texts have no rows. Repeated chunks count once.
    """
    shipped = chunks.sparkSession.sparkContext.broadcast(content)
    source = chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "doc", "text").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shipped.value)
        for batch in batches:
            rows = [(i, k, *r) for i, t in enumerate(batch.column(2).to_pylist()) for k, r in enumerate(model.runs(t))]
            at = pa.array([r[0] for r in rows], pa.int32())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds))],
                ["chunk_id", "doc", "run", "start", "end", "sentences", "letters", "lang", "confidence"],
            )

    schema = "chunk_id bigint, doc string, run int, start int, end int, sentences int, letters int, lang string, confidence double"
    return source.mapInArrow(run, schema).distinct()


def document_languages(runs: DataFrame) -> DataFrame:
    """(doc, lang, confidence): the language of most letters of a document, and its share of them."""
    by = runs.where("lang is not null and doc is not null").groupBy("doc", "lang").agg(F.sum("letters").alias("n"), F.sum(F.col("letters") * F.col("confidence")).alias("c"))
    top = by.groupBy("doc").agg(F.max(F.struct("n", "c", "lang")).alias("m"), F.sum("n").alias("all"))
    return top.select("doc", F.col("m.lang").alias("lang"), (F.col("m.n") / F.col("all")).alias("share"), (F.col("m.c") / F.col("m.n")).alias("confidence"))


def languages(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents: (doc, named, lang, share, confidence); passages: those of chunks, with main, the document's language."""
    runs = durable(passages(chunks, fit(docs, chunks)), "passages")
    main, small = sent_if_small(document_languages(runs), name="languages")
    # Spark's own size check takes the compressed files, and rows before they are repeated for the salt: it may send to all what fills the driver
    main = main if small else main.hint("merge")
    documents = latest_docs(docs).join(main, "doc", "left")
    named = main.select("doc", F.col("lang").alias("main"))
    if small:
        return documents, runs.join(named, "doc", "left")
    salted = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    each = runs.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
    return documents, each.join(salted, ["doc", "_salt"], "left").drop("_salt")
