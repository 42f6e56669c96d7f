"""Passages of evaluation items inside a corpus, by spaced-seed hashing.

A spaced seed is a mask over `SPAN` successive words that ignores fixed positions. The words a mask keeps
are hashed at every place of the items and of the corpus; equal hashes join the two, and on the diagonal of
each such hit the words are compared one by one, as far as both texts go. A run of SPAN equal words is hit by every mask, so no
exact overlap of that length is lost; an overlap with substituted words is hit wherever a mask ignores them. Every mask ignores
some positions.

Items of up to BLOCK_BYTES, which are counted first, are sent to all tasks: then the step is map-only over the corpus, and one
document's hits never leave its row. Larger sets are joined in Spark, in one pass over the corpus whatever their size: a filter of bounded
size lets the corpus' seeds through that an item may have, these are joined with the items' seeds on their hashes, and the pairs that
meet are brought together with their words. Both ways give the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import durable

SPAN = 13
MASKS = ("1101100101011", "1110010011011", "1011011000111")
MISMATCH = 2
BLOCK_BYTES = 8 << 20
CELLS_AT_ONCE = 1 << 18
FILTER_BITS = 22
#: the filter of the join has about FILTER_SHARE bits a seed, up to 2^MAX_FILTER_BITS, and tests PROBES of them
FILTER_SHARE, MAX_FILTER_BITS, PROBES = 32, 29, 4
KEPT_WORDS = 1 << 20
_WORD = re.compile(r"[^\W_]+")
_DROPPED = ("\u00ad", "\u200b")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits of the lower-cased text, after NFKC, without soft hyphens and zero-width spaces."""
    if not text:
        return []
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        for sign in _DROPPED:
            if sign in text:
                text = text.replace(sign, "")
    return _WORD.findall(text.lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Words:
    """Word hashes of many texts on end: values, and where each text begins."""

    def __init__(self, texts: list[str | None], known: _Hashes):
        each = [[known[w] for w in words_of(t)] for t in texts]
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        self.values = np.fromiter((h for x in each for h in x), np.uint64, int(self.starts[-1]))

    def seeds(self, mask: str) -> np.ndarray:
        """The mask's hash at every place; places whose span leaves a text are for the caller to drop."""
        n = len(self.values) - len(mask) + 1
        out = np.zeros(max(n, 0), np.uint64)
        if n > 0:
            for k, kept in enumerate(mask):
                if kept == "1":
                    out += self.values[k : k + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) % (1 << 64) | 1)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
        return out

    def text_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def inside(self, places: np.ndarray, span: int) -> np.ndarray:
        return self.text_at(places) == self.text_at(places + span - 1)


class SeedIndex:
    """Seeds of a block of items."""

    def __init__(self, ids: list, texts: list[str | None], masks: tuple[str, ...] = MASKS):
        self.ids, self.masks, self.words = ids, masks, Words(texts, _Hashes())
        self.seed, self.place, self.filter = [], [], []
        for mask in masks:
            h = self.words.seeds(mask)
            p = np.flatnonzero(self.words.inside(np.arange(len(h)), len(mask)))
            p = p[np.argsort(h[p], kind="stable")]
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[h[p] >> np.uint64(64 - FILTER_BITS)] = True
            self.seed.append(h[p]), self.place.append(p), self.filter.append(bits)

    def hits(self, corpus: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the corpus and of the items that a mask joins, one pair per diagonal and text."""
        found = []
        for k, mask in enumerate(self.masks):
            h = corpus.seeds(mask)
            at = np.flatnonzero(self.filter[k][h >> np.uint64(64 - FILTER_BITS)])
            low, high = np.searchsorted(self.seed[k], h[at], "left"), np.searchsorted(self.seed[k], h[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            inside = corpus.inside(at, len(mask)) if len(at) else np.zeros(0, bool)
            at, low, many = at[inside], low[inside], (high - low)[inside]
            rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append((np.repeat(at, many), self.place[k][np.repeat(low, many) + rank]))
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        if len(a):
            order = np.argsort(a, kind="stable")  # of a diagonal's hits the first is kept
            a, b = a[order], b[order]
            key = np.stack([self.words.text_at(b), corpus.text_at(a), a - b])
            keep = np.unique(key, axis=1, return_index=True)[1]
            a, b = a[keep], b[keep]
        return a, b

    def overlaps(self, corpus: Words) -> tuple[np.ndarray, ...]:
        return measured(corpus, self.words, *self.hits(corpus))


def measured(corpus: Words, items: Words, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, item, longest equal run, best tolerant score, first word of that run in the text: the best of each pair.

    a and b: places of hits in the corpus and the items. Every diagonal that a mask hits is measured as far as both texts go.
    Where the run is under SPAN, the place is that of the hit.
    """
    text, item = corpus.text_at(a), items.text_at(b)
    low = np.maximum(corpus.starts[text] - a, items.starts[item] - b)
    size = np.minimum(corpus.starts[text + 1] - a, items.starts[item + 1] - b) - low
    best, top, place = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), a - corpus.starts[text]
    ends = np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CELLS_AT_ONCE, "right")))
        first = np.cumsum(size[i:j]) - size[i:j]
        owner = np.repeat(np.arange(j - i), size[i:j])
        at = np.arange(len(owner))
        k = at - (first - low[i:j])[owner]
        same = corpus.values[a[i:j][owner] + k] == items.values[b[i:j][owner] + k]
        run = at - np.maximum.accumulate(np.where(same, first[owner] - 1, at))
        best[i:j] = np.maximum.reduceat(run, first)
        # the score is the sum since its least value on the diagonal; a step down between diagonals starts it anew
        step = np.where(same, 1, -MISMATCH)
        total = np.cumsum(step) - owner * ((MISMATCH + 1) * len(owner) + 1)
        before = total[first] - step[first]
        top[i:j] = np.maximum.reduceat(total - np.minimum.accumulate(np.minimum(total, before[owner])), first)
        end = np.flatnonzero(run == best[i:j][owner])
        end = end[np.unique(owner[end], return_index=True)[1]]
        place[i:j] = np.where(best[i:j] >= SPAN, place[i:j] + k[end] - best[i:j] + 1, place[i:j])
        i = j
    order = np.lexsort((place, -top, -best, item, text))
    text, item, best, top, place = text[order], item[order], best[order], top[order], place[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    if len(text):
        top = np.maximum.reduceat(top, np.flatnonzero(first))  # may lie on another diagonal than the run
    return text[first], item[first], best[first], top, place[first]


def _texts(words: pa.Array) -> Words:
    """Words from lists of word hashes."""
    out = Words([], _Hashes())
    out.values = words.flatten().to_numpy().view(np.uint64)
    out.starts = np.concatenate(([0], np.cumsum(np.diff(words.offsets.to_numpy())))).astype(np.int64)
    return out


def _lists(words: Words) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(words.starts.astype(np.int32)), pa.array(words.values.view(np.int64)))


def _seeded(words: Words, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mask number, hash and place of every seed that lies within a text."""
    number, seed, place = [], [], []
    for k, mask in enumerate(masks):
        h = words.seeds(mask)
        at = np.flatnonzero(words.inside(np.arange(len(h)), len(mask))) if len(h) else np.empty(0, np.int64)
        number.append(np.full(len(at), k, np.int32)), seed.append(h[at]), place.append(at)
    return np.concatenate(number), np.concatenate(seed), np.concatenate(place)


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """PROBES places of a filter of 2^bits for each hash."""
    step = (h * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    for k in range(PROBES):
        yield (h + step * np.uint64(k)) >> np.uint64(64 - bits)


def seed_filter(seeds: DataFrame, seed: str = "h") -> np.ndarray:
    """Words of 64 bits of a filter over the seeds; its size follows their number up to 2^MAX_FILTER_BITS bits."""
    n = seeds.count()
    bits = min(MAX_FILTER_BITS, max(16, math.ceil(math.log2(max(1, n) * FILTER_SHARE))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(list(_probes(h, bits)))) if len(h) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

    rows = seeds.select(seed).mapInArrow(run, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most the filter's size
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bit").to_numpy()
    return out.view(np.uint64)


def joined_leaks(source: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(_doc, item, longest, score, first) of all pairs that share a seed; source: (_doc, _text), items: (item, text), texts not null."""
    spark = source.sparkSession

    def wordy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(Words(batch.column(1).to_pylist(), known))], ["item", "words"])

    kind = items.schema["item"].dataType.simpleString()
    asked = durable(items.select("item", "text").mapInArrow(wordy, f"item {kind}, words array<bigint>").withColumn("no", F.monotonically_increasing_id()), "items")

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _texts(batch.column(1))
            number, seed, place = _seeded(words, masks)
            text = words.text_at(place)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(number), pa.array(seed.view(np.int64)), pa.array((place - words.starts[text]).astype(np.int32))], ["no", "mask", "h", "at"])

    seeds = durable(asked.select("no", "words").mapInArrow(seeds_of, "no bigint, mask int, h bigint, at int"), "seeds")
    shipped = spark.sparkContext.broadcast(seed_filter(seeds))

    def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shipped.value, _Hashes()
        bits = int(len(table) * 64).bit_length() - 1
        for batch in batches:
            if len(known) > KEPT_WORDS:
                known.clear()
            words = Words(batch.column(1).to_pylist(), known)
            number, seed, place = _seeded(words, masks)
            left = np.arange(len(seed))
            for k in range(PROBES):
                p = list(_probes(seed[left], bits))[k] if len(left) else np.empty(0, np.uint64)
                left = left[(table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)) == 1]
            number, seed, place = number[left], seed[left], place[left]
            text = words.text_at(place)
            order = np.argsort(text, kind="stable")
            number, seed, place, text = number[order], seed[order], place[order], text[order]
            docs, first = np.unique(text, return_index=True)
            offsets = pa.array(np.append(first, len(text)).astype(np.int32))
            found = pa.StructArray.from_arrays([pa.array(number), pa.array(seed.view(np.int64)), pa.array((place - words.starts[text]).astype(np.int32))], ["mask", "h", "at"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), _lists(words).take(pa.array(docs)), pa.ListArray.from_arrays(offsets, found)], ["_doc", "words", "seeds"])

    doc_kind = source.schema["_doc"].dataType.simpleString()
    met = durable(source.mapInArrow(let_through, f"_doc {doc_kind}, words array<bigint>, seeds array<struct<mask:int,h:bigint,at:int>>").withColumn("row", F.monotonically_increasing_id()), "met")
    hits = met.select("row", F.explode("seeds").alias("s")).select("row", F.col("s.mask").alias("mask"), F.col("s.h").alias("h"), F.col("s.at").alias("a")).join(seeds.select("no", "mask", "h", F.col("at").alias("b")), ["mask", "h"])
    # one hit for each diagonal, then the pair's words
    diagonals = hits.groupBy("row", "no", (F.col("a") - F.col("b")).alias("d")).agg(F.min("a").alias("a")).groupBy("row", "no").agg(F.collect_list("d").alias("d"), F.collect_list("a").alias("a"))
    pairs = diagonals.join(met.select("row", "_doc", F.col("words").alias("x")), "row").join(asked.select("no", "item", F.col("words").alias("y")), "no")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _texts(batch.column(4)), _texts(batch.column(5))
            size = np.diff(batch.column(2).offsets.to_numpy())
            own = np.repeat(np.arange(len(size)), size)
            at = batch.column(3).flatten().to_numpy()
            text, _, best, top, place = measured(x, y, x.starts[own] + at, y.starts[own] + at - batch.column(2).flatten().to_numpy())
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(best, pa.int32()), pa.array(top, pa.int32()), pa.array(place, pa.int64())], ["_doc", "item", "longest", "score", "first"])

    return pairs.select("_doc", "item", "d", "a", "x", "y").mapInArrow(compare, f"_doc {doc_kind}, item {kind}, longest int, score int, first bigint")


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_words: int = SPAN, block_bytes: int | None = None) -> DataFrame:
    """(doc_id, item_id, longest_run, tolerant_score, first_word), one row per document and item.

    A pair is given if it shares min_words successive words, or a stretch whose equal words less MISMATCH
    for each substituted word come to min_words. Items under SPAN words, null and empty texts give nothing.
    Rows with the same document id are searched each by itself; repeated items give one row for each.
    block_bytes (BLOCK_BYTES): items of more bytes are joined, not sent.
    """
    if min_words < SPAN:
        raise ValueError(f"runs under {SPAN} words can be missed by the masks")
    spark = documents.sparkSession
    source = documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where("_text is not null")
    asked = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).where("text is not null")
    if (asked.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0) > (BLOCK_BYTES if block_bytes is None else block_bytes):
        found = joined_leaks(source, asked)
    else:
        rows = asked.toArrow()
        shipped = spark.sparkContext.broadcast((rows.column("item").to_pylist(), rows.column("text").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, known = SeedIndex(*shipped.value), _Hashes()
            for batch in batches:
                if len(known) > KEPT_WORDS:
                    known.clear()
                t, i, best, top, place = index.overlaps(Words(batch.column(1).to_pylist(), known))
                keep = (best >= min_words) | (top >= min_words)
                names = pa.array([index.ids[x] for x in i[keep]], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t[keep])), names, pa.array(best[keep], pa.int32()), pa.array(top[keep], pa.int32()), pa.array(place[keep], pa.int64())], ["_doc", "item", "longest", "score", "first"])

        kind = rows.schema.field("item").type
        found = source.mapInArrow(run, f"_doc {source.schema['_doc'].dataType.simpleString()}, item {asked.schema['item'].dataType.simpleString()}, longest int, score int, first bigint")
    found = found.where((F.col("longest") >= min_words) | (F.col("score") >= min_words))
    return found.select(F.col("_doc").alias(doc_id), F.col("item").alias(item_id), F.col("longest").alias("longest_run"), F.col("score").alias("tolerant_score"), F.col("first").alias("first_word"))
