"""Records that are near copies: every pair whose sets of word shingles have a Jaccard similarity of at least t.

Records with equal sets are one class first. Of each class the rarest shingles are its prefix: two sets of
similarity t share one there (n - ceil(t n) + 1 of n, in one order for all), so only classes that meet
on a prefix shingle are compared. The classes of a shingle lie in order of their size and are cut into tiles of TILE_ROWS;
a tile is compared with itself and with those whose sizes are within the band that t allows. Each class
carries a hashed bitmap of 256 bits; the bits in which two bitmaps differ bound the overlap from above,
and only pairs that may still reach t are intersected exactly, by merging their sorted arrays. Nothing is capped or
sampled, so no link is lost.

The order (by frequency) comes from a table of upper bounds of the shingles' counts, which has about one counter for four shingles, up to a
bound. Any consistent order is exact; the table only decides how much is compared. A shingle that it shows to be in one class only
gets no row at all. What meets on a shingle is moved as packed arrays, in buckets of bounded size. Tiles are cut by the real number of rows, a shingle that may
have very many is dealt into several buckets, so no task holds all of a hot shingle's rows, and no row is repeated for a shingle of which the table says too much.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import durable, sent_if_small

SHINGLE, MIN_WORDS, SIMILARITY = 3, 20, 0.6
MIN_BITS, MAX_BITS, BLOCK_BITS = 22, 25, 12
TILE_ROWS, PAIRS_AT_ONCE = 4096, 1 << 21
#: rows of a shingle, and of a bucket of shingles, that one task holds at a time, about
STREAM_ROWS, BUCKET_ROWS = 1 << 20, 1 << 18
SENT_COPIES = 300_000
ENTRY = np.dtype([("shingle", np.int64), ("id", np.int64), ("bits", np.uint64, 4), ("n", np.int32), ("salt", np.int32), ("salts", np.int32)])
KEPT_WORDS = 1 << 20
ROWS_AT_ONCE = 1 << 11
_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, known: dict, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> np.ndarray | None:
    """Sorted hashes of the different runs of `shingle` words; None for texts under min_words words."""
    words = _WORD.findall(text.lower())
    if len(words) < max(min_words, shingle):
        return None
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = len(h) - shingle + 1
    s = np.zeros(n, np.uint64)
    for k in range(shingle):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(s.view(np.int64))


def shingled(records: DataFrame, record: str, text: str, shingle: int, min_words: int) -> DataFrame:
    """(id, h1, h2, n, set): the shingle set of every record with enough words, and its 128-bit hash."""
    source = records.select(F.col(record).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            if len(known) > KEPT_WORDS:
                known.clear()
            sets = [shingle_set(t, known, shingle, min_words) for t in batch.column(1).to_pylist()]
            at = [i for i, s in enumerate(sets) if s is not None]
            kept = [sets[i] for i in at]
            each = [xxhash.xxh128_intdigest(s.tobytes()) for s in kept]
            signed = [((x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)) for x in each]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
            values = np.concatenate(kept) if kept else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int32())),
                    pa.array([a for a, _ in signed], pa.int64()),
                    pa.array([b for _, b in signed], pa.int64()),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                ["id", "h1", "h2", "n", "set"],
            )

    return source.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, n int, set array<bigint>")


def table_bits(shingles: int) -> int:
    """A counter for four shingles, within the bounds of the table."""
    return min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1, shingles))) - 2))


def _log(counts: np.ndarray) -> np.ndarray:
    """Eighths of log2(1 + count), rounded up: 8 is exactly 1."""
    return np.minimum(np.ceil(8 * np.log2(1.0 + counts) - 1e-9), 255).astype(np.uint8)


def _count(logs: np.ndarray) -> np.ndarray:
    return 2.0 ** (logs / 8.0) - 1


def frequency_table(classes: DataFrame) -> np.ndarray:
    """Upper bounds of the shingles' counts (see _log) by the top bits of their mixed hash; a power of two of at most 2^MAX_BITS bytes."""
    size = table_bits(classes.agg(F.coalesce(F.sum(F.size("set")), F.lit(0)).alias("n")).first()["n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << size, np.int32)
        for batch in batches:
            h, n = np.unique(_mix(batch.column(0).flatten().to_numpy().view(np.uint64)) >> np.uint64(64 - size), return_counts=True)
            table[h.astype(np.int64)] += n.astype(np.int32)
        blocks = table.reshape(-1, 1 << BLOCK_BITS)
        used = np.flatnonzero(blocks.any(1))
        for k in range(0, len(used), 512):
            part = used[k : k + 512]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([_log(blocks[i]).tobytes() for i in part], pa.binary())], ["block", "logs"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(_count(np.frombuffer(x, np.uint8)) for x in table.column("logs").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "logs": pa.array([_log(total).tobytes()], pa.binary())})

    rows = classes.select("set").mapInArrow(count, "block int, logs binary").groupBy("block").applyInArrow(merge, "block int, logs binary").toArrow()
    out = np.zeros((1 << (size - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for block, logs in zip(rows.column("block").to_pylist(), rows.column("logs").to_pylist()):
        out[block] = np.frombuffer(logs, np.uint8)
    return out.ravel()


def bucket_count(entries: float) -> int:
    return max(1, math.ceil(entries / BUCKET_ROWS))


def prefixes(classes: DataFrame, table: np.ndarray, similarity: float, buckets: int) -> DataFrame:
    """(bucket, rows): the prefix shingles of the classes, without those that no other class can have, packed by bucket: for each entry the
    shingle, its salt, the class's size, id and bitmap. A bucket has all entries of a shingle and salt."""
    shipped = classes.sparkSession.sparkContext.broadcast(table)
    top, stream = int(len(table)).bit_length() - 1, STREAM_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shipped.value
        for batch in batches:
            lists = batch.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            values = values if len(values) == offsets[-1] - offsets[0] else values[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(size)), size)
            mixed = _mix(values.view(np.uint64))
            log = logs[(mixed >> np.uint64(64 - top)).astype(np.int64)]
            bits = np.zeros((len(size), 4), np.uint64)
            place = (mixed & np.uint64(255)).astype(np.int64)
            np.bitwise_or.at(bits, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
            order = np.lexsort((values, log, owner))
            rank = np.arange(len(values)) - offsets[owner]
            take = (rank < (size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)[owner]) & (log[order] > 8)
            who, at = owner[take], order[take]
            if not len(who):
                continue
            ids = batch.column(0).to_numpy()[who]
            # a shingle that may have very many rows is dealt into several buckets
            salts = np.maximum(1, np.ceil(_count(log[at]) / stream)).astype(np.uint64)
            salt = _mix(ids.view(np.uint64)) % salts
            entry = np.zeros(len(who), ENTRY)
            entry["shingle"], entry["salt"], entry["salts"], entry["n"], entry["id"], entry["bits"] = values[at], salt, np.minimum(salts, 1 << 15), size[who], ids, bits[who]
            bucket = (_mix(mixed[at] + salt) % np.uint64(buckets)).astype(np.int64)
            laid = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(bucket[laid]) > 0))
            entry, ends = entry[laid], np.append(first[1:], len(laid))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[laid][first], pa.int64()), pa.array([entry[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())], ["bucket", "rows"])

    return classes.select("id", "set").mapInArrow(run, "bucket bigint, rows binary")


class Rows:
    """Classes of one or more shingles: sizes, ids and bitmaps."""

    def __init__(self, n: np.ndarray, ids: np.ndarray, bits: np.ndarray):
        self.n, self.ids, self.bits = n, ids, bits.reshape(-1, 4)

    def pack(self) -> bytes:
        return self.n.astype(np.int32).tobytes() + self.ids.tobytes() + self.bits.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Rows:
        k = len(data) // 44
        return cls(np.frombuffer(data, np.int32, k).astype(np.int64), np.frombuffer(data, np.int64, k, 4 * k) if k % 2 == 0 else np.frombuffer(data[4 * k : 12 * k], np.int64), np.frombuffer(data[12 * k :], np.uint64))


def possible(x: Rows, y: Rows, begin: np.ndarray, end: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of row i of x and rows begin[i] to end[i] of y whose bitmaps leave the similarity possible."""
    count = np.maximum(end - begin, 0)
    ends = np.cumsum(count)
    i = 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
        a = np.repeat(np.arange(i, j), count[i:j])
        b = np.arange(len(a)) + np.repeat(begin[i:j] - (ends[i:j] - count[i:j] - (ends[i] - count[i])), count[i:j])
        if len(a):
            both = x.n[a] + y.n[b]
            differ = np.bitwise_count(x.bits[a] ^ y.bits[b]).sum(1, dtype=np.int64)
            ok = ((both - differ) // 2 >= np.ceil(similarity / (1 + similarity) * both - 1e-9)) & (x.ids[a] != y.ids[b])
            p, q = x.ids[a[ok]], y.ids[b[ok]]
            pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)]), axis=1)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
        i = j


def within(rows: Rows, group: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of the same group (numbers that rise); sizes rise within a group."""
    at = np.arange(len(group))
    band = np.searchsorted(group * (1 << 40) + rows.n, group * (1 << 40) + np.floor(rows.n / similarity + 1e-9).astype(np.int64), "right")
    return possible(rows, rows, at + 1, band, similarity)


_TILED = "a bigint, b bigint, shingle bigint, low int, high int, tile binary"


def tiled(packed: DataFrame, similarity: float, tile_rows: int) -> DataFrame:
    """Pairs (a, b) of shingles whose rows fill one tile at most, and the tiles (shingle, low, high, tile) of all others."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shingle", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("tile", pa.binary())])

    def filled(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def rows_of(e: np.ndarray) -> Rows:
        return Rows(e["n"].astype(np.int64), np.ascontiguousarray(e["id"]), np.ascontiguousarray(e["bits"]))

    def bucket(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        e = e[np.lexsort((e["n"], e["salt"], e["shingle"]))]
        start = np.flatnonzero(np.append(True, (e["shingle"][1:] != e["shingle"][:-1]) | (e["salt"][1:] != e["salt"][:-1])))
        size = np.diff(np.append(start, len(e)))
        large = (size > tile_rows) | (e["salts"][start] > 1)
        for g in np.flatnonzero(large):
            for k in range(start[g], start[g] + size[g], tile_rows):
                part = rows_of(e[k : min(k + tile_rows, start[g] + size[g])])
                yield filled(1, shingle=pa.array([int(e["shingle"][k])], pa.int64()), low=pa.array([int(part.n[0])], pa.int32()), high=pa.array([int(part.n[-1])], pa.int32()), tile=pa.array([part.pack()], pa.binary()))
        keep = np.repeat(~large & (size > 1), size)
        if keep.any():
            for pairs in within(rows_of(e[keep]), np.repeat(np.arange(len(size)), size)[keep], similarity):
                yield filled(pairs.num_rows, a=pairs.column(0), b=pairs.column(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []
        for batch in batches:
            for k, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != own and parts:
                    yield from bucket(np.frombuffer(b"".join(parts), ENTRY))
                    parts = []
                own = k
                parts.append(rows)
        if parts:
            yield from bucket(np.frombuffer(b"".join(parts), ENTRY))

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _TILED)


def tile_pairs(tiles: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of a tile and itself, and of two tiles of one shingle whose sizes are within the band. Tiles are paired by their numbers first."""
    numbered = durable(tiles.withColumn("no", F.monotonically_increasing_id()), "tiles")
    x = numbered.select("shingle", F.col("no").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    y = numbered.select("shingle", F.col("no").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    near = (F.col("low_i") * F.lit(similarity) <= F.col("high_j") + 1e-9) & (F.col("low_j") * F.lit(similarity) <= F.col("high_i") + 1e-9)
    laid = x.join(y, "shingle").where((F.col("i") <= F.col("j")) & near).select("i", "j")
    both = laid.join(numbered.select(F.col("no").alias("i"), F.col("tile").alias("x")), "i").join(numbered.select(F.col("no").alias("j"), F.col("tile").alias("y")), "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, p, q in zip(*(batch.column(c).to_pylist() for c in range(4))):
                x = Rows.unpack(p)
                if i == j:
                    yield from within(x, np.zeros(len(x.n), np.int64), similarity)
                    continue
                y = Rows.unpack(q)
                begin = np.searchsorted(y.n, np.ceil(x.n * similarity - 1e-9).astype(np.int64), "left")
                yield from possible(x, y, begin, np.searchsorted(y.n, np.floor(x.n / similarity + 1e-9).astype(np.int64), "right"), similarity)

    return both.select("i", "j", "x", "y").mapInArrow(run, "a bigint, b bigint")


def candidates(packed: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: class pairs that the tiles leave possible, distinct."""
    first = durable(tiled(packed, similarity, TILE_ROWS), "tiled")
    pairs, tiles = first.where("a is not null").select("a", "b"), first.where("tile is not null").select("shingle", "low", "high", "tile")
    return pairs.unionByName(tile_pairs(tiles, similarity)).distinct()


def common_counts(batch: pa.RecordBatch) -> np.ndarray:
    """Values that the sorted sets x and y of each row share: both are merged, equal values stand side by side."""
    each = [batch.column(c) for c in ("x", "y")]
    rows = np.concatenate([np.repeat(np.arange(len(c)), np.diff(c.offsets.to_numpy())) for c in each])
    values = np.concatenate([c.flatten().to_numpy() for c in each])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    same = (rows[1:] == rows[:-1]) & (values[1:] == values[:-1])
    return np.bincount(rows[1:][same], minlength=batch.num_rows)


def intersected(pairs: DataFrame) -> DataFrame:
    """(a, b, _c, _u): how many values the sorted sets x and y share, and how many they have together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                common = common_counts(part)
                sizes = sum(np.diff(part.column(c).offsets.to_numpy()) for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(common, pa.int32()), pa.array(sizes - common, pa.int32())], ["a", "b", "_c", "_u"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, _c int, _u int")


def near_copies(records: DataFrame, record: str = "chunk_id", text: str = "text", shingle: int = SHINGLE, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity), a < b, between class representatives; membership (id, rep).

    The representative of a class is its smallest id. Records with null id or text, or under min_words words, are in
    no class. Repeated rows count once; an id with several texts is in several classes.
    """
    sets = durable(shingled(records, record, text, shingle, min_words).withColumn("_row", F.monotonically_increasing_id()), "shingles")
    rows = sets.select("id", "h1", "h2", "_row")
    reps = rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "_row")).alias("_m")).select("h1", "h2", F.col("_m.id").alias("rep"), F.col("_m._row").alias("_kept"))
    known = durable(rows.join(reps, ["h1", "h2"]).select("id", "rep", "_row", "_kept"), "members")
    membership = known.select("id", "rep").distinct()
    # one row of each class: the copies' rows are left out, and sets are moved for it only where there are too many copies to be sent
    copies, small = sent_if_small(known.where("_row <> _kept").select("_row"), SENT_COPIES, "copies")
    classes = sets.join(copies, "_row", "left_anti").select("id", "n", "set")
    classes = classes if small else durable(classes, "classes")
    # prefixes have this share of the shingles; a bucket is what one task holds at a time
    buckets = bucket_count((1 - similarity) * (classes.agg(F.sum("n").alias("n")).first()["n"] or 0))
    met = durable(candidates(prefixes(classes, frequency_table(classes), similarity, buckets), similarity), "candidates")
    # only the sets of classes that are in a pair are moved
    paired, _ = sent_if_small(met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct(), SENT_COPIES, "paired")
    compared = classes.join(paired, "id", "left_semi")
    left = compared.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = compared.select(F.col("id").alias("b"), F.col("set").alias("y"))
    met = intersected(met.join(left, "a").join(right, "b"))
    links = met.where(F.col("_c") >= F.lit(similarity) * F.col("_u") - 1e-9).groupBy("a", "b").agg(F.max(F.col("_c") / F.col("_u")).alias("similarity"))
    return durable(links, "links"), membership


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of linked records, with the members of the classes put in for them.

    A class with more than TILE_ROWS members is taken apart by salts, one side of each join by its own salt and the other with all of them.
    """
    sizes = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("_salts"))
    salted = members.join(sizes, "rep").withColumn("_salt", F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt")

    def put_in(pairs: DataFrame, rep: str, name: str) -> DataFrame:
        own = salted.select(F.col("rep").alias(rep), "_salt", F.col("id").alias(name))
        wide = pairs.join(sizes.withColumnRenamed("rep", rep), rep).select(*pairs.columns, every)
        return wide.join(own, [rep, "_salt"]).drop("_salt", rep)

    across = put_in(put_in(links.select("a", "b"), "a", "i"), "b", "j")
    other = salted.select("rep", F.col("id").alias("j"), every)
    inside = salted.select("rep", "_salt", F.col("id").alias("i")).join(other, ["rep", "_salt"]).where("i < j").select("i", "j")
    return across.select("i", "j").unionByName(inside).where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group, links): the smallest id a record is connected with, and the number of its links between classes.

    Each round a record takes the smallest label of its neighbours, hands it to the record it was labelled with,
    too (the root of its region), and jumps to its label's label; each round is written to the shared folder.
    Labels only fall, and a round that changes none leaves equal labels along every link, so it ends there.
    Regions merge as wholes: rounds grow with the logarithm of a component, not with its diameter.
    """
    edges = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    reps = members.select(F.col("rep").alias("v")).distinct()
    label = durable(reps.select("v", F.col("v").alias("g")), "labels")
    while True:
        near = edges.join(label.select(F.col("v").alias("b"), "g"), "b").groupBy(F.col("a").alias("v")).agg(F.min("g").alias("m"))
        own = label.join(near, "v", "left").select("v", "g", F.least("g", F.coalesce("m", "g")).alias("h"))
        root = own.where("h < g").groupBy(F.col("g").alias("v")).agg(F.min("h").alias("m"))
        step = own.join(root, "v", "left").select("v", "g", F.least("h", F.coalesce("m", "h")).alias("h"))
        hop = step.join(label.select(F.col("v").alias("h"), F.col("g").alias("k")), "h").select("v", "g", F.least("h", "k").alias("h"))
        done = durable(hop, "labels")
        label = done.select("v", F.col("h").alias("g"))
        if not done.where("g <> h").limit(1).count():
            break
    degree = edges.groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("links"))
    return members.join(label.select(F.col("v").alias("rep"), F.col("g").alias("group")), "rep").join(degree, "rep", "left").groupBy("id").agg(F.min("group").alias("group"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
