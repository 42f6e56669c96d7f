"""Exact top-k of inner products over shared terms, for a batch of queries.

A chunk's terms lie in one row, so a task holds all that a score is made of. The query weights are taken in blocks of about BLOCK queries and
BLOCK_ROWS rows; each block is compared in one pass over the chunks. Scores exist for one block and STEP chunks at a time, and a task keeps
no more than k candidates a query. The more blocks there are, the fewer tasks share the chunks of each (sliced()): what is sorted and shuffled
follows the queries and the cores, not the pairs of a query and a chunk that meet, nor the queries times the partitions of the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import durable, sent_if_small

BLOCK, BLOCK_ROWS, STEP = 2048, 400_000, 2048
# tasks of all blocks together for each core, and those of one block at least
TASKS_A_CORE, SLICES = 4, 4
# terms that more than this share of a block's pairs have go through a matrix product, those with fewer pairs than FEW are added one by one
FULL, FEW, SCALE, KEPT = 0.01, 256, 9, 1 << 20


def asked_only(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the terms that are asked for; the terms are sent to the postings if they are few."""
    sent, _ = sent_if_small(terms.select("term").distinct(), name="terms")
    return postings.join(sent, "term", "left_semi")


def pack(postings: DataFrame, value: str, *keep: str) -> DataFrame:
    """(chunk_id, keep, p): one row a chunk, p its (term, value). keep: columns that are the same in all rows of a chunk."""
    rows = postings.where(F.col("chunk_id").isNotNull() & F.col("term").isNotNull() & F.col(value).isNotNull())
    return rows.groupBy("chunk_id", *keep).agg(F.collect_list(F.struct("term", F.col(value).alias("value"))).alias("p"))


def frequency(packed: DataFrame) -> DataFrame:
    """(term, df)"""
    return packed.select(F.explode("p.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def sliced(rows: DataFrame, blocks: int) -> DataFrame:
    """rows in fewer partitions where several blocks of queries are compared with them: each partition leaves k candidates of every query."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if blocks == 1 else rows.coalesce(max(SLICES, -(-TASKS_A_CORE * cores // blocks)))


class Best:
    """The k best chunks of each of n queries so far. slack: by how much a key may differ from a score."""

    def __init__(self, n: int, k: int, slack: float = 0.0):
        self.n, self.k, self.slack = n, k, slack + 2 * 10.0**-SCALE
        self.least = np.full(n, -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, column) of what may be among the best, by its key; -inf never is."""
        wide = key.shape[1]
        met = self._met(key)
        if wide > self.k and np.count_nonzero(met) > 2 * self.k * self.n:
            self.least = np.maximum(self.least, np.partition(key, wide - self.k, axis=1)[:, wide - self.k] - self.slack)
            met = self._met(key)
        return np.nonzero(met)

    def _met(self, key: np.ndarray) -> np.ndarray:
        return (key >= (self.least - self.slack).astype(key.dtype)[:, None]) & (key > -np.inf)

    def take(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.found.append((q, ids, score))
        self.held += len(q)
        if self.held > max(KEPT, 4 * self.k * self.n):
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, chunk_id, score): the k best of each query, ties by id."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, ids, s = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -np.where(np.isnan(s), np.inf, np.round(s, SCALE)), q))
        q, ids, s = q[order], ids[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], np.where(np.isnan(s[last]), np.inf, s[last]))
        top = place < self.k
        self.found, self.held = [(q[top], ids[top], s[top])], int(top.sum())
        return self.found[0]


class Block(Best):
    """The weights of some queries by term, and the k best chunks of each so far."""

    def __init__(self, names: pa.Array, rows: pa.Table, k: int):
        super().__init__(len(names), k)
        self.names = names
        self.vocabulary = pc.unique(rows.column("term").combine_chunks())
        term = pc.index_in(rows.column("term").combine_chunks(), value_set=self.vocabulary).to_numpy()
        order = np.argsort(term, kind="stable")
        self.query = pc.index_in(rows.column("query_id").combine_chunks(), value_set=names).to_numpy()[order].astype(np.int64)
        self.weight = rows.column("w").to_numpy()[order]
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.vocabulary)))))

    def _sums(self, term: np.ndarray, chunk: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, matrix: bool) -> np.ndarray:
        """Scores of all queries and n chunks, from postings in order of their terms."""
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        own, size = term[starts], np.diff(np.append(starts, len(term)))
        asked = self.ends[own + 1] - self.ends[own]
        pairs = asked * size
        full = np.flatnonzero(pairs > FULL * len(self.names) * n) if matrix else np.empty(0, np.int64)
        if len(full):
            a, b = np.zeros((len(self.names), len(full))), np.zeros((len(full), n))
            for j, i in enumerate(full):
                of = slice(self.ends[own[i]], self.ends[own[i] + 1])
                np.add.at(a[:, j], self.query[of], weight[of])
                np.add.at(b[j], chunk[starts[i] : starts[i] + size[i]], value[starts[i] : starts[i] + size[i]])
            out = a @ b
        else:
            out = np.zeros((len(self.names), n))
        rest = np.ones(len(own), bool)
        rest[full] = False
        flat = out.reshape(-1)
        for i in np.flatnonzero(rest & (pairs >= FEW)):
            of, at = slice(self.ends[own[i]], self.ends[own[i] + 1]), slice(starts[i], starts[i] + size[i])
            np.add.at(flat, ((self.query[of] * n)[:, None] + chunk[at]).ravel(), (weight[of][:, None] * value[at]).ravel())
        few = np.flatnonzero(np.repeat(rest & (pairs < FEW), size))
        if len(few):
            times = np.repeat(asked, size)[few]
            post = np.repeat(few, times)
            at = np.repeat(self.ends[term[few]] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(len(post))
            np.add.at(flat, self.query[at] * n + chunk[post], weight[at] * value[post])
        return out

    def add(self, ids: np.ndarray, lists: pa.ListArray) -> None:
        """Take in chunks with their (term, value) lists."""
        p, n = lists.flatten(), len(ids)
        terms, values = p.flatten()
        known = pc.index_in(terms, value_set=self.vocabulary)
        chunk = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        some = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        if not len(some):
            return
        term = known.take(pa.array(some)).to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        term, chunk, value = term[order], chunk[some[order]], values.to_numpy(zero_copy_only=False)[some[order]].astype(np.float64)
        finite = bool(np.isfinite(value).all() and np.isfinite(self.weight).all())
        score = self._sums(term, chunk, value, self.weight, n, finite)
        # a pair has a score where it shares a term; where all products are positive that shows in the score itself
        if finite and value.min() > 0 and self.weight.min() > 0 and value.min() * self.weight.min() > 0:
            key = np.where(score > 0, score, -np.inf)
        else:
            shared = self._sums(term, chunk, np.ones(len(value)), np.ones(len(self.weight)), n, True)
            key = np.where(shared > 0, np.where(np.isnan(score), np.inf, score), -np.inf)  # NaN is the greatest, as in SQL
        q, c = self.places(key)
        self.take(q, ids[c], score[q, c])


def best_products(packed: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the k best chunks of each query, and others, by the sum of w times value over shared terms.

    packed: (chunk_id, p) as from pack(), written: it is read once a block; weights: (query_id, term, w). A pair without a shared term has no score.
    """
    weights = durable(weights.select("query_id", "term", F.col("w").cast("double").alias("w")).where("query_id is not null and term is not null and w is not null"), "weights")
    size = weights.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("query_id").alias("queries")).first()
    blocks = max(1, -(-size["queries"] // BLOCK), -(-size["rows"] // BLOCK_ROWS))
    rows, out = sliced(packed.select("chunk_id", "p"), blocks), None
    for i in range(blocks):
        part = _block(rows, weights if blocks == 1 else weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k)
        out = part if out is None else out.unionByName(part)
    return out


def _block(rows: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    got = weights.toArrow()
    shipped = rows.sparkSession.sparkContext.broadcast((pc.unique(got.column("query_id").combine_chunks()), got))
    schema = weights.select("query_id").crossJoin(rows.select("chunk_id")).select("query_id", "chunk_id", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shipped.value
        if not len(names):
            return
        block, waiting, n = Block(names, table, k), [], 0

        def flush() -> None:
            t = pa.Table.from_batches(waiting)
            for i in range(0, len(t), STEP):
                some = t.slice(i, STEP).combine_chunks()
                block.add(some.column(0).to_numpy(), some.column(1).chunk(0))

        for b in batches:
            if b.num_rows:
                waiting.append(b)
                n += b.num_rows
            if n >= STEP:
                flush()
                waiting, n = [], 0
        if waiting:
            flush()
        q, ids, s = block.best()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(ids).cast(pa.int64()), pa.array(s)], ["query_id", "chunk_id", "score"])

    return rows.mapInArrow(run, schema)
