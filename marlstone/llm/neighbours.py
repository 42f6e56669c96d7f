"""The k most similar vectors of every vector: stable projections, a kd-tree, and a chi-square stopping test.

Vectors are scaled to length 1 and projected on DIRECTIONS Gaussian (2-stable) directions, which don't depend on the data and are made
orthogonal. Then the squared projected distance of two vectors at distance r, times dim / r^2, follows a chi-square law with DIRECTIONS
degrees of freedom over the draw of the directions, and along c of them one with c degrees.

A kd-tree over the projections, fitted on a bounded sample of rows, assigns every row to a cell. A vector first verifies its nearest
projected neighbours in its own cell exactly, which gives an upper bound r of the distance of its k-th neighbour; then it goes on with
the next ones in the projection and stops where P(chi2 >= projected distance^2 dim / r^2) < MISS_POINT holds. The other cells are taken
by the same test with MISS_CELL: a cell that lies t outside in c directions is visited only while P(chi2_c >= t^2 dim / r^2) > MISS_CELL. At first r is
also held to the distance that CAP_SHARE of PILOTS vectors have, whose neighbours are searched among all rows; vectors whose k-th neighbour then lies
beyond that distance, or which have fewer than k, are searched again, with the distance of what they have found and no cap. Similarities of what is
verified are computed in double precision from the vectors themselves.

Plan: two shuffles of the vectors, by cell and by groups of up to GROUP neighbouring cells, one of those that have further cells to visit, once for
each group of these, and one of narrow result rows; the vectors by group once more for what is searched again. A task holds the points of one group
and takes the rows that visit it in order, some at a time, as their number follows all rows. Cells hold about CELL_ROWS rows: the sample follows the number of cells up to SAMPLE_MAX, and the rows of a
cell that holds more than twice as many are dealt into blocks, each of which is searched like a cell of its own. Of equal vectors only
the k + 1 smallest ids enter the cells; the others take over their neighbours, so a vector that
a third of all rows share is no hot cell. Equal vectors are found by their hashes, and only they are brought together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import durable, sent_if_small

K, DECIMALS = 5, 6
DIRECTIONS, CELL_ROWS = 16, 12_000
SAMPLE_MIN, SAMPLE_CELL, SAMPLE_MAX = 4096, 16, 1 << 20
MISS_CELL, MISS_POINT, PILOTS, CAP_SHARE = 0.05, 0.005, 256, 0.97
FIRST, FEW = 12, 2048
SALTS, GROUP, SENT_OPEN = 16, 16, 1 << 20
# rows whose further cells are found at once, and rows that are verified at once
ASKED_STEP, ASKED = 1024, 16384
SLACK = 4e-6


def usable_vectors(vectors: DataFrame, records: DataFrame, dim: int, record: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(id, vec): distinct rows with `dim` numbers, none null or NaN or infinite, not all 0, and an id in records."""
    v = F.col(vector)
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(3.5e38))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(record).cast("bigint").alias("id"), v.cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & F.col(vector).isNotNull() & ok)
    known = records.select(F.col(record).cast("bigint").alias("id"))
    return rows.join(known.hint("shuffle_hash"), "id", "left_semi").groupBy("id", "vec").agg(F.lit(1).alias("_")).drop("_")


def wanted_depth(rows: int, cell_rows: int) -> int:
    return max(0, math.ceil(math.log2(max(1, rows / cell_rows))))


class ProjectionTree:
    """A kd-tree over stable projections; leaves are numbered from 0, and the cells are their blocks."""

    def __init__(self, dim: int, rows: int, sample: np.ndarray, cell_rows: int = CELL_ROWS, seed: int = 11):
        a = np.random.default_rng(seed).standard_normal((dim, min(DIRECTIONS, dim)))
        self.dim, self.axes = dim, np.linalg.qr(a)[0].T.astype(np.float32)
        self.cap = 2.0
        self.depth = wanted_depth(rows, cell_rows) if len(sample) else 0
        while self.depth and len(sample) >> self.depth < 4:
            self.depth -= 1
        n = (1 << self.depth) - 1
        self.axis, self.at = np.zeros(n, np.int32), np.zeros(n, np.float32)
        if self.depth:
            self._split(0, sample @ self.axes.T)
        self.set_blocks(np.zeros(n + 1, np.int64), cell_rows)

    def set_blocks(self, leaf_rows: np.ndarray, cell_rows: int = CELL_ROWS) -> None:
        """Deal the leaves that hold more than twice cell_rows into blocks."""
        self.blocks = np.where(leaf_rows > 2 * cell_rows, -(-leaf_rows // cell_rows), 1)
        self.first = np.concatenate(([0], np.cumsum(self.blocks)[:-1]))
        self.leaf_of = np.repeat(np.arange(len(self.blocks)), self.blocks)
        self.group = min(GROUP, math.isqrt(len(self.leaf_of)))  # cells of a group; they are neighbours, as they follow one another in the tree

    def _split(self, node: int, y: np.ndarray) -> None:
        if node >= len(self.axis):
            return
        spread = y.std(0) if len(y) else np.ones(len(self.axes))
        axis = int(spread.argmax())
        at = float(np.median(y[:, axis])) if len(y) else 0.0
        self.axis[node], self.at[node] = axis, at
        right = y[:, axis] > at
        self._split(2 * node + 1, y[~right])
        self._split(2 * node + 2, y[right])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.axes.T
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (y[rows, self.axis[node]] > self.at[node])
        return node - len(self.axis)

    def cells(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The leaf's block that an id's hash names."""
        leaf = self.leaves(x)
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return self.first[leaf] + (mixed % self.blocks[leaf].astype(np.uint64)).astype(np.int64)

    def probes(self, x: np.ndarray, radius: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the other cells they must verify, by the chi-square test at each one's radius."""
        y = x @ self.axes.T
        limit = np.array([0.0, *(chi2_quantile(1 - MISS_CELL, c) for c in range(1, self.depth + 1))])
        out_row, out_cell = [], []
        scale = self.dim / np.maximum(radius.astype(np.float64) ** 2, 1e-12)
        stack = [(0, np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int32))]
        while stack:
            node, rows, far, crossed = stack.pop()
            if not len(rows):
                continue
            if node >= len(self.axis):
                leaf = node - len(self.axis)
                for cell in range(self.first[leaf], self.first[leaf] + self.blocks[leaf]):
                    if cell != home:
                        out_row.append(rows)
                        out_cell.append(np.full(len(rows), cell))
                continue
            gap = y[rows, self.axis[node]] - self.at[node]
            for side, beyond in ((1, gap > 0), (2, gap <= 0)):
                f = far + np.where(beyond, gap.astype(np.float64) ** 2, 0)
                c = crossed + beyond
                keep = f * scale[rows] <= limit[c]
                stack.append((2 * node + side, rows[keep], f[keep], c[keep]))
        if not out_row:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_row), np.concatenate(out_cell)


def by_group(row: np.ndarray, cell: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Rows, groups and the lists of their cells, one for each row and group of `size` cells."""
    order = np.lexsort((cell, row))
    row, cell = row[order], cell[order].astype(np.int32)
    group = cell // size
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
    return row[first], group[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(cell))


def chi2_quantile(p: float, c: int) -> float:
    """By bisection on the regularized incomplete gamma function."""

    def below(x: float) -> float:
        term = total = 1 / (c / 2)
        k = c / 2
        while term > total * 1e-12:
            k += 1
            term *= x / 2 / k
            total += term
        return total * math.exp(-x / 2 + c / 2 * math.log(x / 2) - math.lgamma(c / 2)) if x > 0 else 0.0

    low, high = 0.0, 10.0 * c + 60
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return low


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    v = raw.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def best_in(queries: np.ndarray, q_ids: np.ndarray, points: np.ndarray, p_ids: np.ndarray, k: int, axes: np.ndarray, radius: np.ndarray | None, cap: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, similarity to DECIMALS) of the k best points of each query, itself left out, as far as the stopping test finds them.

    Ties go to the smaller id. radius: only points within it are of use; without it, the FIRST projected neighbours give it. cap: an upper
    bound of all radii. Queries for which the test would not stop before a sixteenth of the points are compared with all of them, and so are
    all queries where there are only FEW points.
    """
    dim, m = queries.shape[1], len(axes)
    limit = chi2_quantile(1 - MISS_POINT, m) / dim if m < dim else 1.0
    q, p = queries.astype(np.float32) @ axes.T, points.astype(np.float32) @ axes.T
    p2, whole = (p * p).sum(1), points.astype(np.float32)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    step = max(1, (4 << 20) // max(1, len(points)))

    def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", queries[r[i : i + (1 << 16)]], points[c[i : i + (1 << 16)]]) for i in range(0, len(r), 1 << 16)]
        return np.concatenate(parts) if parts else np.empty(0)

    for a in range(0, len(queries), step):
        b = min(a + step, len(queries))
        far = q[a:b] @ p.T
        far *= -2
        far += p2
        far += (q[a:b] * q[a:b]).sum(1)[:, None]  # squared projected distances
        if radius is None:
            first = min(k + FIRST, len(points))
            near = np.argpartition(far, first - 1, axis=1)[:, :first] if first < len(points) else np.broadcast_to(np.arange(len(points)), (b - a, len(points)))
            s = exact(np.repeat(np.arange(a, b), first), near.ravel()).reshape(b - a, first)
            s[p_ids[near] == q_ids[a:b, None]] = -1
            low = -np.partition(-s, k - 1, axis=1)[:, k - 1] if first >= k else np.full(b - a, -1.0)
            r2 = np.minimum(np.maximum(2 - 2 * low, 0) + 2 * SLACK, cap * cap)
        else:
            r2 = np.minimum(radius[a:b].astype(np.float64), cap) ** 2
        met = far <= (r2 * limit + 1e-5).astype(np.float32)[:, None]
        many = np.flatnonzero(np.count_nonzero(met, axis=1) * 16 > (len(points) + 64 * k if len(points) > FEW else -1))
        met[many] = False
        r, c = np.nonzero(met)
        for i in range(0, len(many), max(1, step // 2)):
            part = many[i : i + max(1, step // 2)]
            s = queries[a + part].astype(np.float32) @ whole.T
            s[q_ids[a + part, None] == p_ids[None, :]] = -2
            low = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(part), -1.5)
            pr, pc = np.nonzero(s >= np.maximum(low, 1 - radius[a + part].astype(np.float64) ** 2 / 2 if radius is not None else -1.5)[:, None] - SLACK)
            r, c = np.concatenate((r, part[pr])), np.concatenate((c, pc))
        keep = q_ids[a + r] != p_ids[c]
        r, c = a + r[keep], c[keep]
        s = np.round(exact(r, c), DECIMALS)
        order = np.lexsort((p_ids[c], -s, r))  # a step holds all that its queries have: no more than the k best is kept of it
        r, c, s = r[order], c[order], s[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[top], c[top], s[top]))
    r, c, s = (np.concatenate(x) for x in zip(*out))
    return r, c, s


class Group:
    """The points of one group of cells, in order of their cells."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int):
        t = pa.Table.from_batches(batches).combine_chunks() if batches else None
        self.cell = t.column("cell").to_numpy() if t else np.empty(0, np.int32)
        self.ids = t.column("id").to_numpy() if t else np.empty(0, np.int64)
        self.vec = _matrix(t.column("vec").combine_chunks(), dim) if t else np.empty((0, dim), np.float32)

    def of(self, cell: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(np.searchsorted(self.cell, cell), np.searchsorted(self.cell, cell, "right"))
        return _unit(self.vec[at]), self.ids[at]


def pilot_radius(base: DataFrame, pilots: np.ndarray, dim: int, k: int) -> float:
    """The distance within which CAP_SHARE of the pilots have their k-th neighbour among all rows."""
    shipped = base.sparkSession.sparkContext.broadcast(pilots.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shipped.value
        best = np.full((len(q), k + 1), -1.0, np.float32)
        for b in batches:
            if b.num_rows:
                s = q @ _unit(_matrix(b.column(0), dim)).astype(np.float32).T
                best = -np.sort(-np.concatenate((best, s), 1), axis=1)[:, : k + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), k + 1).astype(np.int32)), pa.array(best.ravel().astype(np.float64))], ["pilot", "s"])

    rank = Window.partitionBy("pilot").orderBy(F.desc("s"))
    # the pilot itself comes first
    kth = base.select("vec").mapInArrow(run, "pilot int, s double").withColumn("_r", F.row_number().over(rank)).where(F.col("_r") == k + 1).select("s").toArrow()
    return float(np.quantile(np.sqrt(np.maximum(2 - 2 * kth.column("s").to_numpy(), 0)), CAP_SHARE)) + 1e-3


def without_copies(every: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (id, vec): the rows with the k + 1 smallest ids of every vector; (copy, id) of the others with the smallest id of their
    vector; and (id), the smallest ids of the vectors that have others.

    Hashes are counted first; only vectors whose hash comes twice are brought together, at most k + 1 rows of each from a task.
    """
    hashed = every.withColumn("_h", F.xxhash64("vec"))
    again, _ = sent_if_small(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), name="hashes")
    single, same = hashed.join(again, "_h", "left_anti").select("id", "vec"), hashed.join(again, "_h", "left_semi").select("id", "vec")
    ranked = same.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_n") <= k + 1)
    few = durable(ranked, "copies")
    full = few.groupBy("vec").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("_c")).where(F.col("_c") == k + 1)
    salted = full.select("vec", "first", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    others = same.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["vec", "_salt"]).where(F.col("id") > F.col("last"))
    copies = others.select(F.col("id").alias("copy"), F.col("first").alias("id"))
    return single.unionByName(few.select("id", "vec")), copies, full.select(F.col("first").alias("id")).distinct()


def nearest(vectors: DataFrame, records: DataFrame, dim: int = 64, k: int = K, record: str = "chunk_id", vector: str = "embedding", cell_rows: int | None = None, sample_max: int = SAMPLE_MAX) -> DataFrame:
    """(id, neighbour, similarity): k rows for every usable vector (fewer if there are fewer vectors).

    similarity is the cosine in double precision, rounded to DECIMALS; ties go to the smaller id. An id with
    several different vectors is searched for each of them, and is no neighbour of itself. Unusable rows
    (see usable_vectors) have no result; exact repeats count once. Empty tables give no rows.
    cell_rows (CELL_ROWS), sample_max: rows of a cell, and of the sample that the tree is fitted on, at most.
    """
    spark, cell_rows = vectors.sparkSession, cell_rows or CELL_ROWS
    every = durable(usable_vectors(vectors, records, dim, record, vector), "vectors")
    base, copies, firsts = without_copies(every, k)
    rows = base.count()
    want = min(sample_max, max(SAMPLE_MIN, SAMPLE_CELL << wanted_depth(rows, cell_rows)))
    share = math.ceil((1 << 30) * min(1.0, want / max(1, rows)))
    sample = base.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < share).select("vec").toArrow().column("vec").combine_chunks()
    unit = _unit(_matrix(sample, dim)) if len(sample) else np.empty((0, dim))
    tree = ProjectionTree(dim, rows, unit.astype(np.float32), cell_rows)
    if tree.depth:
        tree.cap = pilot_radius(base, unit[:PILOTS], dim, k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf, n = np.unique(tree.leaves(_unit(_matrix(b.column(0), dim)).astype(np.float32)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(n, pa.int64())], ["leaf", "n"])

    held = base.select("vec").mapInArrow(count, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()  # one row a leaf
    leaf_rows = np.zeros(1 << tree.depth, np.int64)
    leaf_rows[held.column("leaf").to_numpy()] = held.column("n").to_numpy()
    tree.set_blocks(leaf_rows, cell_rows)
    shipped = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = shipped.value.cells(_unit(_matrix(b.column(1), dim)).astype(np.float32), b.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(cell // shipped.value.group, pa.int32()), pa.array(cell, pa.int32()), *b.columns], ["part", "cell", "id", "vec"])

    placed = base.select("id", "vec").mapInArrow(place, "part int, cell int, id bigint, vec array<float>")

    names = ["id", "neighbour", "similarity"]

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells each vector has still to verify, and rows with its neighbours in its own cell, which pass through."""
        table = pa.Table.from_batches(batches)
        ids, raw = table.column("id").to_numpy(), table.column("vec").combine_chunks()
        x, cell = _unit(_matrix(raw, dim)), table.column("cell")[0].as_py()
        r, c, s = best_in(x, ids, x, ids, k, shipped.value.axes, None, shipped.value.cap)
        count = np.bincount(r, minlength=len(ids))
        ends = np.concatenate(([0], np.cumsum(count)))
        kth = np.full(len(ids), -1.0)
        kth[count == k] = s[ends[1:][count == k] - 1]
        radius = np.minimum(np.sqrt(np.maximum(2 - 2 * kth, 0)) + 1e-3, shipped.value.cap)
        near, similar = pa.array(ids[c]), pa.array(s)
        for a in range(0, len(ids), ASKED_STEP):
            b = min(a + ASKED_STEP, len(ids))
            pr, pc = shipped.value.probes(x[a:b].astype(np.float32), radius[a:b], cell)
            pr, pg, cells = by_group(pr, pc, shipped.value.group)
            pr, n, m = a + pr, b - a, len(pr)
            offsets = pa.array(np.concatenate((ends[a : b + 1], np.full(m, ends[b]))).astype(np.int32))
            columns = {
                "part": pa.array(np.concatenate((np.full(n, cell // shipped.value.group), pg)).astype(np.int32)),
                "cell": pa.nulls(n + m, pa.int32()),
                "id": pa.array(np.concatenate((ids[a:b], ids[pr]))),
                "kth": pa.array(np.concatenate((kth[a:b], kth[pr]))),
                "neighbours": pa.ListArray.from_arrays(offsets, near),
                "similarities": pa.ListArray.from_arrays(offsets, similar),
                "cells": pa.concat_arrays([pa.nulls(n, cells.type), cells]),
                "vec": pa.concat_arrays([pa.nulls(n, raw.type), raw.take(pa.array(pr))]) if m else pa.nulls(n, raw.type),
            }
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    def passed(asked: pa.RecordBatch) -> pa.RecordBatch:
        near = asked.column("neighbours")
        return pa.RecordBatch.from_arrays([asked.column("id").take(pa.array(np.repeat(np.arange(len(asked)), np.diff(near.offsets.to_numpy())))), near.flatten(), asked.column("similarities").flatten()], names)

    def verified_in(points: Group, asked: list[pa.RecordBatch], cap: float) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(asked).combine_chunks()
        lists, ids, kth, vec = table.column("cells").combine_chunks(), table.column("id").to_numpy(), table.column("kth").to_numpy(), _matrix(table.column("vec").combine_chunks(), dim)
        row, cell = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        for one in np.unique(cell):
            (y, p), of = points.of(one), row[cell == one]
            if len(p):
                radius = np.minimum(np.sqrt(np.maximum(2 - 2 * kth[of], 0)) + 1e-3, 2.0)
                r, c, s = best_in(_unit(vec[of]), ids[of], y, p, k, shipped.value.axes, radius, cap)
                yield pa.RecordBatch.from_arrays([pa.array(ids[of][r]), pa.array(p[c]), pa.array(s)], names)

    def verify_all(cap: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Of rows in order of group, points before those asked: a task holds the points of a group and ASKED of its questions, however many there are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most, now, held, points, waiting = shipped.value.cap if cap is None else cap, None, [], None, []
            for batch in batches:
                part = batch.column("part").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    if part[a] != now:
                        if waiting:
                            yield from verified_in(points, waiting, most)
                        now, held, points, waiting = part[a], [], None, []
                    n = b - a - batch.column("cell").slice(a, b - a).null_count
                    if n:
                        held.append(batch.slice(a, n).select(["cell", "id", "vec"]))
                    if n == b - a:
                        continue
                    if points is None:
                        points, held = Group(held, dim), []
                    asked = batch.slice(a + n, b - a - n)
                    yield passed(asked)
                    if len(asked) > asked.column("vec").null_count:
                        waiting.append(asked.filter(asked.column("vec").is_valid()).select(["id", "kth", "cells", "vec"]))
                    if sum(map(len, waiting)) >= ASKED:
                        yield from verified_in(points, waiting, most)
                        waiting = []
            if waiting:
                yield from verified_in(points, waiting, most)

        return run

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All cells of those that the cap has left open, their own among them."""
        for b in (b.slice(i, ASKED_STEP) for b in batches for i in range(0, b.num_rows, ASKED_STEP)):
            if b.num_rows:
                kth = b.column(1).to_numpy()
                radius = np.minimum(np.sqrt(np.maximum(2 - 2 * kth, 0)) + 1e-3, 2.0)
                row, group, cells = by_group(*shipped.value.probes(_unit(_matrix(b.column(2), dim)).astype(np.float32), radius, -1), shipped.value.group)
                at, none = pa.array(row), pa.array(np.zeros(len(row) + 1, np.int32))
                lists = [pa.ListArray.from_arrays(none, pa.array([], kind)) for kind in (pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.nulls(len(at), pa.int32()), b.column(0).take(at), b.column(1).take(at), *lists, cells, b.column(2).take(at)], ["part", "cell", "id", "kth", "neighbours", "similarities", "cells", "vec"])

    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")

    def best(found: DataFrame) -> DataFrame:
        merged = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
        return merged.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")

    shape, result = "part int, cell int, id bigint, kth double, neighbours array<bigint>, similarities array<double>, cells array<int>, vec array<float>", "id bigint, neighbour bigint, similarity double"

    def verify(asked: DataFrame, cap: float | None = None) -> DataFrame:
        rows = placed.unionByName(asked, allowMissingColumns=True).select(*asked.columns).repartition("part")
        return rows.sortWithinPartitions("part", F.col("cell").asc_nulls_last()).mapInArrow(verify_all(cap), result)

    asked = placed.groupBy("cell").applyInArrow(home, shape)
    # narrow rows, used again and again
    top = durable(best(verify(asked)), "top")
    if tree.depth:
        has = top.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("similarity").alias("_s"))
        within = (F.col("_n") == k) & (F.sqrt(F.greatest(2 - 2 * F.col("_s"), F.lit(0.0))) + 1e-3 <= tree.cap)
        rest = base.select("id").distinct().join(has, "id", "left").where(~F.coalesce(within, F.lit(False)))
        rest, _ = sent_if_small(rest.select("id", F.when(F.col("_n") == k, F.col("_s")).otherwise(-1.0).alias("kth")), SENT_OPEN, "open")
        again = base.join(rest, "id").select("id", "kth", "vec").mapInArrow(further, shape)
        top = durable(best(top.unionByName(verify(again, 2.0))), "top")
    # the ids left out as copies: of the first copy and its neighbours, the k smallest of similarity 1
    copies = copies.withColumn("_salt", F.pmod(F.xxhash64("copy"), F.lit(SALTS)).cast("int"))
    lists = top.join(firsts, "id").unionByName(firsts.select("id", F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity")))
    ranked_lists = lists.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    taken = copies.join(ranked_lists, ["id", "_salt"]).select(F.col("copy").alias("id"), "neighbour", "similarity")
    return top.unionByName(taken)


def pairs(neighbours: DataFrame) -> DataFrame:
    """(a, b), a < b: every unordered pair of a vector and one of its neighbours."""
    return neighbours.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
