"""Exact cosine search of a batch of query vectors, with filters.

The queries are the stated, small side: they are taken in blocks of BLOCK rows, whose size is thereby
bounded, and each block is compared in one pass over the vectors by matrix products. A partition keeps
no more than k candidates a query, and more blocks have fewer partitions each (products.sliced), so what is
shuffled follows the queries and the cores, not the vectors.

Products are made in single precision first. What lies within their error of a query's k-th best so far is
computed again in double precision, so the results are those of double precision alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.lexical import top_k
from marlstone.operators.products import Best, sliced
from marlstone.session import durable

BLOCK, STEP = 2048, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where either vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def usable(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has dim numbers, none of them null or NaN, and not all 0."""
    v = F.col(vector)
    return vectors.where(v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, dim: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the exact k best by cosine among the allowed chunks; queries without a vector have no rows."""
    rows = usable(vectors, dim).select("chunk_id", "embedding")
    if allowed is not None:
        rows = rows.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    asked = usable(queries, dim).select("query_id", "embedding")
    count = asked.count()
    blocks = max(1, -(-count // BLOCK))
    if blocks > 1:  # each block reads them
        asked, rows = durable(asked, "asked"), sliced(durable(rows, "vectors"), blocks)
    parts = []
    for i in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        parts.append(_block(rows, block, k, dim))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return top_k(scored, k)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block(rows: DataFrame, block: DataFrame, k: int, dim: int) -> DataFrame:
    got = block.toArrow()
    names, q = got.column("query_id").combine_chunks(), _unit(got.column("embedding").combine_chunks(), dim) if got.num_rows else np.empty((0, dim))
    shipped = rows.sparkSession.sparkContext.broadcast((names, q))
    schema = block.select("query_id").crossJoin(rows.select("chunk_id")).select("query_id", "chunk_id", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shipped.value
        if not len(q):
            return
        # both sides have length 1: the sum of dim products in single precision is off by no more than this
        best, single = Best(len(q), k, 2 * (dim + 4) * 2.0**-24), q.astype(np.float32)
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                some = b.slice(i, STEP)
                x, ids = _unit(some.column(1), dim), some.column(0).to_numpy()
                key = single @ x.astype(np.float32).T
                if not (np.isfinite(x).all() and np.isfinite(q).all()):
                    key = np.where(np.isnan(key), np.inf, key)  # NaN is the greatest, as in SQL
                at, c = best.places(key)
                best.take(at, ids[c], np.einsum("ij,ij->i", q[at], x[c]))
        at, ids, s = best.best()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(ids), pa.array(s)], ["query_id", "chunk_id", "score"])

    return rows.mapInArrow(run, schema)
