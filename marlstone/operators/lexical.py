"""Inverted postings, collection statistics and BM25 for a batch of queries.

Postings are a function of the chunks, so they are never stale. Document frequencies and lengths
are those of the whole collection; a filter only restricts which chunks are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.tokens import tokens
from marlstone.operators import products
from marlstone.session import durable, sent_if_small

K1, B, SCALE = 1.2, 0.75, 9


class Index:
    """The terms of a collection's chunks, one row a chunk, and its statistics; written once and used by every batch of queries.

    The rows carry the lengths, so the texts are split once and no second copy of the tokens is written. A chunk's tokens are
    counted where they lie, so none are shuffled; as everywhere, a chunk_id comes once.
    """

    def __init__(self, chunks: DataFrame, split=tokens, text: str = "text"):
        self.split = split
        self.packed = durable(counted(chunks, split, text), "postings")
        self.stats = posting_statistics(self.packed.select(F.explode("p.value").alias("tf")), chunks)

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        return _bm25(self.packed, self.stats, query_terms(queries, self.split), k, allowed, k1, b)


def postings(chunks: DataFrame, split=tokens, text: str = "text") -> DataFrame:
    """(term, chunk_id, tf, len): len is the number of tokens of the chunk. Chunks without tokens have no rows."""
    exploded = chunks.select("chunk_id", split(F.col(text)).alias("_t")).select("chunk_id", F.size("_t").alias("len"), F.explode("_t").alias("term"))
    return exploded.groupBy("term", "chunk_id", "len").agg(F.count(F.lit(1)).cast("int").alias("tf")).select("term", "chunk_id", "tf", "len")


def counted(chunks: DataFrame, split=tokens, text: str = "text") -> DataFrame:
    """(chunk_id, len, p): postings(), packed as by products.pack, without a shuffle."""
    rows = chunks.where("chunk_id is not null").select("chunk_id", split(F.col(text)).alias("_t"))
    schema = rows.select("chunk_id", F.size("_t").alias("len"), F.transform("_t", lambda t: F.struct(t.alias("term"), F.lit(0).alias("value"))).alias("p")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column(1)).fill_null(0).to_numpy()
            some = np.flatnonzero(size)
            if not len(some):
                continue
            codes = b.column(1).flatten().dictionary_encode()
            wide = len(codes.dictionary)
            key, tf = np.unique(np.repeat(np.arange(len(some)), size[some]) * wide + codes.indices.to_numpy(), return_counts=True)
            ends = np.searchsorted(key, np.arange(len(some) + 1) * wide).astype(np.int32)
            p = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([codes.dictionary.take(pa.array(key % wide)), pa.array(tf.astype(np.int32))], ["term", "value"]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(size[some].astype(np.int32)), p], ["chunk_id", "len", "p"])

    return rows.mapInArrow(run, schema)


def lengths(chunks: DataFrame, split=tokens, text: str = "text") -> DataFrame:
    return chunks.select("chunk_id", F.size(split(F.col(text))).alias("len"))


def statistics(doc_lengths: DataFrame) -> DataFrame:
    """One row: n, total_len, avg_len (1 for a collection without tokens)."""
    total = F.coalesce(F.sum("len"), F.lit(0)).cast("bigint")
    return doc_lengths.agg(F.count(F.lit(1)).alias("n"), total.alias("total_len"), F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("avg_len"))


def posting_statistics(posted: DataFrame, chunks: DataFrame) -> DataFrame:
    """As statistics(), from the postings: the lengths are the sums of tf; chunks without tokens count, too."""
    total = posted.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("bigint").alias("total_len"))
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(total)).select("n", "total_len", F.when((F.col("n") > 0) & (F.col("total_len") > 0), F.col("total_len") / F.col("n")).otherwise(1.0).alias("avg_len"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def top_k(scored: DataFrame, k: Column | int, tie: str = "chunk_id") -> DataFrame:
    """Adds rank (from 1) by score rounded to SCALE places, ties by `tie`; the partial limit runs before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", SCALE)), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, split=tokens, text: str = "text") -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(split(F.col(text)))).alias("term"))


def bm25(posted: DataFrame, stats: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, k1: float = K1, b: float = B, split=tokens) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each query. Queries without known terms have no rows.

    Unqueried postings are dropped before any shuffle of postings by chunk; the terms are sent to them if they are few.
    """
    terms = query_terms(queries, split)
    return _bm25(durable(products.pack(products.asked_only(posted, terms), "tf", "len"), "packed"), stats, terms, k, allowed, k1, b)


def _bm25(packed: DataFrame, stats: DataFrame, terms: DataFrame, k: int, allowed: DataFrame | None, k1: float, b: float) -> DataFrame:
    """A score is the inner product of the terms' inverse frequencies and the parts that a chunk's counts and length give."""
    terms = durable(terms, "asked")
    sent, _ = sent_if_small(terms.select("term").distinct(), name="terms")
    df = products.frequency(packed).join(sent, "term", "left_semi")
    weights = terms.join(df, "term").crossJoin(F.broadcast(stats.select("n"))).select("query_id", "term", idf(F.col("n"), F.col("df")).alias("w"))
    rows = packed if allowed is None else durable(packed.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi"), "packed")
    norm = k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    part = F.transform("p", lambda x: F.struct(x["term"].alias("term"), (x["value"] * (k1 + 1) / (x["value"] + F.col("_norm"))).alias("value")))
    valued = rows.crossJoin(F.broadcast(stats.select("avg_len"))).withColumn("_norm", norm).select("chunk_id", part.alias("p"))
    return top_k(products.best_products(valued, weights, k), k)
