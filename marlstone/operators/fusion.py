"""Reciprocal rank fusion of ranked legs, and re-ranking for diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.lexical import SCALE
from marlstone.session import durable

RRF, LAMBDA = 60, 0.7


def rrf(legs: list[DataFrame], constant: int = RRF) -> DataFrame:
    """(query_id, chunk_id, score, rank): sum of 1 / (rank from 0 + constant); ties by the first leg, then its rank."""
    every = None
    for i, leg in enumerate(legs):
        part = leg.select("query_id", "chunk_id", (F.col("rank") - 1).alias("_r"), F.lit(i).alias("_leg"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.col("_r") + constant)).alias("score"), F.min(F.struct("_leg", "_r")).alias("_first"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", SCALE)), "_first", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).drop("_first")


def min_max(pool: DataFrame) -> DataFrame:
    """Adds rel: the score scaled to 0..1 within a query's pool; 1 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return pool.withColumn("rel", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def pick_diverse(rel: np.ndarray, sims: np.ndarray, k: int, weight: float = LAMBDA) -> list[int]:
    """Places chosen one by one: weight * rel - (1 - weight) * the greatest similarity (0 at least) to those chosen."""
    left, chosen, near = list(range(len(rel))), [], np.zeros(len(rel))
    while left and len(chosen) < k:
        value = np.round(weight * rel[left] - (1 - weight) * near[left], 12)
        i = left.pop(int(np.argmax(value)))
        chosen.append(i)
        near = np.maximum(near, sims[i])
    return chosen


def mmr(fused: DataFrame, vectors: DataFrame, k: int, pool: int | None = None, weight: float = LAMBDA) -> DataFrame:
    """(query_id, chunk_id, score, position): k of the `pool` best, in order of relevance less redundancy.

    A pool of one, or with fewer than two vectors, keeps the fused order; a missing or zero vector is similar to none.
    A query's pool is at most max(2k, 20) rows, so a group is bounded.
    """
    pool = pool or max(2 * k, 20)
    best = durable(min_max(fused.where(F.col("rank") <= pool)), "pool")
    # the pool's few ids are the side that Spark may send to the vectors; only what meets them is brought together
    met = vectors.select("chunk_id", "embedding").join(best.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rows = best.join(met, "chunk_id", "left")
    schema = fused.select("query_id", "chunk_id", "score", F.lit(0).alias("position")).schema

    def order(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        with_vector = [i for i, v in enumerate(group["embedding"]) if v is not None]
        chosen = list(range(min(k, len(group))))
        if len(group) > 1 and len(with_vector) > 1:
            x = np.zeros((len(group), max(len(v) for v in group["embedding"] if v is not None)))
            for i in with_vector:
                v = np.asarray(group["embedding"][i], np.float64)
                x[i, : len(v)] = v
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            chosen = pick_diverse(group["rel"].to_numpy(), x @ x.T, k, weight)
        out = group.loc[chosen, ["query_id", "chunk_id", "score"]].copy()
        out["position"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    return rows.groupBy("query_id").applyInPandas(order, schema)
