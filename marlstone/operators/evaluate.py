"""Retrieval metrics over a run (query_id, chunk_id, rank from 1) and judgements (query_id, chunk_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): gain rel, discount log2(rank + 1); 0 without relevant chunks. Every judged query has a row."""
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    got = run.where(F.col("rank") <= k).join(qrels, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.sum(gain).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rel"), "chunk_id")
    ideal = qrels.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain).alias("idcg"))
    return ideal.join(got, "query_id", "left").select("query_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def recall(run: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, recall): share of the relevant chunks within the first k; 0 if there are none."""
    relevant = qrels.where("rel > 0")
    found = run.where(F.col("rank") <= k).join(relevant, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    all_ = qrels.groupBy("query_id").agg(F.count_if(F.col("rel") > 0).alias("m"))
    return all_.join(found, "query_id", "left").select("query_id", F.when(F.col("m") > 0, F.coalesce("n", F.lit(0)) / F.col("m")).otherwise(0.0).alias("recall"))


def ablation(runs: dict[str, DataFrame], qrels: DataFrame, k: int = 10, deep: int = 100) -> DataFrame:
    """(leg, ndcg, recall): means over the judged queries of each run."""
    out = None
    for name, run in runs.items():
        rows = ndcg(run, qrels, k).join(recall(run, qrels, deep), "query_id").agg(F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall")).select(F.lit(name).alias("leg"), "ndcg", "recall")
        out = rows if out is None else out.unionByName(rows)
    return out


def full_ranking(scored: DataFrame, queries: DataFrame, ids: DataFrame, depth: int, known: DataFrame | None = None) -> DataFrame:
    """The first `depth` of every query's ranking of all chunks, those without a score counting 0.

    scored: the `depth` best of each query. known: the ids that a leg scores for every query it has anything for, also
    below 0; they don't count 0 there. Only the smallest ids without a score can be reached, so just they are paired with queries.
    """
    smallest = lambda rows: F.broadcast(rows.select("chunk_id").distinct().orderBy("chunk_id").limit(2 * depth))  # noqa: E731 - 2 * depth rows
    asked = queries.select("query_id")
    if known is None:
        added = asked.crossJoin(smallest(ids))
    else:
        met = scored.select("query_id").distinct()
        added = asked.join(met, "query_id", "left_semi").crossJoin(smallest(ids.join(known.select("chunk_id").distinct(), "chunk_id", "left_anti")))
        added = added.unionByName(asked.join(met, "query_id", "left_anti").crossJoin(smallest(ids)))
    added = added.join(scored, ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    every = scored.select("query_id", "chunk_id", "score").unionByName(added)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)
