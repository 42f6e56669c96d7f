"""Streams: new documents into postings, and leases that run out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.lexical import postings


def chunk_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def index_stream(chunks: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch's postings, of distinct chunks, to sink(postings, batch id); a batch run again gives the same."""

    def batch(rows: DataFrame, n: int) -> None:
        sink(postings(rows.dropDuplicates(["chunk_id"])), n)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired_leases(beats: DataFrame, lease_seconds: int = 180, watermark: str = "10 minutes") -> DataFrame:
    """(job, last): a row when event time has passed a job's last heartbeat by the lease. Needs (job bigint, at timestamp)."""

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "last": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else 0
        for r in rows:
            last = max(last, int(r["at"].max().value // 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + lease_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = beats.withWatermark("at", watermark).groupBy("job")
    return rows.applyInPandasWithState(update, "job bigint, last timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Activity sessions of a user: works on a stream and on a table."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
