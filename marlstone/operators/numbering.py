"""Running sums within keys that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import durable


def running_sum(rows: DataFrame, value: Column, key: list[str], order: list[Column | str], name: str, before: bool = False) -> DataFrame:
    """rows with `name`: the sum of value from a key's first row, in `order`, up to this row (before: up to the row before).

    Rows are laid out in ranges of key and order together, so a key with a large share of the rows lies in many ranges.
    Sums run within a range and are shifted by those of the key's ranges ahead, of which there are few. Keys are not null.
    """
    placed = durable(rows.withColumn("_v", value).repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*key, "_range").agg(F.sum("_v").alias("_s")).select(*key, "_range", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    summed = placed.withColumn("_inside", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return summed.join(sums, [*key, "_range"]).withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_v", "_range", "_inside", "_ahead")
