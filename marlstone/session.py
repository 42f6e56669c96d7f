"""Session helpers: building a local session, and cutting lineage in a folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
SENT_ROWS = 100_000


def local_session(cores: str | int = 8, shuffle_partitions: int = 8, app: str = "marlstone") -> SparkSession:
    """A session for one machine; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only a local master may go without: it gets a folder of its own, removed at exit."""
    named = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jvm.get() if jvm.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"executors share no folder: set {CHECKPOINT_KEY}")
        own = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, own, True)
        named = "file://" + own
        spark.conf.set(CHECKPOINT_KEY, named)
    return named


def _steps(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/marlstone-{spark.sparkContext.applicationId}"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The later plan starts at files that outlive any executor, and a step used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{_steps(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, most: int = SENT_ROWS, name: str = "side") -> tuple[DataFrame, bool]:
    """df, written, and whether it has `most` rows at most: then it is marked to be sent to all executors. Beyond that it is joined by its keys."""
    kept = durable(df, name)
    small = kept.limit(most + 1).count() <= most
    return (F.broadcast(kept) if small else kept), small


def one_a_key(df: DataFrame, key: str, keys: DataFrame | None = None, most: int = 1 << 20) -> DataFrame:
    """df with one row a key, and with keys only those rows whose key is in them.

    As dropDuplicates and a semi join, but what is shuffled are keys. Only rows whose key comes again, isn't in keys or is null are set
    apart: the keys of these are sent to the rows, unless there are more than `most`; then they are joined by the key.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if keys is not None:
        counts = counts.join(keys.select(key, F.lit(True).alias("_in")).distinct(), key, "left")
        odd = counts.where("_n > 1 or _in is null").select(key, F.coalesce("_in", F.lit(False)).alias("_in"))
    else:
        odd = counts.where("_n > 1").select(key, F.lit(True).alias("_in"))
    odd, _ = sent_if_small(odd, most, "odd")
    usual = df.where(F.col(key).isNotNull()).join(odd, key, "left_anti")
    again = df.join(odd.where("_in"), key, "left_semi")
    if keys is None:
        again = again.unionByName(df.where(F.col(key).isNull()))
    return usual.unionByName(again.dropDuplicates([key]))


def clear(spark: SparkSession) -> None:
    """Remove what this application has written with durable(); results not yet read are lost with it."""
    _remove(spark, _steps(spark))


def stage(spark: SparkSession, path: str, compute: Callable[[], DataFrame], redo: bool = False) -> DataFrame:
    """A slow stage that a later attempt resumes from: computed and written at path once, read from there afterwards.

    A stage counts as there when its write was committed; what a broken attempt left is written anew, as with redo.
    """
    if redo or not _exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_stage(spark: SparkSession, path: str) -> None:
    """To be called when the work that needed the stage has succeeded."""
    _remove(spark, path)
