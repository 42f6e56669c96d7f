"""Frequency of every term of a postings table, from a vertical layout of record bitmaps.

Each (term, block of 64 record ids) is one row: a 64-bit map of the records that hold the term and a
counter of its occurrences. Empty blocks are not stored, so a rare term costs as many words as it has
records, and a common one a bit a record. Maps are merged by union (bit_or), counters by sum, and the
document frequency is the number of bits set. All of it are primitive buffers inside generated code.

Plan: rows are shuffled once, by the block of the record id. A term that holds a third of all rows is
thereby spread over all tasks, while exact repeats, the records still alive and the words of the maps
all meet in the same task. What is shuffled by term afterwards is one pre-aggregated row per term and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE_AT_MOST = 2
COMMON_SHARE = 0.15
BLANKS = " \t\r\n "


def block_of(record: Column) -> Column:
    return F.shiftright(record, 6)


def bit_of(record: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), record.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def record_bitmap(records: DataFrame, record: str = "chunk_id") -> DataFrame:
    """(block, live): which record ids exist, 64 to a row; nulls are no records."""
    id_ = F.col(record).cast("bigint")
    return (
        records.select(id_.alias("_id"))
        .where("_id is not null")
        .groupBy(block_of(F.col("_id")).alias("_block"))
        .agg(F.bit_or(bit_of(F.col("_id"))).alias("_live"))
    )


def vertical(postings: DataFrame, records: DataFrame, term: str = "term", record: str = "chunk_id", weight: str = "tf", sum_weight: bool = True) -> DataFrame:
    """(block, term, bits, occ): the bitmap words and occurrence counters of every term.

    Rows with a null or blank term, a null record or record not in `records`, or a weight that is null,
    NaN or not above 0 don't count; rows equal in all three columns count once. Terms are lower-cased and
    trimmed. Other columns of the tables are never read.
    """
    raw = postings.select(
        F.col(term).alias("_term"),
        F.col(record).cast("bigint").alias("_id"),
        F.col(weight).alias("_w"),
    ).where(
        (F.btrim(F.col("_term"), F.lit(BLANKS)) != "") & F.col("_id").isNotNull() & (F.col("_w") > 0) & ~F.isnan(F.col("_w").cast("double"))
    )
    live = record_bitmap(records, record)
    kept = (
        raw.withColumn("_block", block_of(F.col("_id")))
        .join(live.hint("shuffle_hash"), "_block")
        .where(F.col("_live").bitwiseAND(bit_of(F.col("_id"))) != 0)
        .groupBy("_block", "_id", "_term", "_w")
        .agg(F.lit(1).alias("_one"))
    )
    occ = F.sum("_w") if sum_weight else F.count(F.lit(1))
    return (
        kept.withColumn("_norm", F.btrim(F.lower("_term"), F.lit(BLANKS)))
        .groupBy("_block", "_norm")
        .agg(F.bit_or(bit_of(F.col("_id"))).alias("_bits"), occ.alias("_occ"))
    )


def live_records(postings: DataFrame, records: DataFrame, term: str, record: str, weight: str) -> DataFrame:
    """One row: the number of different records among the rows that count."""
    rows = postings.where(
        (F.btrim(F.col(term), F.lit(BLANKS)) != "") & F.col(record).isNotNull() & (F.col(weight) > 0) & ~F.isnan(F.col(weight).cast("double"))
    )
    used = record_bitmap(rows, record).withColumnRenamed("_live", "_used")
    return used.join(record_bitmap(records, record), "_block").agg(
        F.coalesce(F.sum(F.bit_count(F.col("_used").bitwiseAND(F.col("_live")))), F.lit(0)).cast("bigint").alias("n_records")
    )


def term_frequencies(
    postings: DataFrame,
    records: DataFrame,
    term: str = "term",
    record: str = "chunk_id",
    weight: str = "tf",
    sum_weight: bool = True,
    rare_at_most: int = RARE_AT_MOST,
    common_share: float = COMMON_SHARE,
) -> DataFrame:
    """(term, occurrences, records, mark) for every distinct term.

    mark: `rare` up to rare_at_most occurrences, else `common` in more than common_share of the records
    that have any row, else null. Empty tables give no rows. Repeated rows, nulls and blanks: see vertical().
    """
    words = vertical(postings, records, term, record, weight, sum_weight)
    counts = words.groupBy("_norm").agg(
        F.sum("_occ").cast("bigint").alias("occurrences"),
        F.sum(F.bit_count("_bits")).cast("bigint").alias("records"),
    )
    # one row, whatever the size of the data
    total = F.broadcast(live_records(postings, records, term, record, weight))
    mark = F.when(F.col("occurrences") <= rare_at_most, "rare").when(F.col("records") > F.lit(common_share) * F.col("n_records"), "common")
    return counts.crossJoin(total).select(F.col("_norm").alias("term"), "occurrences", "records", mark.alias("mark"))
