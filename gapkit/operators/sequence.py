"""Sequence numbers for calendars and fact tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from gapkit.operators.ordered import row_ordinal, seq_bucket, whole_group
from gapkit.session import ensure_checkpoint_dir
from gapkit.spec import SEQ_BUCKET

_ID = "__row"
_PART = "__part"
_LOCAL = "__local"
_TIE = "__tie"


def date_sequence(
    df: DataFrame, date_col: str, out: str, group: Sequence[str] = ()
) -> DataFrame:
    """Dense rank of the distinct dates, one row per (group, date). Time stamps are refused: their number has no bound.

    Duplicates go map-side, so the window sees days only: 366 rows a year.
    """
    if isinstance(df.schema[date_col].dataType, (TimestampType, TimestampNTZType)):
        raise TypeError(f"{date_col} holds time stamps; cast it to a date")
    days = df.where(F.col(date_col).isNotNull()).select(*group, date_col).distinct()
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(date_col)
    return days.withColumn(out, F.row_number().over(w))


def with_date_sequence(df: DataFrame, date_col: str, out: str, group: Sequence[str] = ()) -> DataFrame:
    """Attach the dense date rank.

    Without groups the rank table has one row per day, some thousands for any calendar, and is broadcast. With
    groups its size is unknown and Spark decides.
    """
    days = date_sequence(df, date_col, out, group)
    return df.join(days if group else F.broadcast(days), [*group, date_col], "left")


def global_sequence(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Number all rows 1..n by ``order`` without gathering them in one task.

    Range-partition and sort by the order, number rows inside each partition, then add the row counts of
    the earlier partitions. ``order`` should end in a unique key; equal rows are told apart by where they came
    from, so that copies spread over several partitions too. Rows and their partition numbers are written to the
    checkpoint folder as Parquet, as range bounds are sampled and could differ between two runs of the same plan; later
    plans read the columns they need, and Spark knows the size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/sequence-{uuid.uuid4().hex}"
    mid = F.monotonically_increasing_id()
    numbered = (
        df.withColumn(_TIE, mid)
        .repartitionByRange(*order, _TIE)
        .sortWithinPartitions(*order, _TIE)
        .drop(_TIE)
        .withColumn(_ID, mid)
        .withColumns({
            # partition number in the upper bits, row number within it in the lower 33
            _PART: F.shiftright(F.col(_ID), 33),
            _LOCAL: F.col(_ID).bitwiseAND(F.lit((1 << 33) - 1)),
        })
        .drop(_ID)
    )
    numbered.write.parquet(path)
    numbered = spark.read.schema(numbered.schema).parquet(path)
    counts = numbered.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"))
    # one row per range partition: window and broadcast are as small as the partition count
    before = Window.partitionBy(F.lit(0)).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (
        numbered.join(F.broadcast(offsets), _PART)
        .withColumn(out, F.col("__before") + F.col(_LOCAL) + F.lit(1))
        .select(*df.columns, out)
    )


def sequence_within(
    df: DataFrame, keys: Sequence[str], seq_col: str, out: str, width: int = SEQ_BUCKET
) -> DataFrame:
    """1-based position within ``keys`` by an integer sequence column."""
    return row_ordinal(df, keys, [seq_col], out, seq_bucket(seq_col, width))


def ordinal_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based position within ``keys`` for any order and any skew, copies included.

    All rows are numbered by ``keys + order``; the position is the distance to the key's lowest number. No task
    sees a whole key.
    """
    numbered = global_sequence(df, [*keys, *order], "__seq")
    started = whole_group(numbered, keys, __start=F.min("__seq"))
    return started.withColumn(out, F.col("__seq") - F.col("__start") + 1).select(*df.columns, out)
