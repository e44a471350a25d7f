"""Runs of consecutive occasions (gaps and islands)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gapkit.operators.ordered import running_breaks, seq_bucket, whole_group
from gapkit.spec import SEQ_BUCKET


def run_index(
    df: DataFrame, place: str, order: Sequence[str], out: str = "run_index",
    keys: Sequence[str] = (), bucket: Column | None = None, date_col: str | None = None,
    blocks: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Number the runs: a new one starts when the place changes or is unknown.

    With ``date_col`` a step other than one day also starts a run. The default bucket takes the first order
    column as an integer sequence. The rows are dealt out once. ``blocks``: see :func:`running_breaks`.
    """
    keys, order = list(keys), list(order)
    bucket = seq_bucket(order[0], SEQ_BUCKET) if bucket is None else bucket
    here = F.struct(F.col(place).alias("p"), *([F.col(date_col).alias("d")] if date_col else []))

    def breaks(before: Column, now: Column) -> Column:
        same = before["p"] == now["p"]
        if date_col:
            same = same & (F.datediff(now["d"], before["d"]) == 1)
        return F.when(same, 0).otherwise(1).cast("long")

    return running_breaks(df, keys, order, here, breaks, out, bucket, blocks)


def position_in_run(
    df: DataFrame, run_col: str, seq_col: str, out: str = "pos_in_run", keys: Sequence[str] = ()
) -> DataFrame:
    """1-based position inside the run."""
    tagged = whole_group(df, [*keys, run_col], __start=F.min(seq_col))
    return tagged.withColumn(out, F.col(seq_col) - F.col("__start") + 1).drop("__start")
