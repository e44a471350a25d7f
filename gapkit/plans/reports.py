"""What is shown: top rows with display names, and how fresh each source is."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Display names. Fixed values.
OVERDUE_HEADINGS = {
    "rank": "Rank", "item": "Song", "times_played_total": "Times Played", "ltp_date": "Last Show Played",
    "current_gap": "Current Show Gap", "avg_gap": "Average Show Gap", "med_gap": "Median Show Gap",
    "current_minus_avg": "Current Gap Minus Average", "current_minus_med": "Current Gap Minus Median",
}
ROTATION_HEADINGS = {
    "rank": "Rank", "item": "Song", "times_played_recent": "Times Played Last Year",
    "ltp_date": "Last Show Played", "current_gap": "Current Show Gap", "avg_gap": "Average Show Gap",
    "med_gap": "Median Show Gap",
}
TWO_YEAR_HEADING = "Times Played Last 2 Years"
TOP_ROWS = 50


def top_report(
    ranking: DataFrame, order: Sequence[str | Column], headings: Mapping[str, str] | None = None,
    n: int = TOP_ROWS, drop: Sequence[str] = (),
) -> DataFrame:
    """The first n rows with their rank in front; the rank window sees those n rows only."""
    top = ranking.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    shown = top.withColumn("rank", rank)
    shown = shown.select("rank", *[c for c in ranking.columns if c not in drop])
    return shown.withColumnsRenamed(dict(headings)) if headings else shown


def overdue_report(scores: DataFrame, n: int = TOP_ROWS, headings: Mapping[str, str] | None = None) -> DataFrame:
    """Top of :func:`gapkit.plans.rankings.overdue_scores`."""
    return top_report(scores, [F.desc_nulls_last("gap_zscore"), F.asc("item")], headings, n, ["gap_zscore"])


def rotation_report(ranking: DataFrame, n: int = TOP_ROWS, headings: Mapping[str, str] | None = None) -> DataFrame:
    return top_report(ranking, [F.desc("times_played_recent"), F.asc("item")], headings, n)


def freshness(stamps: DataFrame, names: DataFrame, key: str = "source") -> DataFrame:
    """Last update of every named source, ``Unknown`` where none is recorded."""
    joined = names.select(key).distinct().join(stamps.select(key, "last_updated"), key, "left")
    return joined.withColumn("last_updated", F.coalesce("last_updated", F.lit("Unknown")))
