"""Flags and counts of occasions, and set numbers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from gapkit.functions import weekday_name
from gapkit.operators.ordered import whole_group
from gapkit.operators.sets import union_all

# What marks a broadcast, a soundcheck and an opening slot. Fixed values.
RADIO_PATTERNS = (r"\b\d+\.\d+FM\b", r"\b\d+\.\d\b")
RADIO_TERMS = (
    "NBC STUDIOS", "ED SULLIVAN THEATER", "STUDIO 6B, ROCKAFELLER CENTER", "CNN STUDIOS", " STUDIO", " RECORD",
)
SOUNDCHECK_MARK = "[Soundcheck; "
OPENING_MARK = "opened for"
ENCORE_SET = 99


def is_radio(
    venue: Column, patterns: tuple[str, ...] = RADIO_PATTERNS, terms: tuple[str, ...] = RADIO_TERMS
) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | venue.rlike(pattern)
    for term in terms:
        hit = hit | venue.contains(term)
    return F.coalesce(hit, F.lit(False)).cast("int")


def is_soundcheck(notes: Column, mark: str = SOUNDCHECK_MARK) -> Column:
    return F.coalesce(notes.contains(mark), F.lit(False)).cast("int")


def is_opening_act(notes: Column, mark: str = OPENING_MARK) -> Column:
    return F.coalesce(F.lower(notes).contains(mark), F.lit(False)).cast("int")


def set_number(label: Column) -> Column:
    """Set label to number, the encore last."""
    return F.when(label == "E", F.lit(ENCORE_SET)).otherwise(label.try_cast("int"))


def renumber_sets(df: DataFrame, occasion: str = "occasion_id", label: str = "set_label") -> DataFrame:
    """Numeric ``set_no``; a lone set 0, with or without an encore, becomes set 1."""
    numbered = df.withColumn("set_no", set_number(F.col(label)))
    spread = whole_group(numbered, [occasion], min_set=F.min("set_no"), max_set=F.max("set_no"))
    lone = (F.col("set_no") == 0) & (F.col("min_set") == 0) & F.col("max_set").isin(ENCORE_SET, 0)
    return spread.withColumn("set_no", F.when(lone, F.lit(1)).otherwise(F.col("set_no")))


def items_per_occasion(plays: DataFrame, occasion: str = "occasion_id", position: str = "position") -> DataFrame:
    return plays.groupBy(occasion).agg(F.max(position).alias("n_items"))


def enrich_occasions(
    occasions: DataFrame, plays: DataFrame, as_of: date | str, notes: DataFrame | None = None,
    venue: str = "venue_full",
) -> DataFrame:
    """Past and future occasions with item counts, notes, weekday and the three flags.

    Future occasions have no items, no notes and no flags but the broadcast one.
    """
    day = F.lit(as_of).cast("date")
    joined = occasions.join(items_per_occasion(plays), "occasion_id", "left")
    if notes is not None:
        joined = joined.join(notes.select("occasion_id", "occasion_notes"), "occasion_id", "left")
    else:
        joined = joined.withColumn("occasion_notes", F.lit(None).cast("string"))
    text = F.col("occasion_notes")
    past = joined.where(F.col("occ_date") < day).withColumns({
        "is_soundcheck": is_soundcheck(text), "is_opening_act": is_opening_act(text), "is_future": F.lit(0),
    })
    future = occasions.where(F.col("occ_date") >= day).withColumns({
        "is_soundcheck": F.lit(0), "is_opening_act": F.lit(0), "is_future": F.lit(1),
    })
    both = union_all(past, future)
    return both.withColumns({
        "n_items": F.coalesce("n_items", F.lit(0)),
        "occasion_notes": F.coalesce("occasion_notes", F.lit("")),
        "is_radio": is_radio(F.col(venue)),
        "weekday": weekday_name(F.col("occ_date")),
    })
