"""Gap statistics kept up to date: what is past is folded into a state, and a ranking reads the state and the plays after it.

Plays up to a sequence number, the *cut*, are *closed*. Of an item the state keeps a histogram of its closed gaps, with first and
last plays, and the sequence number of its last closed point. Both are mergeable: closing more plays adds rows to the histogram and
moves the last point on, and the first open play of an item takes its gap from that point. Late plays after the cut need
nothing special, as open plays are read from the table; so the cut lies before what an update may still change.

The state of an item holds at most as many rows as the item has different gaps, about sqrt(2 S) over S occasions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapkit.plans.history import between, counted_occasions, last_points, play_points
from gapkit.plans.rankings import SPANS, gap_rows, overdue, rotation
from gapkit.sources.tables import current_version, store_version
from gapkit.spec import Bundle, GapSpec, as_day

_MERGE = {"w": F.sum, "first_seq": F.min, "last_seq": F.max}


@dataclass(frozen=True)
class GapState:
    """``histogram``: group, ``item_id``, flag, ``gap, w, first_seq, last_seq, first_date, last_date``; ``w`` counts the plays with that
    gap. ``tails``: group, ``item_id, tail_seq``. All plays up to ``cut`` are in them."""

    cut: int
    histogram: DataFrame
    tails: DataFrame


def cut_before(bundle: Bundle, spec: GapSpec, day: date | str) -> int:
    """The last sequence number of a day before ``day``; 0 if there is none. One number comes to the driver."""
    past = counted_occasions(bundle, spec).where(F.col("occ_date") < F.lit(as_day(day)))
    return past.agg(F.coalesce(F.max("occ_seq"), F.lit(0)).cast("long")).first()[0]


def _keys(spec: GapSpec) -> list[str]:
    return [*spec.group, "item_id", *(["is_original"] if spec.flag_source == "play" else [])]


def _fold(rows: DataFrame, spec: GapSpec) -> DataFrame:
    """One row for each item and gap."""
    return rows.groupBy(*_keys(spec), "gap").agg(
        *[how(c).alias(c) for c, how in _MERGE.items()],
        F.min_by("first_date", "first_seq").alias("first_date"), F.max_by("last_date", "last_seq").alias("last_date"))


def close(bundle: Bundle, spec: GapSpec, cut: int, state: GapState | None = None) -> GapState:
    """The state with all plays up to ``cut``; with the state of an earlier cut, only the plays after that are read."""
    if spec.group:
        raise ValueError("sequence numbers of groups differ: keep one state for each group")
    if state is not None and state.cut > cut:
        raise ValueError(f"the state is closed up to {state.cut}, after {cut}")
    part = between(bundle, state.cut if state is not None else -(1 << 31), cut)
    points = play_points(part, spec, tails=state.tails if state is not None else None)
    rows, ends = gap_rows(points, spec).select(*_keys(spec), "gap", "w", *SPANS), last_points(part, spec)
    if state is not None:
        rows, ends = rows.unionByName(state.histogram), ends.unionByName(state.tails)
    tails = ends.groupBy(*spec.group, "item_id").agg(F.max("tail_seq").alias("tail_seq"))
    return GapState(cut, _fold(rows, spec), tails)


def store(state: GapState, path: str) -> GapState:
    """Store the state as the next version of the one at ``path``, which it may have been made from, and read it back."""
    rows = state.histogram.withColumn("tail_seq", F.lit(None).cast(state.tails.schema["tail_seq"].dataType)).unionByName(
        state.tails, allowMissingColumns=True)
    spark = state.histogram.sparkSession
    store_version(rows.withColumn("cut", F.lit(state.cut).cast("long")), path)
    return load(spark, path) or replace(state, histogram=state.histogram.limit(0), tails=state.tails.limit(0))


def load(spark: SparkSession, path: str) -> GapState | None:
    """The stored state, or nothing if there is none or it holds no plays."""
    found = current_version(spark, path)
    if found is None:
        return None
    rows = spark.read.parquet(found)
    cut = rows.select("cut").first()
    if cut is None:
        return None
    own = [c for c in rows.columns if c not in ("tail_seq", "cut")]
    keys = [c for c in own if c not in ("gap", "w", *SPANS, "is_original")]
    return GapState(cut[0], rows.where("tail_seq is null").select(*own), rows.where("tail_seq is not null").select(*keys, "tail_seq"))


def overdue_from(state: GapState, bundle: Bundle, spec: GapSpec, as_of: date | str) -> DataFrame:
    """The overdue ranking of all plays, from the state and the plays of ``bundle`` after its cut."""
    return overdue(bundle, spec, as_of, closed=state)


def rotation_from(state: GapState, bundle: Bundle, spec: GapSpec, as_of: date | str) -> DataFrame:
    """The rotation ranking of all plays; the cut must lie before the ranking's window."""
    since = as_day(as_of) - timedelta(days=spec.window_days)
    inside = counted_occasions(bundle, spec).where((F.col("occ_seq") <= state.cut) & (F.col("occ_date") > F.lit(since)))
    if not inside.isEmpty():
        raise ValueError(f"the state is closed up to {state.cut}, inside the window from {since} on")
    return rotation(bundle, spec, as_of, closed=state)
