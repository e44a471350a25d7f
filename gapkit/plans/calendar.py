"""Occasion, venue and tour dimensions from a landed list of occasions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from gapkit.functions import parse_mdy2
from gapkit.operators.lookups import correct_venue_and_city
from gapkit.operators.ordered import carry_forward, seq_bucket
from gapkit.operators.runs import run_index
from gapkit.operators.sequence import global_sequence
from gapkit.operators.sets import dimension, top_n
from gapkit.plans.parse import parse_schedule, schedule_occasions

ORDER = ("occ_date", "occ_order", "occasion_id")
VENUE_COLUMNS = ("venue_id", "venue", "city", "state", "country")
TOUR_COLUMNS = ("tour_id", "tour_name")
KEPT = ("occasion_id", "occ_date", "venue_id", "tour_id", "occ_order")


def _day(as_of: date | str) -> Column:
    return F.lit(as_of).cast("date")


def past_occasions(df: DataFrame, as_of: date | str, date_col: str = "occ_date") -> DataFrame:
    return df.where(F.col(date_col) < _day(as_of))


def future_occasions(
    df: DataFrame, as_of: date | str, date_col: str = "occ_date", include_today: bool = True
) -> DataFrame:
    day = _day(as_of)
    return df.where(F.col(date_col) >= day if include_today else F.col(date_col) > day)


def past_and_next(
    df: DataFrame, as_of: date | str, tie: Sequence[str], date_col: str = "occ_date"
) -> DataFrame:
    """All past occasions and the single next one; undated ones are left out."""
    upcoming = top_n(future_occasions(df, as_of, date_col), [date_col, *tie], 1)
    return past_occasions(df, as_of, date_col).unionByName(upcoming)


def up_to_first_future(
    df: DataFrame, as_of: date | str, date_col: str = "occ_date", undated: str = "if_last",
    calendar: DataFrame | None = None,
) -> DataFrame:
    """All occasions up to the day of the next one.

    Undated occasions: ``if_last`` keeps them only if nothing lies in the future, ``keep`` and ``drop``
    say so outright. ``calendar`` is where the next date is looked up, when that is cheaper than in ``df``.
    """
    if undated not in ("if_last", "keep", "drop"):
        raise ValueError(f"unknown choice for undated occasions: {undated!r}")
    col = F.col(date_col)
    first = (df if calendar is None else calendar).agg(F.min(F.when(col >= _day(as_of), col))).scalar()
    if undated == "drop":
        return df.where(col.isNotNull() & F.coalesce(col <= first, F.lit(True)))
    if undated == "keep":
        return df.where(col.isNull() | F.coalesce(col <= first, F.lit(True)))
    return df.where(first.isNull() | (col <= first))


def build_calendar(
    occasions: DataFrame, as_of: date | str, *, partition: Column | None = None, order: Sequence[str] = ORDER,
    venue_columns: Sequence[str] = VENUE_COLUMNS, tour_columns: Sequence[str] = TOUR_COLUMNS, keep: Sequence[str] = KEPT,
) -> dict[str, DataFrame]:
    """Occasions with their sequence number, venues and tours, of one performer if ``partition`` picks one.

    Numbering the occasions runs a job; who wants the other tables only calls their functions.
    """
    chosen = chosen_occasions(occasions, as_of, partition, order)
    result = {"occasions": calendar_occasions(chosen, order, keep)}
    if "venue_id" in chosen.columns:
        result["venues"] = calendar_venues(chosen, venue_columns)
    if "tour_id" in chosen.columns:
        result["tours"] = calendar_tours(chosen, tour_columns)
    return result


def chosen_occasions(
    occasions: DataFrame, as_of: date | str, partition: Column | None = None, order: Sequence[str] = ORDER
) -> DataFrame:
    """Past occasions and the next one of those that ``partition`` picks out of a shared list."""
    mine = occasions if partition is None else occasions.where(partition)
    return past_and_next(mine, as_of, [c for c in order if c in mine.columns and c != "occ_date"])


def calendar_occasions(chosen: DataFrame, order: Sequence[str] = ORDER, keep: Sequence[str] = KEPT) -> DataFrame:
    order = [c for c in order if c in chosen.columns]
    return global_sequence(chosen.select(*[c for c in keep if c in chosen.columns]), order, "occ_seq")


def calendar_venues(chosen: DataFrame, columns: Sequence[str] = VENUE_COLUMNS) -> DataFrame:
    return dimension(chosen, [c for c in columns if c in chosen.columns], "venue_id")


def calendar_tours(chosen: DataFrame, columns: Sequence[str] = TOUR_COLUMNS) -> DataFrame:
    return dimension(chosen, [c for c in columns if c in chosen.columns], "tour_id")


def linked_calendar(
    schedules: DataFrame, as_of: date | str, link_prefix: str = "", link_suffix: str = ""
) -> DataFrame:
    """Occasions out of yearly schedule texts ``(list_year, text)``.

    Numbered over all years and within each, with runs at one venue and corrected places. Runs follow the venue as
    printed. Occasions after the next one are left out.

    Entries are numbered as they are parsed, before anything is derived from them. All else goes by that number: the letters of a
    day in one pass by day, the runs and the places in a year, whose entries follow each other, in one by number.
    """
    entries = parse_schedule(schedules)
    numbered = global_sequence(entries, ["list_year", "entry_no"], "occ_seq")
    occasions = schedule_occasions(numbered, ["occ_seq"], seq_bucket("occ_seq"), link_prefix, link_suffix)
    runs = run_index(occasions, "venue", ["occ_seq"], blocks={"seq_in_year": ["list_year"]})
    kept = [c for c in occasions.columns if c != "occ_seq"]
    runs = runs.select(*kept, "occ_seq", "seq_in_year", "run_index")
    dates = numbered.select(parse_mdy2(F.col("day_text")).alias("occ_date"))
    return up_to_first_future(correct_venue_and_city(runs), as_of, calendar=dates)


def next_occasion(
    occasions: DataFrame, as_of: date | str, venues: DataFrame | None = None,
    tie: Sequence[str] = ("occasion_id",), include_today: bool = True,
) -> DataFrame:
    """The next occasion with its venue, if any; unknown venues give nulls. One row or none."""
    upcoming = top_n(future_occasions(occasions, as_of, include_today=include_today), ["occ_date", *tie], 1)
    if venues is not None:
        upcoming = upcoming.join(venues, "venue_id", "left")
    return upcoming.withColumn("days_until", F.datediff("occ_date", _day(as_of)))


def next_occasions(
    days: DataFrame, occasions: DataFrame, group: Sequence[str], day_col: str = "day",
    tie: Sequence[str] = ("occasion_id",), include_today: bool = True,
) -> DataFrame:
    """The rows of ``days`` (``group``, ``day_col`` and anything else) with the next occasion of their group as ``next_date`` and
    ``next_<tie>``, and ``days_until``; nulls where nothing lies ahead. Rows without a group or a day have nothing ahead.

    An as-of join in one ordered pass: occasions fold to the first of each (group, day), days to distinct ones, both combined
    map-side; their union is ordered backwards and the occasion met last is carried on. A group is cut into buckets of
    days, so no task sees all of a hot one; the result is joined back to the rows.
    """
    group, back, first = list(group), "__back", [f"__t{i}" for i in range(len(tie))]
    known = occasions.where(F.col("occ_date").isNotNull()).groupBy(*group, F.col("occ_date").alias("__day")).agg(
        F.min(F.struct(*[F.col(c).alias(n) for c, n in zip(tie, first)])).alias("__tie"))
    asked = days.select(*group, F.col(day_col).cast("date").alias("__day")).where(F.col("__day").isNotNull()).distinct()
    # going back in time, an occasion of the same day is met before the day if today counts
    met = known.select(*group, "__day", F.lit(0 if include_today else 2).alias("__side"), F.struct(F.col("__day").alias("d"), "__tie.*").alias("__next"))
    both = met.unionByName(asked.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    for key in group:
        both = both.where(F.col(key).isNotNull())
    ordered = both.withColumn(back, -F.unix_date("__day"))
    carried = carry_forward(ordered, group, [back, "__side"], "__next", "__found", seq_bucket(back), share=True)
    found = carried.where("__side = 1").select(
        *group, F.col("__day").alias("__asked"), F.col("__found.d").alias("next_date"),
        *[F.col(f"__found.{n}").alias(f"next_{c}") for c, n in zip(tie, first)])
    probe = days.withColumn("__asked", F.col(day_col).cast("date"))
    return probe.join(found, [*group, "__asked"], "left").select(
        *days.columns, "next_date", *[f"next_{c}" for c in tie], F.datediff("next_date", "__asked").alias("days_until"))
