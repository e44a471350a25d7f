"""Item statistics and the two published rankings: overdue and rotation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from gapkit.functions import days_before, format_day, gap_zscore, round2, sample_std
from gapkit.plans.history import between, counted_occasions, play_points
from gapkit.spec import Bundle, GapSpec, as_day

if TYPE_CHECKING:
    from gapkit.plans.state import GapState

OVERDUE_COLUMNS = (
    "item", "times_played_total", "ltp_date", "current_gap", "avg_gap", "med_gap",
    "current_minus_avg", "current_minus_med",
)
ROTATION_COLUMNS = ("item", "times_played_recent", "ltp_date", "current_gap", "avg_gap", "med_gap")


# First and last play of rows that are folded further.
SPANS = ("first_seq", "last_seq", "first_date", "last_date")


def last_sequence(bundle: Bundle, spec: GapSpec, as_of: date, tails: DataFrame | None = None) -> DataFrame:
    """The sequence number current gaps count from, one row per group. ``tails`` has ``tail_seq`` of plays that ``bundle`` lacks."""
    calendar = counted_occasions(bundle, spec)
    if spec.last_seq == "last_past":
        calendar = calendar.where(F.col("occ_date") < F.lit(as_of))
    elif spec.last_seq == "max_played":
        keys = [*spec.group, "occasion_id"]
        calendar = bundle.plays.select(*keys).join(calendar.select(*keys, "occ_seq"), keys)
        if tails is not None:
            calendar = calendar.select(*spec.group, "occ_seq").union(tails.select(*spec.group, "tail_seq"))
    top = F.max("occ_seq")
    if spec.last_seq == "max_minus_one":
        top = top - 1
    return calendar.groupBy(*spec.group).agg(top.alias("last_seq"))


def gap_rows(points: DataFrame, spec: GapSpec) -> DataFrame:
    """Points with their ``gap``, how many plays have it (``w``), and themselves as first and last play."""
    gap = F.col("occ_seq") - F.col("prev_seq")
    if spec.repeat_policy == "flag_after":
        first = F.struct(gap.alias("gap"), F.col("leads").cast("long").alias("w"))
        others = F.struct(F.lit(0).cast(points.schema["occ_seq"].dataType).alias("gap"),
                          (F.col("n_plays") - F.col("leads")).alias("w"))
        parts = F.when(F.col("n_plays") > F.col("leads"), F.array(first, others)).otherwise(F.array(first))
        rows = points.withColumn("__part", F.explode(parts)).select(
            "*", "__part.gap", "__part.w"
        ).where("w > 0").drop("__part")
    else:
        rows = points.withColumns({"gap": gap, "w": F.lit(1).cast("long")})
    spans = rows.withColumns({"last_seq": F.col("occ_seq"), "last_date": F.col("occ_date")})
    return spans.withColumnsRenamed({"occ_seq": "first_seq", "occ_date": "first_date"})


def item_stats(
    bundle: Bundle, spec: GapSpec, since: Column | None = None, closed: GapState | None = None
) -> DataFrame:
    """Play count, first and last sequence and date, and gap statistics per item.

    Gaps come from the whole history, also with ``since``. Mean, median and spread are rounded to 2 digits.
    The exact median is a histogram of gaps: an item over S occasions has at most about sqrt(2 S) distinct
    gaps, since they sum to no more than S. ``closed`` holds the plays up to its cut; only later ones are read from ``bundle``.
    """
    part = bundle if closed is None else between(bundle, closed.cut)
    points = play_points(part, spec, since, None if closed is None else closed.tails)
    named, stat_keys = _with_stat_keys(gap_rows(points, spec), bundle, spec, closed.histogram if closed is not None and since is None else None)
    g = F.col("gap").cast("double")
    n_gaps = F.sum(F.when(F.col("gap").isNotNull(), F.col("w")))
    raw = named.groupBy(*stat_keys).agg(
        F.sum("w").alias("n_plays"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_played_seq"),
        F.min_by("first_date", "first_seq").alias("debut_date"),
        F.max_by("last_date", "last_seq").alias("ltp_date"),
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
        n_gaps.alias("__n"),
        F.sum(g * F.col("w")).alias("__s1"),
        F.sum(g * g * F.col("w")).alias("__s2"),
        F.percentile("gap", 0.5, F.col("w")).alias("__med"),
    )
    return raw.select(
        *stat_keys, "n_plays", "first_seq", "last_played_seq", "debut_date", "ltp_date", "min_gap", "max_gap",
        round2(F.col("__s1") / F.col("__n")).alias("avg_gap"),
        round2(F.col("__med")).alias("med_gap"),
        round2(sample_std(F.col("__n"), F.col("__s1"), F.col("__s2"))).alias("std_gap"),
    )


def _with_stat_keys(rows: DataFrame, bundle: Bundle, spec: GapSpec, folded: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Rows with what statistics go by; ``folded`` are more rows, folded already, which are not shuffled to be folded again."""
    keys = [*spec.group, "item"]
    if not spec.by_item_name:
        if folded is not None:
            rows = rows.select(*folded.columns).unionByName(folded)
        return rows.withColumnRenamed("item_id", "item"), keys
    catalog = ["item_id", "item"]
    if spec.flag_source == "item":
        catalog.append("is_original")
    if spec.flag_source:
        keys.append("is_original")
    # Fold to a histogram of gaps per item before the catalog comes in: a bucket of 65,536 points has at most
    # some hundred distinct gaps, so the join and the final aggregate shuffle little.
    play_flag = ["is_original"] if spec.flag_source == "play" else []
    rows = rows.groupBy(*spec.group, "item_id", *play_flag, "gap").agg(
        F.sum("w").alias("w"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.min_by("first_date", "first_seq").alias("first_date"),
        F.max_by("last_date", "last_seq").alias("last_date"),
    )
    if folded is not None:
        rows = rows.unionByName(folded)
    group = [c for c in spec.group if c in bundle.items.columns]
    named = rows.join(bundle.items.select(*group, *catalog), [*group, "item_id"])
    # plays without a name or a flag belong to no item
    for key in keys:
        named = named.where(F.col(key).isNotNull())
    return named, keys


def _attach_current_gap(
    stats: DataFrame, bundle: Bundle, spec: GapSpec, as_of: date, closed: GapState | None
) -> DataFrame:
    last = last_sequence(bundle, spec, as_of, None if closed is None else closed.tails)
    if spec.group:
        stats = stats.join(last, list(spec.group))
        return stats.withColumn("current_gap", F.col("last_seq") - F.col("last_played_seq")).drop("last_seq")
    return stats.withColumn("current_gap", last.scalar() - F.col("last_played_seq"))


def _value(setting: int | Column) -> Column:
    return setting if isinstance(setting, Column) else F.lit(setting)


def overdue_scores(
    bundle: Bundle, spec: GapSpec, as_of: date | str, policies: DataFrame | None = None, closed: GapState | None = None
) -> DataFrame:
    """Overdue items with their z-score, unordered."""
    as_of = as_day(as_of)
    stats = _attach_current_gap(item_stats(bundle, spec, closed=closed), bundle, spec, as_of, closed)
    if policies is not None:
        stats = stats.join(policies, list(spec.group))
    kept = stats.where(F.col("n_plays") > _value(spec.min_plays))
    if spec.active_days is not None:
        active = F.col("ltp_date") > days_before(as_of, spec.active_days)
        if isinstance(spec.active_days, Column):
            active = spec.active_days.isNull() | active
        kept = kept.where(active)
    if spec.originals_only:
        kept = kept.where("is_original = 1")
    if spec.result_blacklist:
        kept = kept.where(~F.col("item").isin(*spec.result_blacklist))
    return kept.select(
        *spec.group, "item", F.col("n_plays").alias("times_played_total"), "ltp_date", "current_gap",
        "avg_gap", "med_gap",
        (F.col("current_gap") - F.col("avg_gap")).alias("current_minus_avg"),
        (F.col("current_gap") - F.col("med_gap")).alias("current_minus_med"),
        gap_zscore(F.col("current_gap"), F.col("avg_gap"), F.col("std_gap")).alias("gap_zscore"),
    )


def overdue(
    bundle: Bundle, spec: GapSpec, as_of: date | str, policies: DataFrame | None = None, closed: GapState | None = None
) -> DataFrame:
    """Items with many plays, the most overdue against their own history first."""
    scores = overdue_scores(bundle, spec, as_of, policies, closed)
    return _sorted(scores, spec, F.desc_nulls_last("gap_zscore")).drop("gap_zscore")


def rotation(
    bundle: Bundle, spec: GapSpec, as_of: date | str, policies: DataFrame | None = None, closed: GapState | None = None
) -> DataFrame:
    """Items played inside the window but not in the last few occasions, the most played first."""
    as_of = as_day(as_of)
    if policies is not None:
        bundle = replace(bundle, plays=bundle.plays.join(policies, list(spec.group)))
    since = days_before(as_of, spec.window_days)
    stats = _attach_current_gap(item_stats(bundle, spec, since, closed), bundle, spec, as_of, closed)
    if policies is not None:
        stats = stats.join(policies, list(spec.group))
    kept = stats.where(F.col("current_gap") > _value(spec.min_current_gap))
    if spec.originals_only:
        kept = kept.where("is_original = 1")
    if spec.result_blacklist:
        kept = kept.where(~F.col("item").isin(*spec.result_blacklist))
    shown = kept.select(
        *spec.group, "item", F.col("n_plays").alias("times_played_recent"),
        (format_day(F.col("ltp_date"), spec.rotation_date_format).alias("ltp_date")
         if spec.rotation_date_format else F.col("ltp_date")),
        "current_gap", "avg_gap", "med_gap",
    )
    return _sorted(shown, spec, F.desc("times_played_recent"))


def _sorted(ranking: DataFrame, spec: GapSpec, order: Column) -> DataFrame:
    """Order the few ranked rows.

    A global sort samples its input first. The exchange before it keeps that from running the statistics twice.
    It goes by a hash, as Spark drops one by the very columns that the statistics were dealt out by.
    """
    return ranking.repartition(F.xxhash64(*spec.group, "item")).orderBy(*spec.group, order, "item")


def rank_groups(
    bundle: Bundle, spec: GapSpec, policies: DataFrame, as_of: date | str
) -> tuple[DataFrame, DataFrame]:
    """Both rankings of all groups in one plan each.

    ``policies`` has the group columns and ``min_plays, active_days, window_days, min_current_gap``; it holds
    one row per registered group.
    """
    per_group = spec.with_options(
        min_plays=F.col("min_plays"), active_days=F.col("active_days"),
        window_days=F.col("window_days"), min_current_gap=F.col("min_current_gap"),
    )
    return overdue(bundle, per_group, as_of, policies), rotation(bundle, per_group, as_of, policies)


def run_all(
    entries: dict[str, tuple[GapSpec, Callable[[], Bundle]]], as_of: date | str,
    sink: Callable[[str, dict[str, DataFrame]], None],
) -> dict[str, str]:
    """Rank and store every source; a failing one does not stop the others. Returns name -> outcome."""
    outcome = {}
    for name, (spec, loader) in entries.items():
        try:
            bundle = loader()
            sink(name, {"overdue": overdue(bundle, spec, as_of), "rotation": rotation(bundle, spec, as_of)})
            outcome[name] = "ok"
        except Exception as error:  # noqa: BLE001 - every failure is reported, none is fatal
            outcome[name] = f"failed: {error}"
    return outcome
