"""Plays joined with their occasions, and the gap to the previous play of the item.

Statistics never need row-level gaps. Plays are first folded to *points*, one per (item, sequence number):
only the first play of an item at an occasion can have a gap other than zero, so a point with counts says
all. Folding combines copies map-side, and bounds what a window over an item can hold.
"""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from gapkit.functions import py_title
from gapkit.operators import ordered
from gapkit.operators.ordered import BUCKET, bucket_ends, lag_value
from gapkit.spec import SEQ_BUCKET, Bundle, GapSpec

NO_POSITION = 2**31 - 1
# Sequence numbers in one window of an item. The edge table has a row for each item and bucket that its plays touch: with narrow
# buckets, nearly as many rows as there are plays. A window of this many points is one sort, which spills.
POINT_BUCKET = 1 << 20
seq_bucket = partial(ordered.seq_bucket, width=POINT_BUCKET)


def counted_occasions(bundle: Bundle, spec: GapSpec) -> DataFrame:
    """Occasions that count; the exclusion flag keeps rows where it is null."""
    occasions = bundle.occasions
    if spec.exclude_flagged and "exclude_from_stats" in occasions.columns:
        occasions = occasions.where(~F.col("exclude_from_stats").eqNullSafe(1))
    return occasions


def clean_plays(bundle: Bundle, spec: GapSpec) -> DataFrame:
    """Plays with a key, title-cased where asked, without blacklisted items."""
    plays = bundle.plays
    # plain null checks: they reach the scan, and Spark knows the keys as non-null from here on
    for key in (*spec.group, "item_id"):
        plays = plays.where(F.col(key).isNotNull())
    if spec.title_case:
        plays = plays.withColumn("item_id", py_title(F.col("item_id")))
    if spec.history_blacklist:
        plays = plays.where(~F.col("item_id").isin(*spec.history_blacklist))
    return plays


def dated_plays(bundle: Bundle, spec: GapSpec, how: str = "left") -> DataFrame:
    """Plays with ``occ_seq`` and ``occ_date`` of their occasion."""
    spec.check(bundle)
    keys = [*spec.group, "occasion_id"]
    calendar = counted_occasions(bundle, spec).select(*keys, "occ_seq", "occ_date")
    return clean_plays(bundle, spec).join(calendar, keys, how)


def _fits_one_window(spec: GapSpec) -> bool:
    return spec.seq_span is not None and spec.seq_span <= SEQ_BUCKET


def _point_bucket(spec: GapSpec) -> Column | None:
    return None if _fits_one_window(spec) else seq_bucket("occ_seq")


def between(bundle: Bundle, after: int, upto: int | None = None) -> Bundle:
    """The bundle with the occasions after a sequence number, and up to another one; points know no plays of others."""
    seq = F.col("occ_seq")
    return replace(bundle, occasions=bundle.occasions.where((seq > after) & (seq <= upto) if upto is not None else seq > after))


def _point_rows(bundle: Bundle, spec: GapSpec, since: Column | None = None) -> tuple[DataFrame, bool]:
    """What points are made of, and whether it is dealt out by item and bucket.

    Where few plays share a point there is nothing to combine, and one exchange of the plays by item and bucket serves the aggregate,
    the window and its edges, and the last points. Where old history folds, or a day's plays do, the aggregate combines first.
    """
    plays = dated_plays(bundle, spec, how="inner").where(F.col("occ_seq").isNotNull())
    keys = [*spec.group, "item_id"]
    recent = F.lit(True) if since is None else F.coalesce(F.col("occ_date") > since, F.lit(False))
    fold_old = since is not None and spec.seq_follows_date

    flags = ["is_original"] if spec.flag_source == "play" else []
    if spec.repeat_policy == "flag_after":
        main = F.col("is_repeat").eqNullSafe(0)
        position = F.coalesce(F.col("position"), F.lit(NO_POSITION)).cast("long")
        # position first, then main plays before repeats, in one sortable number
        rank = position * 2 + F.when(main, 0).otherwise(1)
    else:
        main, rank = F.lit(True), F.lit(0).cast("long")

    narrow = plays.select(
        *keys, "occ_seq", "occ_date", (main & recent).alias("__counts"), rank.alias("__rank"),
        *[F.when(recent, F.col(f)).alias(f) if fold_old else F.col(f) for f in flags],
        (F.when(recent, F.col("occ_seq")) if fold_old else F.col("occ_seq")).alias("__point"),
    )
    bucket = _point_bucket(spec)
    if bucket is None or fold_old:
        return narrow, False
    # a point is a sequence number itself here: under that name the window finds the rows sorted
    narrow = narrow.drop("occ_seq").withColumnRenamed("__point", "occ_seq").withColumn(BUCKET, bucket)
    return narrow.repartition(*keys, BUCKET), True


def last_points(bundle: Bundle, spec: GapSpec) -> DataFrame:
    """``tail_seq``: the sequence number of each item's last point. Where points are dealt out, from the same exchange."""
    keys = [*spec.group, "item_id"]
    rows, dealt = _point_rows(bundle, spec)
    if dealt:
        rows = bucket_ends(rows, keys, F.max("occ_seq").alias("occ_seq"))
    return rows.groupBy(*keys).agg(F.max("occ_seq").alias("tail_seq"))


def play_points(
    bundle: Bundle, spec: GapSpec, since: Column | None = None, tails: DataFrame | None = None
) -> DataFrame:
    """One row per (item, sequence number), with ``prev_seq`` of the item's previous point.

    An item's first point has no previous one, unless ``tails`` names one before all of these (``tail_seq``).

    ``n_plays``        plays that count, repeats left out
    ``leads``          1 when the first play at this point is no repeat, so that the gap belongs to it

    With ``since`` all earlier plays of an item fold into one point without plays. Its only use is the gap of
    the first later point, so just one row per item and map task of the old history is shuffled.
    """
    keys = [*spec.group, "item_id"]
    flags = ["is_original"] if spec.flag_source == "play" else []
    narrow, dealt = _point_rows(bundle, spec, since)
    if spec.repeat_policy == "flag_after":
        plays_at_point = F.count_if("__counts")
    else:
        plays_at_point = F.max(F.col("__counts").cast("long"))
    point = "occ_seq" if dealt else "__point"
    # dealt rows are sorted and aggregated in a stream (see ``session.prepare``): a task holds one sort, which spills, and no hash tables
    found = narrow.sortWithinPartitions(*keys, BUCKET, point, *flags, F.desc_nulls_last("occ_date")) if dealt else narrow
    points = found.groupBy(*keys, *([BUCKET] if dealt else []), point, *flags).agg(
        *([] if dealt else [F.max("occ_seq").alias("occ_seq")]),
        # the latest day; Spark drops a sort below aggregates that do not depend on it
        (F.first("occ_date", ignorenulls=True) if dealt else F.max("occ_date")).alias("occ_date"),
        plays_at_point.alias("n_plays"),
        F.min("__rank").alias("__rank"),
    ).withColumn("leads", (F.col("__rank") % 2 == 0).cast("int")).drop("__point")
    order = ["occ_seq", "__rank"] if spec.repeat_policy == "flag_after" else ["occ_seq"]
    lagged = lag_value(points, keys, [*order, *flags], "occ_seq", "prev_seq", _point_bucket(spec), share=not dealt, dealt=dealt,
                       rows=narrow if dealt else None)
    counted = lagged.where("n_plays > 0").drop("__rank", BUCKET)
    if tails is None:
        return counted
    known = counted.join(tails.select(*keys, "tail_seq"), keys, "left")
    return known.withColumn("prev_seq", F.coalesce("prev_seq", "tail_seq")).drop("tail_seq")


def play_history(bundle: Bundle, spec: GapSpec) -> DataFrame:
    """Every play with its gap; a play without an occasion has a null sequence and gap.

    ``flag_after``     repeats stay in; only the first play of an item at an occasion has a gap above 0
    ``dedupe_before``  only the first play of an item at an occasion is kept
    """
    keys = [*spec.group, "item_id"]
    plays = dated_plays(bundle, spec)
    if not _fits_one_window(spec):
        return _history_in_one_pass(plays, keys, spec)
    if spec.repeat_policy == "dedupe_before":
        plays = first_play(plays, spec)
        bucket = None if _fits_one_window(spec) else F.coalesce(seq_bucket("occ_seq"), F.lit(-1))
        seated = plays.where(F.col("occ_seq").isNotNull())
        lagged = lag_value(seated, keys, ["occ_seq"], "occ_seq", "prev_seq", bucket, share=True)
        unseated = plays.where(F.col("occ_seq").isNull()).withColumn("prev_seq", F.lit(None).cast("int"))
        history = lagged.unionByName(unseated)
        return history.withColumn("gap", F.col("occ_seq") - F.col("prev_seq")).drop("prev_seq")

    tie = _tie_break(plays, spec)
    points = plays.where(F.col("occ_seq").isNotNull()).groupBy(*keys, "occ_seq").agg(F.min(tie).alias("__lead"))
    points = lag_value(points, keys, ["occ_seq"], "occ_seq", "prev_seq", _point_bucket(spec), share=True)
    joined = plays.join(points, [*keys, "occ_seq"], "left")
    first = F.col("__lead").eqNullSafe(tie)
    gap = F.when(first, F.col("occ_seq") - F.col("prev_seq")).when(
        F.col("occ_seq").isNotNull(), F.lit(0)
    )
    return joined.withColumn("gap", gap).drop("prev_seq", "__lead")


_UNSEATED = 1024  # buckets of an item's plays without an occasion


def _history_in_one_pass(plays: DataFrame, keys: list[str], spec: GapSpec) -> DataFrame:
    """One bucketed window over the plays themselves, in the order of sequence number, position and tie-break.

    A play whose predecessor has another sequence number is the first of its occasion; its gap is the difference. For
    sequence numbers of occasions, which few plays of an item share; where a day's plays share one, they fold first.
    """
    seq = F.col("occ_seq")
    orphan = F.when(seq.isNull(), F.col("occasion_id"))
    fixed, rest = _tie_parts(plays, spec)
    named = {f"__{i}": c for i, c in enumerate(fixed)}
    bucket = F.when(seq.isNull(), -1 - F.pmod(F.hash("occasion_id"), F.lit(_UNSEATED))).otherwise(seq_bucket("occ_seq"))
    # plays are dealt out as they are; what orders them is made of their columns where they lie
    dealt = plays.withColumn(BUCKET, bucket).repartition(*keys, BUCKET)
    placed = dealt.withColumns({"__at": F.struct(seq.alias("seq"), orphan.alias("orphan")), **named})
    lagged = lag_value(placed, keys, ["__at", *named, *rest], "__at", "__before", dealt=True)
    later = F.col("__before").isNotNull() & F.col("__before").eqNullSafe(F.col("__at"))
    if spec.repeat_policy == "dedupe_before":
        lagged = lagged.where(~later)
    return lagged.withColumn("gap", seq - F.col("__before.seq")).select(*plays.columns, "gap")


def _tie_break(plays: DataFrame, spec: GapSpec) -> Column:
    """Order of the plays of one item at one occasion: position, main plays first, then all columns."""
    fixed, rest = _tie_parts(plays, spec)
    return F.struct(*fixed, *rest)


def _tie_parts(plays: DataFrame, spec: GapSpec) -> tuple[list[Column], list[str]]:
    fixed = [F.coalesce(F.col("position"), F.lit(NO_POSITION)).alias("p")] if "position" in plays.columns else []
    if "is_repeat" in plays.columns:
        fixed.append(F.when(F.col("is_repeat").eqNullSafe(0), 0).otherwise(1).alias("r"))
    used = {*spec.group, "item_id", "occ_seq", "occ_date", "position", "is_repeat"}
    return fixed, [c for c in plays.columns if c not in used]


def first_play(plays: DataFrame, spec: GapSpec) -> DataFrame:
    """The first play of each item at each sequence number, as an aggregate with map-side combine."""
    keys = [*spec.group, "item_id", "occ_seq"]
    rest = [c for c in plays.columns if c not in keys]
    # plays without an occasion are told apart by their occasion key
    apart = [F.when(F.col("occ_seq").isNull(), F.col("occasion_id")).alias("__orphan")]
    picked = plays.select(
        *keys, *apart, F.struct(_tie_break(plays, spec).alias("t"), F.struct(*rest).alias("v")).alias("__s")
    ).groupBy(*keys, "__orphan").agg(F.min("__s").alias("__s"))
    return picked.select(*keys, *[F.col("__s.v")[c].alias(c) for c in rest]).select(*plays.columns)
