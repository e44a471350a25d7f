"""Ordered window functions whose groups stay bounded.

A window needs all rows of a partition in one task. Here the partition key is ``keys + bucket``, where
the bucket is a non-decreasing function of the leading order column (a sequence number divided by a width,
a day, a year). Each bucket then holds a bounded slice, however hot its key is. What crosses a bucket edge
is carried by an *edge table* with one row per ``(keys, bucket)``, built with map-side aggregation, and
joined back. Results equal those of one window over ``keys``.

With ``share=True`` the rows are first distributed by ``keys + bucket``, which the window needs anyway, and the
edge table reads that same exchange; so whatever lies below it (joins, aggregates, parsing) runs once. For this the
edge table must read every column. Spark reuses the exchange when the keys are filtered to be non-null beforehand;
otherwise the join adds that filter to one branch only. Leave it off over plain scans, where reading a few columns
twice is cheaper.

With ``dealt=True`` the caller has done so already: the frame has the bucket in the column ``BUCKET`` and is distributed by
``keys + BUCKET``, say by an aggregate over these and more columns. Where that aggregate leaves out no value, ``rows`` are what it
read: the edge table then takes its values from there, and the aggregate is made once.

Without keys the edge table itself grows with the data, one row a bucket. It is then scanned as a *tree of partial results*: what
is carried over an edge is associative (a sum, the last value, the last one that is not null), so blocks of ``FAN`` edges are
summed up to one row each, these are scanned, and each block takes its start from them. One task sees one row for each
``FAN`` buckets: a 268-millionth of the rows with the usual width.

Where the leading order column is no integer sequence, number the rows first with
:func:`gapkit.operators.sequence.global_sequence` by ``keys + order`` and use that number as order and bucket.

Rules for callers: keys are not null, and the order columns are ascending and end in a unique key. Pass
``bucket=None`` only where the group is known to be small.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType, IntegralType

from gapkit.spec import SEQ_BUCKET

BUCKET = _B = "__bucket"
_EDGE = "__edge"
_FIRST = "__first"
_KEY = "__key"


def seq_bucket(seq: str, width: int = SEQ_BUCKET) -> Column:
    """Bucket of an integer order column."""
    return F.floor(F.col(seq) / F.lit(width))


def _order_value(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _tag(df: DataFrame, keys: Sequence[str], bucket: Column, share: bool) -> DataFrame:
    tagged = df.withColumn(_B, bucket)
    return tagged.repartition(*keys, _B) if share else tagged


def _edges(tagged: DataFrame, keys: Sequence[str], share: bool, *aggs: Column) -> DataFrame:
    if not share:
        return tagged.groupBy(*keys, _B).agg(*aggs)
    touched = F.max(F.hash(*[c for c in tagged.columns if c != _B]))
    return tagged.groupBy(*keys, _B).agg(*aggs, touched.alias("__touch")).where("__touch IS NOT NULL").drop("__touch")


def bucket_ends(dealt: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates of each key and bucket of a frame that is dealt out by these, from the exchange that its other readers have."""
    return _edges(dealt, keys, True, *aggs)


FAN = 4096
_BLOCK = "__block"


def _scan(edges: DataFrame, keys: Sequence[str], **wanted: tuple[str, str]) -> DataFrame:
    """Add to each edge what its key carries there; ``wanted`` names the new columns as pairs of a kind and a column.

    ``sum``    the column's sum over earlier buckets, null without one
    ``before`` and ``after``    the column of the previous or next bucket as the only field of a struct, null without one
    ``last``   the column's last value in earlier buckets that is not null
    """
    if not _is_tree(edges, keys):
        return _scan_level(edges, list(keys) or [F.lit(0)], wanted)
    blocks = edges.withColumn(_BLOCK, F.floor(F.col(_B) / F.lit(FAN)))
    inner = _scan_level(blocks, [_BLOCK], wanted)
    place = F.col(_B)
    whole = {
        "sum": lambda c: F.sum(c), "before": lambda c: F.max_by(F.struct(F.col(c).alias("v")), place),
        "after": lambda c: F.min_by(F.struct(F.col(c).alias("v")), place),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)),
    }
    roots = blocks.groupBy(_BLOCK).agg(*[whole[kind](c).alias(f"__of_{name}") for name, (kind, c) in wanted.items()])
    # a block's struct is a value here, so it comes back inside another one
    roots = _scan_level(roots.withColumnRenamed(_BLOCK, _B), [F.lit(0)], {f"__up_{n}": (kind, f"__of_{n}") for n, (kind, _) in wanted.items()})
    # a left join: an inner one would filter one of the readers of the edges' exchange, which then could not share it
    joined = inner.join(roots.withColumnRenamed(_B, _BLOCK).select(_BLOCK, *[f"__up_{n}" for n in wanted]), _BLOCK, "left")

    def both(name: str, kind: str) -> Column:
        own, up = F.col(name), F.col(f"__up_{name}")
        if kind == "sum":
            return F.when(own.isNotNull() | up.isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(up, F.lit(0)))
        return F.coalesce(own, up["v"] if kind in ("before", "after") else up)

    return joined.withColumns({name: both(name, kind) for name, (kind, _) in wanted.items()}).select(*edges.columns, *wanted)


def _is_tree(edges: DataFrame, keys: Sequence[str]) -> bool:
    return not keys and isinstance(edges.schema[_B].dataType, (IntegralType, DecimalType))


def _scan_level(edges: DataFrame, keys: Sequence[str | Column], wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(_B)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    kinds = {
        "sum": lambda c: F.sum(c).over(earlier), "before": lambda c: F.lag(F.struct(F.col(c).alias("v"))).over(w),
        "after": lambda c: F.lead(F.struct(F.col(c).alias("v"))).over(w),
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
    }
    return edges.withColumns({name: kinds[kind](c) for name, (kind, c) in wanted.items()})


def _neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
    bucket: Column | None, default, ahead: bool, share: bool, dealt: bool = False, rows: DataFrame | None = None,
) -> DataFrame:
    shift = F.lead if ahead else F.lag
    fill = None if default is None else F.lit(default)
    if bucket is None and not dealt:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, shift(value, 1, default).over(w))

    if value == order[0]:
        edge_value = (F.min if ahead else F.max)(value)
    else:
        edge_value = (F.min_by if ahead else F.max_by)(value, _order_value(order))
    tagged = df if dealt else _tag(df, keys, bucket, share)
    w = Window.partitionBy(*keys, _B).orderBy(*order)
    at_edge = (F.lead(F.lit(1)) if ahead else F.lag(F.lit(1))).over(w).isNull()
    inner = tagged.withColumns({out: shift(value).over(w), _FIRST: at_edge})
    edges = _edges(tagged if rows is None else rows, keys, share or dealt, edge_value.alias(_EDGE))
    carried = _scan(edges, keys, __next=("after" if ahead else "before", _EDGE)).where("__next is not null").select(
        *keys, _B, F.col("__next.v").alias(_EDGE), F.lit(True).alias("__hit"))
    joined = inner.join(carried, [*keys, _B], "left")
    outside = F.when(F.col("__hit"), F.col(_EDGE))
    if fill is not None:
        outside = F.when(F.col("__hit"), F.col(_EDGE)).otherwise(fill)
    result = F.when(F.col(_FIRST), outside).otherwise(F.col(out))
    return joined.withColumn(out, result).select(*df.columns, out)


def lag_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
    bucket: Column | None = None, default=None, share: bool = False, dealt: bool = False, rows: DataFrame | None = None,
) -> DataFrame:
    """Value of the previous row of the key."""
    return _neighbour(df, keys, order, value, out, bucket, default, ahead=False, share=share, dealt=dealt, rows=rows)


def lead_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
    bucket: Column | None = None, default=None, share: bool = False,
) -> DataFrame:
    """Value of the next row of the key."""
    return _neighbour(df, keys, order, value, out, bucket, default, ahead=True, share=share)


def neighbour_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, before: str, after: str,
    bucket: Column, default=None, share: bool = False,
) -> DataFrame:
    """Values of the previous and the next row of the key, from one window and one edge table."""
    tagged = _tag(df, keys, bucket, share)
    w, rank, one = Window.partitionBy(*keys, _B).orderBy(*order), _order_value(order), F.lit(1)
    inner = tagged.withColumns({
        before: F.lag(value).over(w), after: F.lead(value).over(w),
        "__starts": F.lag(one).over(w).isNull(), "__ends": F.lead(one).over(w).isNull(),
    })
    edges = _edges(tagged, keys, share, F.min_by(value, rank).alias("__head"), F.max_by(value, rank).alias("__tail"))
    joints = _scan(edges, keys, __in=("before", "__tail"), __out=("after", "__head")).select(
        *keys, _B, F.col("__in.v").alias("__in"), F.col("__in").isNotNull().alias("__has_in"),
        F.col("__out.v").alias("__out"), F.col("__out").isNotNull().alias("__has_out"))
    joined = inner.join(joints, [*keys, _B], "left")
    outside = {side: F.when(F.col(f"__has_{side}"), F.col(f"__{side}")).otherwise(F.lit(default)) for side in ("in", "out")}
    return joined.withColumns({
        before: F.when(F.col("__starts"), outside["in"]).otherwise(F.col(before)),
        after: F.when(F.col("__ends"), outside["out"]).otherwise(F.col(after)),
    }).select(*df.columns, before, after)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
    bucket: Column, share: bool = False,
) -> DataFrame:
    """Sum of ``value`` from the first row of the key to this one."""
    tagged = _tag(df, keys, bucket, share)
    upto = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inner = tagged.withColumn(out, F.sum(value).over(upto))
    edges = _edges(tagged, keys, share, F.sum(value).alias(_EDGE))
    offsets = _scan(edges, keys, __sum=("sum", _EDGE)).where("__sum <> 0").select(*keys, _B, F.col("__sum").alias(_EDGE))
    joined = inner.join(offsets, [*keys, _B], "left")
    return joined.withColumn(out, F.col(out) + F.coalesce(F.col(_EDGE), F.lit(0))).select(*df.columns, out)


def running_sums(
    df: DataFrame, keys: Sequence[str], part: str, order: Sequence[str], value: str, out: str, part_out: str, bucket: Column,
) -> DataFrame:
    """Sum of ``value`` from the first row of the key to this one, and the same over the rows with this row's ``part`` only.

    Both windows and their edge table read one exchange by key and bucket. The edge table has one row per (key, part, bucket);
    only later buckets of a key get something from it, as one row per bucket with a map over the parts met so far, so the rows
    are joined where they lie. Null keys are a key like others: the keys go as a struct, which is never null, so that no filter
    on them comes between the readers of the exchange. ``part`` is not null, and its values within a key fit in one row.
    """
    tagged = _tag(df.withColumn(_KEY, F.struct(*keys)), [_KEY], bucket, share=True)
    upto = (Window.unboundedPreceding, Window.currentRow)
    inner = tagged.withColumns({
        out: F.sum(value).over(Window.partitionBy(_KEY, _B).orderBy(*order).rowsBetween(*upto)),
        part_out: F.sum(value).over(Window.partitionBy(_KEY, part, _B).orderBy(*order).rowsBetween(*upto)),
    })
    edges = _edges(tagged, [_KEY, part], True, F.sum(value).alias(_EDGE))
    by_part = Window.partitionBy(_KEY, part).orderBy(_B)
    summed = edges.withColumns({
        "__before": F.sum(_EDGE).over(Window.partitionBy(_KEY).orderBy(_B).rangeBetween(Window.unboundedPreceding, -1)),
        "__part_before": F.sum(_EDGE).over(by_part.rowsBetween(Window.unboundedPreceding, -1)),
    }).where("__before <> 0 OR __part_before <> 0")
    offsets = summed.groupBy(_KEY, _B).agg(
        F.max("__before").alias("__before"),
        F.map_from_entries(F.collect_list(F.struct(F.col(part), F.coalesce("__part_before", F.lit(0))))).alias("__parts"))
    joined = inner.join(offsets, [_KEY, _B], "left")
    return joined.withColumns({
        out: F.col(out) + F.coalesce("__before", F.lit(0)),
        part_out: F.col(part_out) + F.coalesce(F.try_element_at("__parts", F.col(part)), F.lit(0)),
    }).select(*df.columns, out, part_out)


def row_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, bucket: Column, share: bool = False
) -> DataFrame:
    """1-based position of the row within the key. Shared rows go by a struct of the keys, as in :func:`running_sums`."""
    columns = df.columns
    if share and keys:
        df, keys = df.withColumn(_KEY, F.struct(*keys)), [_KEY]
    tagged = _tag(df, keys, bucket, share)
    inner = tagged.withColumn(
        out, F.row_number().over(Window.partitionBy(*keys, _B).orderBy(*order)).cast("long")
    )
    edges = _edges(tagged, keys, share, F.count(F.lit(1)).alias(_EDGE))
    offsets = _scan(edges, keys, __sum=("sum", _EDGE)).where("__sum > 0").select(*keys, _B, F.col("__sum").alias(_EDGE))
    joined = inner.join(offsets, [*keys, _B], "left")
    return joined.withColumn(out, F.col(out) + F.coalesce(F.col(_EDGE), F.lit(0))).select(*columns, out)


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, bucket: Column,
    share: bool = False,
) -> DataFrame:
    """Latest non-null ``value`` at or before this row."""
    tagged = _tag(df, keys, bucket, share)
    upto = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inner = tagged.withColumn(out, F.last(value, ignorenulls=True).over(upto))
    filled = F.when(F.col(value).isNotNull(), _order_value(order))
    edges = _edges(tagged, keys, share, F.max_by(value, filled).alias(_EDGE))
    carried = _scan(edges, keys, __last=("last", _EDGE)).where("__last is not null").select(
        *keys, _B, F.col("__last").alias(_EDGE))
    joined = inner.join(carried, [*keys, _B], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.col(_EDGE))).select(*df.columns, out)


def running_breaks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], here: Column, breaks: Callable[[Column, Column], Column],
    out: str, bucket: Column, blocks: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Running sum, from 1, of ``breaks(before, now)``: 1 where a row does not go on with the one before it, else 0.

    One window in each bucket gives the breaks inside it. The edge table has each bucket's first and last value of ``here``
    and its breaks, from the same exchange; the break between two buckets is told from the last and first of these.

    ``blocks`` names columns for 1-based positions among the rows that follow each other with equal values, null or not, of some
    columns; the first order column then counts the rows of a key without gaps. They come from the same window and edges.
    """
    # rows without a place in the order are left out here, for both readers of the exchange
    tagged = _tag(df.where(bucket.isNotNull()).withColumn("__here", here), keys, bucket, share=True)
    w = Window.partitionBy(*keys, _B).orderBy(*order)
    upto, seq, starts = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), F.col(order[0]), F.lag(F.lit(1)).over(w).isNull()
    blocks = {name: F.struct(*columns) for name, columns in (blocks or {}).items()}
    before = F.lag("__here").over(w)
    # where a block begins inside a bucket; whether one does at its first row shows at the edges
    begins = {f"__at_{name}": F.when(~starts & ~F.lag(block).over(w).eqNullSafe(block), seq) for name, block in blocks.items()}
    stepped = tagged.withColumns({"__step": F.when(starts, 0).otherwise(breaks(before, F.col("__here"))), **begins})
    inner = stepped.withColumns({out: F.sum("__step").over(upto), **{
        name: F.last(f"__at_{name}", ignorenulls=True).over(upto) for name in blocks}})
    rank = _order_value(order)
    ends = [how.alias(f"__{part}_{name}") for name, block in blocks.items() for part, how in (
        ("head", F.min_by(block, rank)), ("tail", F.max_by(block, rank)), ("last", F.max(f"__at_{name}")))]
    edges = _edges(stepped, keys, True, F.min_by("__here", rank).alias("__head"), F.max_by("__here", rank).alias("__tail"),
                   F.sum("__step").alias("__inside"), *([F.min(seq).alias("__from")] if blocks else []), *ends)
    offsets = _break_offsets(edges, keys, breaks, list(blocks))
    joined = inner.join(offsets, [*keys, _B])
    places = {name: (seq - F.coalesce(name, f"__start_{name}") + 1).cast("long") for name in blocks}
    return joined.withColumns({out: F.col(out) + F.col(_EDGE), **places}).select(*df.columns, *blocks, out)


def _break_offsets(
    edges: DataFrame, keys: Sequence[str], breaks: Callable[[Column, Column], Column], blocks: Sequence[str] = ()
) -> DataFrame:
    """The breaks up to the first row of each bucket, from ``__head, __tail, __inside`` of the buckets. The first row of a key
    starts run 1. Of each name in ``blocks`` also where the block of that first row begins, as ``__start_<name>``, from ``__from`` and
    the block's ``__head, __tail, __last``."""

    def scanned(rows: DataFrame, groups: Sequence[str | Column], top: bool) -> DataFrame:
        w = Window.partitionBy(*groups).orderBy(_B)
        earlier, leads = w.rowsBetween(Window.unboundedPreceding, -1), F.lag(F.lit(1)).over(w).isNull()
        entered = F.when(leads, F.lit(1 if top else 0)).otherwise(breaks(F.lag("__tail").over(w), F.col("__head"))).cast("long")
        own = {}
        for name in blocks:
            begins = F.when(leads, F.lit(top)).otherwise(~F.lag(f"__tail_{name}").over(w).eqNullSafe(F.col(f"__head_{name}")))
            own[f"__own_{name}"] = F.when(begins, F.col("__from"))
        found = rows.withColumns({"__entered": entered, **own}).withColumns(
            {f"__last_{name}": F.coalesce(f"__last_{name}", f"__own_{name}") for name in blocks})
        return found.withColumns({
            _EDGE: F.coalesce(F.sum(F.col("__entered") + F.col("__inside")).over(earlier), F.lit(0)) + F.col("__entered"),
            **{f"__start_{name}": F.coalesce(f"__own_{name}", F.last(f"__last_{name}", ignorenulls=True).over(earlier)) for name in blocks}})

    starts = [f"__start_{name}" for name in blocks]
    if not _is_tree(edges, keys):
        return scanned(edges, list(keys) or [F.lit(0)], True).select(*keys, _B, _EDGE, *starts)
    # whether a block's first bucket is entered by a break shows one level up
    inner = scanned(edges.withColumn(_BLOCK, F.floor(F.col(_B) / F.lit(FAN))), [_BLOCK], False)
    ends = [how.alias(f"__{part}_{name}") for name in blocks for part, how in (
        ("head", F.min_by(f"__head_{name}", _B)), ("tail", F.max_by(f"__tail_{name}", _B)), ("last", F.max(f"__last_{name}")))]
    roots = inner.groupBy(_BLOCK).agg(F.min_by("__head", _B).alias("__head"), F.max_by("__tail", _B).alias("__tail"),
                                      F.sum(F.col("__entered") + F.col("__inside")).alias("__inside"),
                                      *([F.min("__from").alias("__from")] if blocks else []), *ends)
    above = scanned(roots.withColumnRenamed(_BLOCK, _B), [F.lit(0)], True).select(
        F.col(_B).alias(_BLOCK), F.col(_EDGE).alias("__above"), *[F.col(c).alias(f"{c}_above") for c in starts])
    return inner.join(above, _BLOCK, "left").select(
        _B, (F.col(_EDGE) + F.col("__above")).alias(_EDGE), *[F.coalesce(c, f"{c}_above").alias(c) for c in starts])


def whole_group(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Attach group aggregates to every row: aggregate with map-side combine, then join back.

    A hot group is never gathered in one task; AQE splits its side of the join.
    """
    stats = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return df.join(stats, list(keys), "left")
