"""Incremental batch updates of the play table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gapkit.operators.sets import keep_first
from gapkit.sources.tables import current_version, path_exists, store_version

# Keys on which two plays are the same. Fixed values.
PLAY_KEYS = ("occasion_id", "item_id", "set_label", "position", "position_in_set")


def high_water_mark(df: DataFrame, date_col: str = "occ_date") -> Column:
    """The latest stored day, as a scalar for filters."""
    return df.agg(F.max(date_col)).scalar()


def past_mark(
    existing: DataFrame, incoming: DataFrame, as_of: date | str, date_col: str = "occ_date"
) -> DataFrame:
    """Incoming rows after the latest stored day and before today, both exclusive.

    With nothing stored yet, all rows before today.
    """
    day = F.col(date_col)
    mark = high_water_mark(existing, date_col)
    return incoming.where((mark.isNull() | (day > mark)) & (day < F.lit(as_of).cast("date")))


def append_past_mark(
    existing: DataFrame, incoming: DataFrame, as_of: date | str, date_col: str = "occ_date"
) -> DataFrame:
    """Stored rows plus incoming ones past the mark. A late row for an old day is missed."""
    return existing.unionByName(past_mark(existing, incoming, as_of, date_col), allowMissingColumns=True)


def recent_years(
    df: DataFrame, as_of: date | str, date_col: str = "occ_date", key_year: Column | None = None
) -> DataFrame:
    """Rows of this year and the last, by a range of days that the files' statistics can be held against.

    ``key_year`` is a year told by the key; it decides where there is no day, so undated rows of these years come along.
    """
    year = date.fromisoformat(as_of).year if isinstance(as_of, str) else as_of.year
    day = F.col(date_col)
    recent = (day >= F.make_date(F.lit(year - 1), F.lit(1), F.lit(1))) & (day < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1)))
    if key_year is not None:
        recent = recent | (day.isNull() & key_year.isin(year - 1, year))
    return df.where(recent)


def new_rows(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Incoming rows with a key not stored yet, the first of each key.

    The increment is small beside the stored table. So the stored keys are first narrowed to those the
    increment also has; that side may be broadcast once Spark sees its size, and the stored table is read for
    its keys only and not shuffled.
    """
    keys = list(keys)
    fresh = keep_first(incoming, keys, order)
    known = existing.select(*keys).join(_renamed(incoming, keys), _same(keys), "left_semi")
    return fresh.join(_renamed(known, keys), _same(keys), "left_anti")


def new_rows_merged(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """As ``new_rows``, for an increment as large as the stored table: both are shuffled once, to one place for each key.

    The keys go as a struct, which is never null and equal where its fields are equal or both null, so a plain join finds the rows
    dealt out and sorted as the first of each key was picked.
    """
    keys, whole = list(keys), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    fresh = keep_first(incoming.withColumn("__key", whole), ["__key"], order)
    known = existing.select(whole.alias("__key"))
    return fresh.join(known, "__key", "left_anti").select(*incoming.columns)


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"__r_{k}") for k in keys])


def _same(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return condition


def upsert_keep_existing(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = PLAY_KEYS,
    order: Sequence[str] | None = None, dedupe_existing: bool = False,
) -> DataFrame:
    """Union that keeps one row per key, stored rows first.

    ``order`` settles which of several rows with one key comes first; by default all other columns do. The stored table is
    taken to hold each key once, as earlier runs left it, and is not shuffled; ``dedupe_existing`` makes sure of it at the
    price of a shuffle of all stored rows.
    """
    order = list(order) if order is not None else [c for c in existing.columns if c not in keys]
    if not dedupe_existing:
        return existing.unionByName(new_rows(existing, incoming, keys, order), allowMissingColumns=True)
    both = existing.withColumn("__age", F.lit(0)).unionByName(
        incoming.withColumn("__age", F.lit(1)), allowMissingColumns=True
    )
    return keep_first(both, keys, ["__age", *order]).drop("__age")


def append_unseen(
    existing: DataFrame, incoming: DataFrame, key: str = "occasion_id"
) -> DataFrame:
    """Stored rows plus all incoming rows of occasions not stored yet."""
    seen = existing.select(key).join(incoming.select(key).distinct(), key, "left_semi").distinct()
    return existing.unionByName(incoming.join(seen, key, "left_anti"), allowMissingColumns=True)


def _stored_at(spark: SparkSession, path: str) -> str | None:
    """The current version of a versioned table, a plain table, or nothing."""
    return current_version(spark, path) or (path if path_exists(spark, path) else None)


def load_method(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> str:
    """``update`` when the stored table is there and has the columns, else ``all``."""
    found = _stored_at(spark, path)
    if found is None:
        return "all"
    try:
        stored = spark.read.parquet(found).columns
    except AnalysisException:  # a folder without a table
        return "all"
    except Exception as error:  # files that are none; a fault of the store is no reason to rebuild, and is raised
        if "is not a Parquet file" not in str(error):
            raise
        return "all"
    return "update" if set(columns) <= set(stored) else "all"


def refresh(
    spark: SparkSession, path: str, load_all: Callable[[], DataFrame],
    update: Callable[[DataFrame], DataFrame], columns: Sequence[str] = (),
) -> DataFrame:
    """Updated table, or a full rebuild when there is nothing to build on. Store it with ``refresh_stored``."""
    if load_method(spark, path, columns) == "all":
        return load_all()
    return update(spark.read.parquet(_stored_at(spark, path)))


def refresh_stored(
    spark: SparkSession, path: str, load_all: Callable[[], DataFrame],
    update: Callable[[DataFrame], DataFrame], columns: Sequence[str] = (),
) -> DataFrame:
    """Refresh the table at ``path`` and store the result as its new version, which is read back."""
    return spark.read.parquet(store_version(refresh(spark, path, load_all, update, columns), path))


_YEAR = "year"


def store_by_year(df: DataFrame, path: str, date_col: str = "occ_date") -> None:
    """Store a table partitioned by the year of its day. Only the years that ``df`` holds are replaced, so ``df`` may have been
    read from these years of the table itself: new files are complete before old ones go."""
    df.withColumn(_YEAR, F.year(date_col)).repartition(_YEAR, F.pmod(F.hash(date_col), F.lit(16))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(_YEAR).parquet(path)


def upsert_years(
    spark: SparkSession, path: str, incoming: DataFrame, as_of: date | str, keys: Sequence[str] = PLAY_KEYS,
    order: Sequence[str] | None = None, date_col: str = "occ_date",
) -> DataFrame:
    """Upsert this year's and the last one's rows of ``incoming`` into a table stored by year, and read it back.

    Two partitions are read and two written, whatever the table holds beside them. Rows of one key lie in one year, as a key has
    one day. Run again, it gives the same table.
    """
    year = as_of.year if isinstance(as_of, date) else date.fromisoformat(as_of).year
    schema = StructType([*incoming.schema.fields, StructField(_YEAR, IntegerType())])  # ``add`` would change the frame's own
    stored = spark.read.schema(schema).parquet(path)
    recent = stored.where(F.col(_YEAR).isin(year - 1, year)).drop(_YEAR)
    merged = upsert_keep_existing(recent, recent_years(incoming, as_of, date_col), keys, order)
    store_by_year(merged.select(*incoming.columns), path, date_col)
    return spark.read.schema(schema).parquet(path).drop(_YEAR)


def store_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Store a table hashed into buckets by its keys, under a name of the catalog. Its files are those of a later session as well, see
    ``attach_bucketed``."""
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)


def attach_bucketed(spark: SparkSession, name: str, path: str, schema, keys: Sequence[str], buckets: int = 64) -> None:
    """Name a bucketed table that another session has stored."""
    columns, by = (", ".join(x) for x in ([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields], [f"`{k}`" for k in keys]))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")


def new_rows_bucketed(spark: SparkSession, name: str, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Incoming rows with a key the bucketed table lacks, the first of each key. Only the increment is shuffled, to the table's
    buckets. Keys are not null; a row of the increment without one is an error when it is met."""
    keys = list(keys)
    sure = incoming
    for key in keys:
        sure = sure.withColumn(key, F.coalesce(key, F.raise_error(f"a row without {key}").cast(incoming.schema[key].dataType)))
    return keep_first(sure, keys, order).join(spark.table(name).select(*keys), keys, "left_anti").select(*incoming.columns)


def upsert_bucketed(
    spark: SparkSession, name: str, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int = 64
) -> DataFrame:
    """Append the rows with new keys to the bucketed table, and give the table."""
    new = new_rows_bucketed(spark, name, incoming, keys, order).select(*spark.table(name).columns)
    new.repartition(buckets, *keys).write.format("parquet").mode("append").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)
