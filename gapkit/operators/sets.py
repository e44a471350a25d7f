"""Set operations and row selection by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def union_all(*tables: DataFrame) -> DataFrame:
    """Union by name; columns a table lacks are null."""
    result = tables[0]
    for other in tables[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def dimension(df: DataFrame, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """Distinct values of some columns, ordered by the key."""
    distinct = df.select(*columns).distinct()
    return distinct.orderBy(key, *[c for c in columns if c != key]) if key else distinct


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key.

    The rank filter is pushed below the shuffle, so each map task sends one row per key at most.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def drop_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the plays whose ordinal within (occasion, item) is 0."""
    return keep_first(df, keys, order)


def not_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the other table lacks."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def missing_plays(occasions: DataFrame, plays: DataFrame, key: str = "occasion_id") -> DataFrame:
    """Occasions for which no play was obtained."""
    return not_in(occasions, plays, [key])


def top_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows; planned as a per-task top n and a merge."""
    return df.orderBy(*order).limit(n)
