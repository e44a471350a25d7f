"""Collects queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType

from gapkit.session import ensure_checkpoint_dir, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Tables as common table expressions of the SQL side.
PLAYS = """plays AS (
  SELECT l_orderkey AS occasion_id, l_partkey AS item_id, l_linenumber AS position,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_repeat
  FROM lineitem)"""
NAMED_PLAYS = """plays AS (
  SELECT l_orderkey AS occasion_id, p_name AS item_id, l_linenumber AS position,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_repeat
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
DATED = """occ AS (
  SELECT o_orderkey AS occasion_id, CAST(o_orderdate AS DATE) AS occ_date, o_custkey AS venue_id,
         CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 0 END AS exclude_from_stats,
         dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE)) AS occ_seq
  FROM orders)"""
NUMBERED = """occ AS (
  SELECT o_orderkey AS occasion_id, CAST(o_orderdate AS DATE) AS occ_date, o_custkey AS venue_id,
         CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 0 END AS exclude_from_stats,
         row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS occ_seq
  FROM orders)"""
ITEMS = """items AS (
  SELECT p_partkey AS item_id, p_name AS item, CASE WHEN p_size <= 25 THEN 1 ELSE 0 END AS is_original
  FROM part)"""
VENUES = """venues AS (
  SELECT c_custkey AS venue_id, c_name AS venue, c_mktsegment AS city, n_name AS state, r_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def r2(x: str) -> str:
    """SQL text that rounds a double to 2 digits, halves to even, on the scaled value."""
    y = f"(({x}) * 100)"
    return (
        f"((CASE WHEN {y} - floor({y}) = 0.5 THEN floor({y}) + abs(floor({y}) % 2) ELSE round({y}) END) / 100)"
    )


def query(name: str, sql: str | None = None):
    """Register a query; dates come out as ISO text on both sides."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(prepare(spark))
            df = fn(spark, sf_dir)
            days = {f.name: F.date_format(f.name, "yyyy-MM-dd") for f in df.schema.fields
                    if isinstance(f.dataType, DateType)}
            return df.withColumns(days) if days else df

        if name in QUERIES:
            raise ValueError(f"query {name!r} is there already")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap
