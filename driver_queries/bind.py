"""Driver tables seen as plays, occasions, items and venues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapkit.operators.sequence import global_sequence, with_date_sequence
from gapkit.spec import SEQ_BUCKET, Bundle

AS_OF = "2001-08-02"


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table under its known schema, which spares a look at the files while planning."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("occasion_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_linenumber").alias("position"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_repeat"),
    )


def named_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays keyed by the item's name."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_name")
    return (
        plays(spark, sf_dir).join(parts, "item_id")
        .select("occasion_id", F.col("p_name").alias("item_id"), "position", "is_repeat")
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as occasions, without a sequence number."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("occasion_id"),
        F.to_date("o_orderdate").alias("occ_date"),
        F.col("o_custkey").alias("venue_id"),
        F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 0)
        .alias("exclude_from_stats"),
    )


def dated_occasions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of one day share the day's dense rank."""
    return with_date_sequence(calendar(spark, sf_dir), "occ_date", "occ_seq")


def numbered_occasions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order has its own number, by day and key."""
    return global_sequence(calendar(spark, sf_dir), ["occ_date", "occasion_id"], "occ_seq")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item"),
        (F.col("p_size") <= 25).cast("int").alias("is_original"),
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("venue_id"), F.col("c_name").alias("venue"),
            F.col("c_mktsegment").alias("city"), F.col("n_name").alias("state"),
            F.col("r_name").alias("country"),
        )
    )


def dated_bundle(spark: SparkSession, sf_dir: str) -> Bundle:
    return Bundle(plays(spark, sf_dir), dated_occasions(spark, sf_dir), items(spark, sf_dir))


def numbered_bundle(spark: SparkSession, sf_dir: str) -> Bundle:
    return Bundle(plays(spark, sf_dir), numbered_occasions(spark, sf_dir), items(spark, sf_dir))


# Distinct order days stay below one bucket for any calendar shorter than 179 years.
DAY_SPAN = SEQ_BUCKET
