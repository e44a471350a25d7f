"""Order-aware operators and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import bind
from driver_queries.bind import table
from driver_queries.registry import DATED, NUMBERED, PLAYS, query
from gapkit.functions import ordinal_letter
from gapkit.operators import notes, ordered, runs, sequence, sets
from gapkit.operators.enrich import items_per_occasion
from gapkit.plans import calendar as cal
from gapkit.streaming.incremental import high_water_mark

TIES = ["position", "item_id", "l_shipdate", "l_extendedprice", "l_quantity", "l_suppkey"]
TIE_SQL = "position, item_id, l_shipdate, l_extendedprice, l_quantity, l_suppkey"
LINES = """lines AS (SELECT l_orderkey AS occasion_id, l_partkey AS item_id, l_linenumber AS position,
  l_linestatus AS set_label, l_shipdate, l_extendedprice, l_quantity, l_suppkey FROM lineitem)"""
EVENTS = """e AS (SELECT user_id, event_id, event_type, ts FROM events)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("occasion_id"), F.col("l_partkey").alias("item_id"),
        F.col("l_linenumber").alias("position"), F.col("l_linestatus").alias("set_label"),
        "l_shipdate", "l_extendedprice", "l_quantity", "l_suppkey",
    )


@query("w1_gap", f"""WITH {PLAYS}, {DATED}, p AS (SELECT DISTINCT item_id, occ_seq FROM plays JOIN occ USING (occasion_id))
SELECT item_id, occ_seq, occ_seq - lag(occ_seq) OVER (PARTITION BY item_id ORDER BY occ_seq) AS gap FROM p""")
def gap(spark, sf_dir):
    days = bind.dated_occasions(spark, sf_dir).select("occasion_id", "occ_seq")
    points = bind.plays(spark, sf_dir).join(days, "occasion_id").select("item_id", "occ_seq").distinct()
    # narrow buckets, so that the edge table is at work
    lagged = ordered.lag_value(points, ["item_id"], ["occ_seq"], "occ_seq", "prev", ordered.seq_bucket("occ_seq", 500))
    return lagged.select("item_id", "occ_seq", (F.col("occ_seq") - F.col("prev")).alias("gap"))


@query("w2_repeat_ordinal", f"""WITH {LINES} SELECT occasion_id, item_id, position, l_extendedprice,
  row_number() OVER (PARTITION BY occasion_id, item_id ORDER BY {TIE_SQL}) - 1 AS repeat_no FROM lines""")
def repeat_ordinal(spark, sf_dir):
    numbered = sequence.ordinal_within(_lines(spark, sf_dir), ["occasion_id", "item_id"], TIES, "n")
    return numbered.select("occasion_id", "item_id", "position", "l_extendedprice", (F.col("n") - 1).alias("repeat_no"))


@query("w2_first_play", f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY occasion_id, item_id
  ORDER BY {TIE_SQL}) AS n FROM lines) SELECT occasion_id, item_id, position, l_extendedprice FROM r WHERE n = 1""")
def first_play(spark, sf_dir):
    return sets.drop_repeats(_lines(spark, sf_dir), ["occasion_id", "item_id"], TIES).select(
        "occasion_id", "item_id", "position", "l_extendedprice")


@query("w3_position_in_set", f"""WITH {LINES} SELECT occasion_id, set_label, position, item_id, l_extendedprice,
  row_number() OVER (PARTITION BY occasion_id, set_label ORDER BY {TIE_SQL}) AS position_in_set FROM lines""")
def position_in_set(spark, sf_dir):
    numbered = sequence.ordinal_within(
        _lines(spark, sf_dir), ["occasion_id", "set_label"], TIES, "position_in_set")
    return numbered.select("occasion_id", "set_label", "position", "item_id", "l_extendedprice", "position_in_set")


@query("w4_day_letter", f"""WITH {DATED} SELECT occasion_id, strftime(occ_date, '%Y-%m-%d') AS occ_date,
  chr(CAST(96 + row_number() OVER (PARTITION BY occ_date ORDER BY occasion_id) AS INTEGER)) AS letter FROM occ""")
def day_letter(spark, sf_dir):
    numbered = ordered.row_ordinal(
        bind.calendar(spark, sf_dir), ["occ_date"], ["occasion_id"], "n", ordered.seq_bucket("occasion_id"))
    return numbered.select("occasion_id", "occ_date", ordinal_letter(F.col("n")).alias("letter"))


@query("w5_date_sequence", """SELECT strftime(d, '%Y-%m-%d') AS occ_date, row_number() OVER (ORDER BY d) AS occ_seq
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def date_sequence(spark, sf_dir):
    return sequence.date_sequence(bind.calendar(spark, sf_dir), "occ_date", "occ_seq")


@query("w6_global_sequence", f"""WITH {NUMBERED} SELECT occasion_id, strftime(occ_date, '%Y-%m-%d') AS occ_date, occ_seq
FROM occ""")
def global_sequence(spark, sf_dir):
    return bind.numbered_occasions(spark, sf_dir).select("occasion_id", "occ_date", "occ_seq")


@query("w6_global_sequence_of_plays", f"""WITH {LINES} SELECT occasion_id, item_id, position, l_extendedprice,
  row_number() OVER (ORDER BY occasion_id, {TIE_SQL}) AS play_seq FROM lines""")
def global_sequence_of_plays(spark, sf_dir):
    numbered = sequence.global_sequence(_lines(spark, sf_dir), ["occasion_id", *TIES], "play_seq")
    return numbered.select("occasion_id", "item_id", "position", "l_extendedprice", "play_seq")


@query("w7_sequence_in_year", f"""WITH {NUMBERED} SELECT occasion_id, year(occ_date) AS year,
  row_number() OVER (PARTITION BY year(occ_date) ORDER BY occ_seq) AS seq_in_year FROM occ""")
def sequence_in_year(spark, sf_dir):
    dated = bind.numbered_occasions(spark, sf_dir).withColumn("year", F.year("occ_date"))
    return sequence.sequence_within(dated, ["year"], "occ_seq", "seq_in_year", width=1000).select(
        "occasion_id", "year", "seq_in_year")


@query("w8_position_in_occasion", f"""WITH {LINES} SELECT occasion_id, position, item_id, l_extendedprice,
  row_number() OVER (PARTITION BY occasion_id ORDER BY {TIE_SQL}) AS position_in_occasion FROM lines""")
def position_in_occasion(spark, sf_dir):
    numbered = sequence.ordinal_within(_lines(spark, sf_dir), ["occasion_id"], TIES, "position_in_occasion")
    return numbered.select("occasion_id", "position", "item_id", "l_extendedprice", "position_in_occasion")


RUN = """SELECT occ.*, o_orderpriority AS place, CASE WHEN lag(o_orderpriority) OVER (ORDER BY occ_seq) = o_orderpriority
  {more} THEN 0 ELSE 1 END AS brk FROM occ JOIN orders ON o_orderkey = occasion_id"""


def _placed(spark, sf_dir):
    places = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("occasion_id"), F.col("o_orderpriority").alias("place"))
    return bind.numbered_occasions(spark, sf_dir).join(places, "occasion_id")


@query("w9_run_index", f"""WITH {NUMBERED}, f AS ({RUN.format(more="")})
SELECT occasion_id, place, occ_seq, sum(brk) OVER (ORDER BY occ_seq) AS run_index FROM f""")
def run_index(spark, sf_dir):
    numbered = runs.run_index(
        _placed(spark, sf_dir), "place", ["occ_seq"], bucket=ordered.seq_bucket("occ_seq", 4096))
    return numbered.select("occasion_id", "place", "occ_seq", "run_index")


EVENT_RUNS = f"""{EVENTS}, f AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)
  = event_type THEN 0 ELSE 1 END AS brk,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM e),
r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_index FROM f)"""


def _event_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    # a user may hold a third of all events: number them first, then every bucket is bounded
    numbered = sequence.global_sequence(events, ["user_id", "ts", "event_id"], "event_seq")
    return runs.run_index(numbered, "event_type", ["event_seq"], keys=["user_id"])


@query("w9_event_runs", f"WITH {EVENT_RUNS} SELECT user_id, event_id, event_type, run_index FROM r")
def event_runs(spark, sf_dir):
    return _event_runs(spark, sf_dir).select("user_id", "event_id", "event_type", "run_index")


@query("w10_run_by_day", f"""WITH {NUMBERED}, f AS ({RUN.format(
    more="AND occ_date - lag(occ_date) OVER (ORDER BY occ_seq) = 1")})
SELECT occasion_id, place, occ_seq, sum(brk) OVER (ORDER BY occ_seq) AS run_index FROM f""")
def run_by_day(spark, sf_dir):
    numbered = runs.run_index(
        _placed(spark, sf_dir), "place", ["occ_seq"], date_col="occ_date", bucket=ordered.seq_bucket("occ_seq", 4096))
    return numbered.select("occasion_id", "place", "occ_seq", "run_index")


@query("w11_position_in_run", f"""WITH {EVENT_RUNS}
SELECT user_id, event_id, run_index, seq - min(seq) OVER (PARTITION BY user_id, run_index) + 1 AS pos_in_run FROM r""")
def position_in_run(spark, sf_dir):
    return runs.position_in_run(_event_runs(spark, sf_dir), "run_index", "event_seq", keys=["user_id"]).select(
        "user_id", "event_id", "run_index", "pos_in_run")


@query("w12_previous_and_next", """SELECT conv_id, turn, role,
  lag(text, 1, '***') OVER (PARTITION BY conv_id ORDER BY turn) AS item_before,
  lead(text, 1, '***') OVER (PARTITION BY conv_id ORDER BY turn) AS item_after FROM conversations""")
def previous_and_next(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    bucket = ordered.seq_bucket("turn")
    both = ordered.neighbour_values(turns, ["conv_id"], ["turn"], "text", "item_before", "item_after", bucket, "***")
    return both.select("conv_id", "turn", "role", "item_before", "item_after")


@query("w13_carry_forward", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN 'Set ' || turn END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS current_set FROM conversations""")
def carry_forward(spark, sf_dir):
    labelled = table(spark, sf_dir, "conversations").withColumn(
        "label", F.when(F.col("role") == "user", F.concat(F.lit("Set "), F.col("turn"))))
    carried = ordered.carry_forward(
        labelled, ["conv_id"], ["turn"], "label", "current_set", ordered.seq_bucket("turn", 3))
    return carried.select("conv_id", "turn", "current_set")


@query("w14_rank", """SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, c_custkey, c_acctbal
FROM customer QUALIFY rank <= 50""")
def rank(spark, sf_dir):
    from gapkit.plans.reports import top_report
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return top_report(customers, [F.desc("c_acctbal"), F.asc("c_custkey")])


@query("w15_first_and_last_row", f"""WITH {PLAYS}, {NUMBERED}
SELECT item_id, arg_min(occasion_id, occ_seq) AS first_occasion, arg_max(occasion_id, occ_seq) AS last_occasion
FROM plays JOIN occ USING (occasion_id) GROUP BY item_id""")
def first_and_last(spark, sf_dir):
    numbered = bind.numbered_occasions(spark, sf_dir).select("occasion_id", "occ_seq")
    return bind.plays(spark, sf_dir).join(numbered, "occasion_id").groupBy("item_id").agg(
        F.min_by("occasion_id", "occ_seq").alias("first_occasion"),
        F.max_by("occasion_id", "occ_seq").alias("last_occasion"))


@query("a4_first_and_last_date", f"""WITH {PLAYS}, {DATED}
SELECT item_id, strftime(min(occ_date), '%Y-%m-%d') AS debut_date, strftime(max(occ_date), '%Y-%m-%d') AS ltp_date
FROM plays JOIN occ USING (occasion_id) GROUP BY item_id""")
def first_and_last_date(spark, sf_dir):
    days = bind.calendar(spark, sf_dir).select("occasion_id", "occ_date")
    return bind.plays(spark, sf_dir).join(days, "occasion_id").groupBy("item_id").agg(
        F.min("occ_date").alias("debut_date"), F.max("occ_date").alias("ltp_date"))


@query("a5_first_future_date", """SELECT strftime(min(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS first_future FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '2000-06-15'""")
def first_future_date(spark, sf_dir):
    future = cal.future_occasions(bind.calendar(spark, sf_dir), "2000-06-15")
    return future.agg(F.min("occ_date").alias("first_future"))


@query("a6_high_water_mark", """SELECT o_orderkey AS occasion_id FROM orders
WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)""")
def at_high_water_mark(spark, sf_dir):
    calendar = bind.calendar(spark, sf_dir)
    return calendar.where(F.col("occ_date") == high_water_mark(calendar)).select("occasion_id")


@query("a7_set_min_max", """SELECT l_orderkey AS occasion_id, min(l_linenumber) AS min_set, max(l_linenumber) AS max_set
FROM lineitem GROUP BY l_orderkey""")
def set_min_max(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("occasion_id").agg(
        F.min("position").alias("min_set"), F.max("position").alias("max_set"))


@query("a8_items_per_occasion", "SELECT l_orderkey AS occasion_id, max(l_linenumber) AS n_items FROM lineitem GROUP BY 1")
def n_items(spark, sf_dir):
    return items_per_occasion(bind.plays(spark, sf_dir))


@query("a10_distinct_values", "SELECT DISTINCT l_orderkey AS occasion_id FROM lineitem")
def distinct_values(spark, sf_dir):
    return bind.plays(spark, sf_dir).select("occasion_id").distinct()


@query("a11_dimension", """SELECT DISTINCT c_mktsegment AS city, n_name AS state, n_regionkey AS tour_id
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def dimension(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_mktsegment").alias("city"), F.col("n_name").alias("state"), F.col("n_regionkey").alias("tour_id"))
    return sets.dimension(joined, ["city", "state", "tour_id"], "state")


@query("a12_notes_per_occasion", """SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS occasion_notes
FROM conversations GROUP BY conv_id""")
def notes_per_occasion(spark, sf_dir):
    return notes.concat_notes(
        table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", "occasion_notes")
