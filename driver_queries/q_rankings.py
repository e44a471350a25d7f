"""History, item statistics, rankings and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driver_queries import bind
from driver_queries.bind import AS_OF, table
from driver_queries.registry import DATED, ITEMS, NAMED_PLAYS, NUMBERED, PLAYS, VENUES, query, r2
from gapkit.operators.lookups import point_lookup
from gapkit.plans import calendar as cal, history, rankings, reports, state as gap_state
from gapkit.session import ensure_checkpoint_dir
from gapkit.sources.datasource import read_table, register_formats
from gapkit.sources.layouts import FILES, LAYOUTS, ITEMS as ITEM_TABLE, OCCASIONS as OCCASION_TABLE, PLAYS as PLAY_TABLE
from gapkit.sources.tables import (
    load_tables, next_occasion_document, read_next_occasion, write_next_occasion, write_table, write_tables,
)
from gapkit.spec import PRESETS, Bundle
from gapkit.stored import stored

TIE = "l_shipdate, l_extendedprice, l_quantity, l_suppkey"

BY_DATE = PRESETS["named_by_date"].with_options(min_plays=30)
BY_LINK = PRESETS["named_by_link"].with_options(
    history_blacklist=("Red Widget",), result_blacklist=("Small Ring",), rotation_date_format="MM/dd/yy",
)
REPEATS = PRESETS["keyed_with_repeats"]
EXCLUSIONS = PRESETS["keyed_with_exclusions"]


def stats_sql(keys: str, source: str = "g") -> str:
    return f"""SELECT {keys}, count(*) AS n_plays, min(occ_seq) AS first_seq, max(occ_seq) AS last_played_seq,
      min(occ_date) AS debut_date, max(occ_date) AS ltp_date, min(gap) AS min_gap, max(gap) AS max_gap,
      {r2("avg(gap)")} AS avg_gap, {r2("median(gap)")} AS med_gap, {r2("stddev_samp(gap)")} AS std_gap
      FROM {source} GROUP BY {keys}"""


POINTS = """p AS (SELECT DISTINCT item_id, occ_seq, occ_date FROM plays JOIN occ USING (occasion_id)),
g AS (SELECT item_id AS item, occ_seq, occ_date,
      occ_seq - lag(occ_seq) OVER (PARTITION BY item_id ORDER BY occ_seq) AS gap FROM p)"""
FLAGGED = """h AS (SELECT item_id, occ_seq, occ_date, is_repeat,
      occ_seq - lag(occ_seq) OVER (PARTITION BY item_id ORDER BY occ_seq, position, is_repeat) AS gap
      FROM plays JOIN occ USING (occasion_id)),
g AS (SELECT item, is_original, occ_seq, occ_date, gap
      FROM h JOIN items USING (item_id) WHERE is_repeat = 0 AND item IS NOT NULL AND is_original IS NOT NULL)"""
PLAY_FLAGGED = """plays AS (
  SELECT l_orderkey AS occasion_id, l_partkey AS item_id, l_linenumber AS position,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_repeat,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_original
  FROM lineitem)"""
EXCLUDED = """counted AS (SELECT * FROM occ WHERE exclude_from_stats IS DISTINCT FROM 1),
h AS (SELECT item_id, is_original, occ_seq, occ_date, is_repeat,
      occ_seq - lag(occ_seq) OVER (PARTITION BY item_id ORDER BY occ_seq, position, is_repeat, is_original) AS gap
      FROM plays JOIN counted USING (occasion_id)),
g AS (SELECT item, h.is_original, occ_seq, occ_date, gap
      FROM h JOIN items USING (item_id) WHERE is_repeat = 0 AND item IS NOT NULL)"""
TITLED = """named AS (SELECT occasion_id, position,
      array_to_string(list_transform(string_split(lower(item_id), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS item
      FROM plays),
p AS (SELECT DISTINCT item, occ_seq, occ_date FROM named JOIN occ USING (occasion_id) WHERE item <> 'Red Widget'),
g AS (SELECT item, occ_seq, occ_date,
      occ_seq - lag(occ_seq) OVER (PARTITION BY item ORDER BY occ_seq) AS gap FROM p)"""


def overdue_sql(ctes: str, keys: str, last: str, where: str, extra: str = "") -> str:
    return f"""WITH {ctes}, s AS ({stats_sql(keys)}),
c AS (SELECT *, ({last}) - last_played_seq AS current_gap FROM s)
SELECT {extra}item, n_plays AS times_played_total, strftime(ltp_date, '%Y-%m-%d') AS ltp_date, current_gap,
       avg_gap, med_gap, current_gap - avg_gap AS current_minus_avg, current_gap - med_gap AS current_minus_med
FROM c WHERE {where}"""


def rotation_sql(ctes: str, keys: str, last: str, days: int, where: str, fmt: str = "%Y-%m-%d") -> str:
    return f"""WITH {ctes}, w AS (SELECT * FROM g WHERE occ_date > DATE '{AS_OF}' - {days}),
s AS ({stats_sql(keys, "w")}),
c AS (SELECT *, ({last}) - last_played_seq AS current_gap FROM s)
SELECT item, n_plays AS times_played_recent, strftime(ltp_date, '{fmt}') AS ltp_date, current_gap, avg_gap, med_gap
FROM c WHERE {where}"""


ACTIVE = f"ltp_date > DATE '{AS_OF}' - 1825"
DATED_CTE = f"{PLAYS}, {DATED}, {POINTS}"
FLAGGED_CTE = f"{PLAYS}, {NUMBERED}, {ITEMS}, {FLAGGED}"
EXCLUDED_CTE = f"{PLAY_FLAGGED}, {NUMBERED}, {ITEMS}, {EXCLUDED}"
TITLED_CTE = f"{NAMED_PLAYS}, {NUMBERED}, {TITLED}"
MAX_SEQ = "SELECT max(occ_seq) FROM occ"


def _exclusions_bundle(spark, sf_dir) -> Bundle:
    flagged = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("occasion_id"), F.col("l_partkey").alias("item_id"),
        F.col("l_linenumber").alias("position"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_repeat"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("is_original"),
    )
    base = bind.numbered_bundle(spark, sf_dir)
    return Bundle(flagged, base.occasions, base.items)


def _link_bundle(spark, sf_dir) -> Bundle:
    return Bundle(bind.named_plays(spark, sf_dir), bind.numbered_occasions(spark, sf_dir))


@query("c2_overdue_by_date", overdue_sql(DATED_CTE, "item", MAX_SEQ, f"n_plays > 30 AND {ACTIVE}"))
def overdue_by_date(spark, sf_dir):
    return rankings.overdue(bind.dated_bundle(spark, sf_dir), BY_DATE, AS_OF)


@query("c2_overdue_with_repeats", overdue_sql(
    FLAGGED_CTE, "item, is_original", MAX_SEQ.replace("max(occ_seq)", "max(occ_seq) - 1"),
    "n_plays > 10 AND is_original = 1"))
def overdue_with_repeats(spark, sf_dir):
    return rankings.overdue(bind.numbered_bundle(spark, sf_dir), REPEATS, AS_OF)


@query("c2_overdue_with_exclusions", overdue_sql(
    EXCLUDED_CTE, "item, is_original", "SELECT max(occ_seq) - 1 FROM counted",
    f"n_plays > 10 AND is_original = 1 AND {ACTIVE}"))
def overdue_with_exclusions(spark, sf_dir):
    return rankings.overdue(_exclusions_bundle(spark, sf_dir), EXCLUSIONS, AS_OF)


@query("c2_overdue_by_link", overdue_sql(
    TITLED_CTE, "item", MAX_SEQ, f"n_plays > 10 AND {ACTIVE} AND item <> 'Small Ring'"))
def overdue_by_link(spark, sf_dir):
    return rankings.overdue(_link_bundle(spark, sf_dir), BY_LINK, AS_OF)


def _state(spark, sf_dir, bundle, spec):
    """A state closed twice: at first up to 1998, then, from the stored one, up to May 2000."""
    path = f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    gap_state.store(gap_state.close(bundle, spec, gap_state.cut_before(bundle, spec, "1999-01-01")), path)
    later = gap_state.cut_before(bundle, spec, "2000-06-01")
    return gap_state.store(gap_state.close(bundle, spec, later, gap_state.load(spark, path)), path)


@query("c2_overdue_from_state", overdue_sql(
    FLAGGED_CTE, "item, is_original", MAX_SEQ.replace("max(occ_seq)", "max(occ_seq) - 1"),
    "n_plays > 10 AND is_original = 1"))
def overdue_from_state(spark, sf_dir):
    bundle = bind.numbered_bundle(spark, sf_dir)
    return gap_state.overdue_from(_state(spark, sf_dir, bundle, REPEATS), bundle, REPEATS, AS_OF)


@query("c3_rotation_from_state", rotation_sql(
    EXCLUDED_CTE, "item, is_original", "SELECT max(occ_seq) - 1 FROM counted", 366, "current_gap > 3 AND is_original = 1"))
def rotation_from_state(spark, sf_dir):
    bundle = _exclusions_bundle(spark, sf_dir)
    return gap_state.rotation_from(_state(spark, sf_dir, bundle, EXCLUSIONS), bundle, EXCLUSIONS, AS_OF)


@query("c3_rotation_by_date", rotation_sql(DATED_CTE, "item", MAX_SEQ, 366, "current_gap > 3"))
def rotation_by_date(spark, sf_dir):
    return rankings.rotation(bind.dated_bundle(spark, sf_dir), BY_DATE, AS_OF)


@query("c3_rotation_with_repeats", rotation_sql(
    FLAGGED_CTE, "item, is_original", MAX_SEQ.replace("max(occ_seq)", "max(occ_seq) - 1"), 366,
    "current_gap > 3 AND is_original = 1"))
def rotation_with_repeats(spark, sf_dir):
    return rankings.rotation(bind.numbered_bundle(spark, sf_dir), REPEATS, AS_OF)


@query("c3_rotation_with_exclusions", rotation_sql(
    EXCLUDED_CTE, "item, is_original", "SELECT max(occ_seq) - 1 FROM counted", 366,
    "current_gap > 3 AND is_original = 1"))
def rotation_with_exclusions(spark, sf_dir):
    return rankings.rotation(_exclusions_bundle(spark, sf_dir), EXCLUSIONS, AS_OF)


@query("c3_rotation_by_link", rotation_sql(
    TITLED_CTE, "item", MAX_SEQ, 732, "current_gap > 3 AND item <> 'Small Ring'", "%m/%d/%y"))
def rotation_by_link(spark, sf_dir):
    return rankings.rotation(_link_bundle(spark, sf_dir), BY_LINK, AS_OF)


def _wide_plays(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("occasion_id"), F.col("l_partkey").alias("item_id"),
        F.col("l_linenumber").alias("position"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_repeat"),
        "l_shipdate", "l_extendedprice", "l_quantity", "l_suppkey",
    )


WIDE = f"""plays AS (
  SELECT l_orderkey AS occasion_id, l_partkey AS item_id, l_linenumber AS position,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_repeat, {TIE}
  FROM lineitem)"""


@query("c1_history_with_repeats", f"""WITH {WIDE}, {NUMBERED}
SELECT occasion_id, item_id, position, is_repeat, occ_seq, strftime(occ_date, '%Y-%m-%d') AS occ_date,
  l_extendedprice,
  occ_seq - lag(occ_seq) OVER (PARTITION BY item_id ORDER BY occ_seq, position, is_repeat, {TIE}) AS gap
FROM plays LEFT JOIN occ USING (occasion_id)""")
def history_with_repeats(spark, sf_dir):
    base = bind.numbered_bundle(spark, sf_dir)
    bundle = Bundle(_wide_plays(spark, sf_dir), base.occasions, base.items)
    return history.play_history(bundle, REPEATS).select(
        "occasion_id", "item_id", "position", "is_repeat", "occ_seq", "occ_date", "l_extendedprice", "gap"
    )


@query("c1_history_deduped", f"""WITH {WIDE}, {DATED},
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, occ_seq
        ORDER BY position, is_repeat, occasion_id, {TIE}) AS n
      FROM plays LEFT JOIN occ USING (occasion_id))
SELECT occasion_id, item_id, position, is_repeat, occ_seq, strftime(occ_date, '%Y-%m-%d') AS occ_date,
  l_extendedprice, occ_seq - lag(occ_seq) OVER (PARTITION BY item_id ORDER BY occ_seq) AS gap
FROM r WHERE n = 1""")
def history_deduped(spark, sf_dir):
    base = bind.dated_bundle(spark, sf_dir)
    bundle = Bundle(_wide_plays(spark, sf_dir), base.occasions, base.items)
    return history.play_history(bundle, BY_DATE).select(
        "occasion_id", "item_id", "position", "is_repeat", "occ_seq", "occ_date", "l_extendedprice", "gap"
    )


@query("a1_item_stats", f"""WITH {DATED_CTE}, s AS ({stats_sql("item")})
SELECT * REPLACE (strftime(debut_date, '%Y-%m-%d') AS debut_date, strftime(ltp_date, '%Y-%m-%d') AS ltp_date)
FROM s""")
def item_stats(spark, sf_dir):
    return rankings.item_stats(bind.dated_bundle(spark, sf_dir), BY_DATE)


@query("a2_recent_stats", f"""WITH {FLAGGED_CTE}, w AS (SELECT * FROM g WHERE occ_date > DATE '{AS_OF}' - 366),
s AS ({stats_sql("item, is_original", "w")})
SELECT * REPLACE (strftime(debut_date, '%Y-%m-%d') AS debut_date, strftime(ltp_date, '%Y-%m-%d') AS ltp_date)
FROM s""")
def recent_stats(spark, sf_dir):
    since = F.date_sub(F.lit(AS_OF).cast("date"), 366)
    return rankings.item_stats(bind.numbered_bundle(spark, sf_dir), REPEATS, since)


@query("a3_last_sequence", f"""WITH {NUMBERED} SELECT 'max' AS policy, max(occ_seq) AS last_seq FROM occ
UNION ALL SELECT 'max_minus_one', max(occ_seq) - 1 FROM occ
UNION ALL SELECT 'last_past', max(occ_seq) FROM occ WHERE occ_date < DATE '2000-01-01'
UNION ALL SELECT 'max_played', max(occ_seq) FROM occ WHERE occasion_id IN (SELECT l_orderkey FROM lineitem)""")
def last_sequence(spark, sf_dir):
    bundle = bind.numbered_bundle(spark, sf_dir)
    rows = [
        rankings.last_sequence(bundle, BY_LINK.with_options(last_seq=policy), "2000-01-01")
        .select(F.lit(policy).alias("policy"), "last_seq")
        for policy in ("max", "max_minus_one", "last_past", "max_played")
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


C_CTE = f"""WITH {DATED_CTE}, s AS ({stats_sql("item")}),
c AS (SELECT *, ({MAX_SEQ}) - last_played_seq AS current_gap FROM s)"""


@query("c4_current_gap", f"{C_CTE} SELECT item, current_gap FROM c WHERE n_plays > 10 AND {ACTIVE}")
def current_gap(spark, sf_dir):
    spec = BY_DATE.with_options(min_plays=10)
    return rankings.overdue_scores(bind.dated_bundle(spark, sf_dir), spec, AS_OF).select("item", "current_gap")


@query("c5_gap_zscore", f"""{C_CTE} SELECT item, round(CASE WHEN std_gap <> 0 THEN (current_gap - avg_gap) / std_gap
  WHEN current_gap > avg_gap THEN 'inf'::DOUBLE WHEN current_gap < avg_gap THEN '-inf'::DOUBLE END, 6) AS gap_zscore
FROM c WHERE n_plays > 10 AND {ACTIVE}""")
def gap_zscore(spark, sf_dir):
    spec = BY_DATE.with_options(min_plays=10)
    scores = rankings.overdue_scores(bind.dated_bundle(spark, sf_dir), spec, AS_OF)
    return scores.select("item", F.round("gap_zscore", 6).alias("gap_zscore"))


@query("c6_distance_to_mean", f"""{C_CTE} SELECT item, current_gap - avg_gap AS current_minus_avg,
  current_gap - med_gap AS current_minus_med FROM c WHERE n_plays > 10 AND {ACTIVE}""")
def distance_to_mean(spark, sf_dir):
    spec = BY_DATE.with_options(min_plays=10)
    scores = rankings.overdue_scores(bind.dated_bundle(spark, sf_dir), spec, AS_OF)
    return scores.select("item", "current_minus_avg", "current_minus_med")


@query("c7_top_overdue", f"""WITH o AS ({overdue_sql(
    TITLED_CTE, "item", MAX_SEQ, f"n_plays > 10 AND {ACTIVE} AND item <> 'Small Ring'",
    "CASE WHEN std_gap <> 0 THEN (current_gap - avg_gap) / std_gap END AS z, ")}),
r AS (SELECT *, row_number() OVER (ORDER BY z DESC NULLS LAST, item) AS "Rank" FROM o)
SELECT "Rank", item AS "Song", times_played_total AS "Times Played", ltp_date AS "Last Show Played",
  current_gap AS "Current Show Gap", avg_gap AS "Average Show Gap", med_gap AS "Median Show Gap",
  current_minus_avg AS "Current Gap Minus Average", current_minus_med AS "Current Gap Minus Median"
FROM r WHERE "Rank" <= 50""")
def top_overdue(spark, sf_dir):
    scores = rankings.overdue_scores(_link_bundle(spark, sf_dir), BY_LINK, AS_OF)
    return reports.overdue_report(scores, headings=reports.OVERDUE_HEADINGS)


@query("c7_top_rotation", f"""WITH o AS ({rotation_sql(DATED_CTE, "item", MAX_SEQ, 366, "current_gap > 3")}),
r AS (SELECT *, row_number() OVER (ORDER BY times_played_recent DESC, item) AS rank FROM o)
SELECT rank, item, times_played_recent, ltp_date, current_gap, avg_gap, med_gap FROM r WHERE rank <= 50""")
def top_rotation(spark, sf_dir):
    return reports.rotation_report(rankings.rotation(bind.dated_bundle(spark, sf_dir), BY_DATE, AS_OF))


NEXT = f"""WITH {DATED}, {VENUES}, n AS (
  SELECT * FROM occ WHERE occ_date >= DATE '2000-06-15' ORDER BY occ_date, occasion_id LIMIT 1)
"""


@query("c8_next_occasion", NEXT + """SELECT occasion_id, strftime(occ_date, '%Y-%m-%d') AS occ_date, venue, city,
  state, country FROM n LEFT JOIN venues USING (venue_id)""")
def next_occasion(spark, sf_dir):
    row = cal.next_occasion(bind.calendar(spark, sf_dir), "2000-06-15", bind.venues(spark, sf_dir))
    return row.select("occasion_id", "occ_date", "venue", "city", "state", "country")


@query("c9_days_until_next", NEXT + """SELECT occasion_id, occ_date - DATE '2000-06-15' AS days_until FROM n""")
def days_until_next(spark, sf_dir):
    return cal.next_occasion(bind.calendar(spark, sf_dir), "2000-06-15").select("occasion_id", "days_until")


@query("c8_next_occasions_of_groups", """WITH occ AS (SELECT o_orderpriority AS performer, CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS id
  FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1, 2),
p AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(l_shipdate AS DATE) AS day, o_orderpriority AS performer
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, l_extendedprice, p.performer, strftime(day, '%Y-%m-%d') AS day, strftime(d, '%Y-%m-%d') AS next_date,
  id AS next_occasion_id, CAST(d - day AS INTEGER) AS days_until
FROM p ASOF LEFT JOIN occ ON p.performer = occ.performer AND occ.d >= p.day""")
def next_occasions_of_groups(spark, sf_dir):
    """The next occasion of every performer and day plays were shipped on."""
    orders = table(spark, sf_dir, "orders")
    occasions = orders.where("o_orderkey % 5 = 0").select(
        F.col("o_orderpriority").alias("performer"), F.to_date("o_orderdate").alias("occ_date"), F.col("o_orderkey").alias("occasion_id"))
    performers = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("performer"))
    days = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.to_date("l_shipdate").alias("day")).join(performers, "l_orderkey")
    return cal.next_occasions(days, occasions, ["performer"])


@query("s12_next_occasion_document", NEXT + """SELECT '{"next_show":{"date":"' || strftime(occ_date, '%Y-%m-%d')
  || '","venue_id":' || venue_id || ',"venue":"' || venue || '","city":"' || city || '","state":"' || state
  || '"}}' AS document FROM n LEFT JOIN venues USING (venue_id)""")
def next_document(spark, sf_dir):
    calendar = bind.calendar(spark, sf_dir)
    return next_occasion_document(calendar, "2000-06-15", bind.venues(spark, sf_dir)).withColumnRenamed(
        "value", "document")


def _document(spark, sf_dir, as_ofs):
    """What is stored after the next occasion was written for each of the days in turn."""
    path = f"{ensure_checkpoint_dir(spark)}/next-{uuid.uuid4().hex}"
    places = bind.venues(spark, sf_dir)
    for as_of in as_ofs:
        write_next_occasion(bind.calendar(spark, sf_dir), as_of, path, places)
    return read_next_occasion(spark, path, places)


@query("s6_next_occasion_read_back", NEXT + """SELECT strftime(occ_date, '%Y-%m-%d') AS date, CAST(venue_id AS VARCHAR) AS venue_id,
  venue, city, state FROM n LEFT JOIN venues USING (venue_id)""")
def next_read_back(spark, sf_dir):
    return _document(spark, sf_dir, ["1999-01-01", "2000-06-15"])


@query("s13_stale_next_occasion", """SELECT CAST(o_orderkey AS VARCHAR) AS venue_id, '' AS date FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '2030-01-01'""")
def stale_next(spark, sf_dir):
    return _document(spark, sf_dir, ["2000-06-15", "2030-01-01"]).select("venue_id", "date")


@query("ud5_registered_sources", overdue_sql(
    FLAGGED_CTE, "item, is_original", MAX_SEQ.replace("max(occ_seq)", "max(occ_seq) - 1"),
    "n_plays > 10 AND is_original = 1", "'stored' AS source, "))
def registered_sources(spark, sf_dir):
    """Two sources ranked and stored in one run; one of them cannot be loaded, which does not stop the other."""
    folder = f"{ensure_checkpoint_dir(spark)}/sources-{uuid.uuid4().hex}"
    entries = {
        "missing": (REPEATS, lambda: load_tables(spark, f"{folder}/nothing", "keyed_with_repeats")),
        "stored": (REPEATS, lambda: bind.numbered_bundle(spark, sf_dir)),
    }
    outcome = rankings.run_all(entries, AS_OF, lambda name, tables: write_tables(tables, f"{folder}/{name}"))
    done = [name for name, said in outcome.items() if said == "ok"]
    if done != ["stored"]:
        raise RuntimeError(str(outcome))
    return spark.read.parquet(f"{folder}/stored/overdue").select(F.lit("stored").alias("source"), "*")


@query("s13_no_next_occasion", """SELECT CAST(o_orderkey AS VARCHAR) AS document FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '2030-01-01'""")
def no_next(spark, sf_dir):
    return next_occasion_document(bind.calendar(spark, sf_dir), "2030-01-01").withColumnRenamed("value", "document")


@query("c10_freshness", """SELECT c_name AS source, coalesce(max(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')), 'Unknown')
  AS last_updated FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name""")
def freshness(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("source"), "c_custkey")
    orders = table(spark, sf_dir, "orders")
    stamps = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("source").agg(F.max("o_orderdate").alias("t"))
        .select("source", F.date_format(F.col("t").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated"))
    )
    return reports.freshness(stamps, customers)


GROUP_PLAYS = """plays AS (
  SELECT s_nationkey AS source, l_orderkey AS occasion_id, l_partkey AS item_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
cal AS (SELECT DISTINCT source, CAST(o_orderdate AS DATE) AS occ_date FROM plays JOIN orders ON occasion_id = o_orderkey),
seqs AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY occ_date) AS occ_seq FROM cal),
p AS (SELECT DISTINCT plays.source, item_id, occ_seq, occ_date FROM plays
      JOIN orders ON occasion_id = o_orderkey
      JOIN seqs ON seqs.source = plays.source AND occ_date = CAST(o_orderdate AS DATE)),
g AS (SELECT source, item_id AS item, occ_seq, occ_date,
      occ_seq - lag(occ_seq) OVER (PARTITION BY source, item_id ORDER BY occ_seq) AS gap FROM p),
policies AS (SELECT n_nationkey AS source, n_regionkey AS min_plays,
      CASE WHEN n_regionkey > 0 THEN 1825 END AS active_days, 366 * (1 + n_regionkey % 2) AS window_days,
      3 AS min_current_gap FROM nation)"""


def _group_inputs(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("source"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_partkey").alias("item_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("occasion_id"))
    plays = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("source", "occasion_id", "item_id")
    )
    # the calendar and the ranking both read them, each its own columns, so the join is made once
    plays = stored(plays, "group-plays")
    from gapkit.operators.sequence import date_sequence
    days = date_sequence(plays, "occasion_id", "occ_seq", ["source"])
    policies = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("min_plays"),
        F.when(F.col("n_regionkey") > 0, 1825).alias("active_days"),
        (F.lit(366) * (F.lit(1) + F.col("n_regionkey") % 2)).alias("window_days"), F.lit(3).alias("min_current_gap"),
    )
    spec = BY_DATE.with_options(name="groups", group=("source",))
    return Bundle(plays, days.withColumn("occ_date", F.col("occasion_id"))), spec, policies


@query("c17_overdue_of_groups", f"""WITH {GROUP_PLAYS}, s AS ({stats_sql("source, item")}),
c AS (SELECT s.*, l.last_seq - last_played_seq AS current_gap FROM s
      JOIN (SELECT source, max(occ_seq) AS last_seq FROM seqs GROUP BY source) l USING (source))
SELECT source, item, n_plays AS times_played_total, strftime(ltp_date, '%Y-%m-%d') AS ltp_date, current_gap, avg_gap,
  med_gap, current_gap - avg_gap AS current_minus_avg, current_gap - med_gap AS current_minus_med
FROM c JOIN policies USING (source) WHERE n_plays > min_plays
  AND (active_days IS NULL OR ltp_date > DATE '{AS_OF}' - active_days)""")
def overdue_of_groups(spark, sf_dir):
    bundle, spec, policies = _group_inputs(spark, sf_dir)
    return rankings.rank_groups(bundle, spec, policies, AS_OF)[0]


@query("c17_rotation_of_groups", f"""WITH {GROUP_PLAYS},
w AS (SELECT g.* FROM g JOIN policies USING (source) WHERE occ_date > DATE '{AS_OF}' - window_days),
s AS ({stats_sql("source, item", "w")}),
c AS (SELECT s.*, l.last_seq - last_played_seq AS current_gap FROM s
      JOIN (SELECT source, max(occ_seq) AS last_seq FROM seqs GROUP BY source) l USING (source))
SELECT source, item, n_plays AS times_played_recent, strftime(ltp_date, '%Y-%m-%d') AS ltp_date, current_gap, avg_gap,
  med_gap FROM c JOIN policies USING (source) WHERE current_gap > min_current_gap""")
def rotation_of_groups(spark, sf_dir):
    bundle, spec, policies = _group_inputs(spark, sf_dir)
    return rankings.rank_groups(bundle, spec, policies, AS_OF)[1]


@query("s4_tables_from_files", overdue_sql(
    FLAGGED_CTE, "item, is_original", MAX_SEQ.replace("max(occ_seq)", "max(occ_seq) - 1"),
    "n_plays > 10 AND is_original = 1"))
def tables_from_files(spark, sf_dir):
    """The driver tables written as files of a known layout, loaded and ranked."""
    folder = f"{ensure_checkpoint_dir(spark)}/layout-{uuid.uuid4().hex}"
    base = bind.numbered_bundle(spark, sf_dir)
    null = F.lit(None).cast("string")
    files = {
        ITEM_TABLE: base.items.select(
            F.col("item_id").alias("song_id"), F.col("item").alias("song"), "is_original", null.alias("original_artist"),
            null.alias("debut_date"), null.alias("last_played"), null.alias("times_played"), null.alias("avg_show_gap")),
        OCCASION_TABLE: base.occasions.select(
            F.col("occ_seq").alias("show_number"), F.col("occasion_id").alias("show_id"),
            F.date_format("occ_date", "yyyy-MM-dd").alias("show_date"), "venue_id", null.alias("tour_id"),
            F.lit(1).alias("show_order")),
        PLAY_TABLE: base.plays.select(
            F.lit(0).alias("uniqueid"), F.col("occasion_id").alias("show_id"), F.col("item_id").alias("song_id"),
            F.lit("1").alias("setnumber"), "position", null.alias("tracktime"), F.lit(1).alias("transition_id"),
            F.col("is_repeat").alias("isreprise"), F.lit(0).alias("isjam"), F.lit('a "note", x').alias("footnote"),
            F.lit(0).alias("isjamchart"), null.alias("jamchart_notes"), null.alias("soundcheck"),
            F.lit(1).alias("isverified"), F.lit(0).alias("isrecommended")),
    }
    for name, table_ in files.items():
        write_table(table_, f"{folder}/{FILES[name]}", "csv")
    return rankings.overdue(load_tables(spark, folder, "keyed_with_repeats"), REPEATS, AS_OF)


def _landed(spark, sf_dir, layout: str, name: str):
    """Lines of the driver tables as files of a layout's plays, under the file's own column names."""
    folder = f"{ensure_checkpoint_dir(spark)}/format-{uuid.uuid4().hex}"
    shape = LAYOUTS[layout]
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("o"), F.col("l_partkey").cast("string").alias("p"), F.col("l_linenumber").cast("string").alias("n"),
        F.to_date("l_shipdate").alias("d"))
    chosen = {"occasion_id": F.date_format("d", "yyyy-MM-dd") if layout == "named_by_date" else F.col("o"), "position": F.col("n"),
              "item_id": F.concat(F.lit('a "song", '), "p") if name == "text" else F.col("p")}
    renames = shape.renames[PLAY_TABLE]
    columns = [chosen.get(renames.get(c, c), F.lit(None).cast("string")).alias(c)
               for c in StructType.fromDDL(shape.schemas[PLAY_TABLE]).names]
    write_table(lines.select(*columns), f"{folder}/{FILES[PLAY_TABLE]}", "csv")
    return folder


FORMAT_SQL = "SELECT {} AS occasion_id, {} AS item_id, {} AS position FROM lineitem"


@query("s4_format_keyed_with_repeats", FORMAT_SQL.format("CAST(l_orderkey AS INTEGER)", "CAST(l_partkey AS INTEGER)", "l_linenumber"))
def format_with_repeats(spark, sf_dir):
    folder = _landed(spark, sf_dir, "keyed_with_repeats", "number")
    return read_table(spark, folder, "keyed_with_repeats", PLAY_TABLE).select("occasion_id", "item_id", "position")


@query("s4_format_keyed_with_exclusions", FORMAT_SQL.format("CAST(l_orderkey AS INTEGER)", "CAST(l_partkey AS INTEGER)", "l_linenumber"))
def format_with_exclusions(spark, sf_dir):
    folder = _landed(spark, sf_dir, "keyed_with_exclusions", "number")
    return read_table(spark, folder, "keyed_with_exclusions", PLAY_TABLE).select("occasion_id", "item_id", "position")


@query("s4_format_named_by_date", """SELECT strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS occasion_id, 'a "song", ' || l_partkey AS item_id
FROM lineitem""")
def format_by_date(spark, sf_dir):
    folder = _landed(spark, sf_dir, "named_by_date", "text")
    return read_table(spark, folder, "named_by_date", PLAY_TABLE).select("occasion_id", "item_id")


@query("s4_format_named_by_link", FORMAT_SQL.format("CAST(l_orderkey AS VARCHAR)", "'a \"song\", ' || l_partkey", "l_linenumber"))
def format_by_link(spark, sf_dir):
    """As a stream over the landed files, stored and read back."""
    folder = _landed(spark, sf_dir, "named_by_link", "text")
    register_formats(spark)
    landed = spark.readStream.format("gapkit_named_by_link").option("table", PLAY_TABLE).load(folder)
    landed.select("occasion_id", "item_id", "position").writeStream.option("checkpointLocation", f"{folder}/progress").trigger(
        availableNow=True).format("parquet").option("path", f"{folder}/stored").start().awaitTermination()
    return spark.read.schema("occasion_id string, item_id string, position int").parquet(f"{folder}/stored")


@query("f17_point_lookup", f"""WITH {VENUES} SELECT o_orderkey AS occasion_id, o_custkey AS venue_id, venue, state
FROM orders LEFT JOIN venues ON o_custkey = venue_id""")
def venue_of_occasion(spark, sf_dir):
    occasions = bind.calendar(spark, sf_dir).select("occasion_id", "venue_id")
    return point_lookup(occasions, bind.venues(spark, sf_dir), "venue_id", ["venue", "state"])
