"""Projections, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import bind
from driver_queries.bind import AS_OF, table
from driver_queries.registry import DATED, ITEMS, NUMBERED, PLAYS, VENUES, query
from gapkit.functions import days_before
from gapkit.operators import enrich, lookups, notes, ordered, sets
from gapkit.plans import calendar as cal, history
from gapkit.spec import PRESETS, Bundle

# --- projections -------------------------------------------------------------------------------------------------


@query("p1_select_and_rename", """SELECT o_orderkey AS occasion_id, o_totalprice, o_custkey AS venue_id FROM orders""")
def select_and_rename(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "occasion_id", "o_custkey": "venue_id"})
        .drop("o_orderpriority", "not_there").select("occasion_id", "o_totalprice", "venue_id")
    )


@query("p4_column_to_front", "SELECT 'orders' AS source, o_orderpriority, o_orderkey, o_custkey FROM orders")
def column_to_front(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rest = [c for c in orders.columns if c != "o_orderpriority"]
    return orders.select(F.lit("orders").alias("source"), "o_orderpriority", *rest)


@query("p6_computed_columns", """SELECT l_orderkey, l_linenumber, l_extendedprice,
  round(l_extendedprice * (1 - l_discount), 4) AS net, l_linenumber + 1 AS next_line FROM lineitem""")
def computed_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumns({
        "net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), "next_line": F.col("l_linenumber") + 1})
    return lines.select("l_orderkey", "l_linenumber", "l_extendedprice", "net", "next_line")


@query("p7_casts", """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text,
  TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, TRY_CAST(o_orderpriority AS INTEGER) AS no_number FROM orders""")
def casts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("key_text"),
        F.left("o_orderpriority", F.lit(1)).try_cast("int").alias("priority"),
        F.col("o_orderpriority").try_cast("int").alias("no_number"))


@query("p8_fill_and_blank_nulls", """SELECT d.doc_id, coalesce(quality, 0) AS quality, nullif(lang, 'en') AS lang,
  coalesce(nullif(lang, 'en'), '') AS filled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def fill_and_blank(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(
        table(spark, sf_dir, "labels"), "doc_id", "left")
    blanked = joined.withColumn("lang", F.nullif("lang", F.lit("en"))).withColumn("filled", F.col("lang"))
    return blanked.fillna({"quality": 0, "filled": ""}).select("doc_id", "quality", "lang", "filled")


@query("p10_first_matching_rule", """SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' AND p_size < 20 THEN 'A'
  WHEN p_size < 10 THEN 'B' WHEN p_name LIKE 'small%' THEN 'C' ELSE p_name END AS label FROM part""")
def first_matching_rule(spark, sf_dir):
    rules = [
        ((F.col("p_brand") == "Brand#2") & (F.col("p_size") < 20), "A"), (F.col("p_size") < 10, "B"),
        (F.col("p_name").startswith("small"), "C"),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", lookups.first_match(rules, F.col("p_name")).alias("label"))


@query("p11_nested_labels", """SELECT p_partkey, CASE WHEN p_name LIKE '%gear%' THEN 'e' WHEN p_name LIKE '%bolt%' THEN '1'
  ELSE p_name END AS label FROM part""")
def nested_labels(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(name.contains("gear"), "e").when(name.contains("bolt"), "1").otherwise(name).alias("label"))


@query("p12_dictionary_lookup", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open'
  ELSE o_orderstatus END AS status FROM orders""")
def dictionary_lookup(spark, sf_dir):
    names = {"F": "done", "O": "open"}
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", lookups.map_or_self(F.col("o_orderstatus"), names).alias("status"))


@query("p12_table_lookup", """SELECT p_partkey, coalesce(CASE WHEN rn = 1 THEN 'first ' || p_name END, p_name) AS p_name FROM
  (SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_brand) AS rn FROM part)""")
def table_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = part.agg(F.min("p_brand")).scalar()
    renames = part.where(F.col("p_brand") == first).select(
        F.concat(F.lit("k"), "p_partkey").alias("code"), F.concat(F.lit("first "), "p_name").alias("renamed"))
    coded = part.select("p_partkey", "p_name", F.concat(F.lit("k"), "p_partkey").alias("code"))
    looked = lookups.lookup_or_self(coded, "code", renames, "code", "renamed")
    return looked.select("p_partkey", F.when(F.col("code").startswith("first "), F.col("code"))
                         .otherwise(F.col("p_name")).alias("p_name"))


@query("p13_value_replacement", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building!'
  WHEN 'MACHINERY' THEN 'Machinery!' ELSE c_mktsegment END AS segment FROM customer""")
def value_replacement(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return customers.replace({"BUILDING": "Building!", "MACHINERY": "Machinery!"}, subset=["segment"])


@query("p14_two_key_correction", """WITH c AS (SELECT c_custkey, c_mktsegment AS venue, 'N' || c_nationkey AS state,
  'C' || (c_custkey % 7) AS city FROM customer)
SELECT c_custkey, CASE WHEN state IN ('N1', 'N3') THEN venue || ' of ' || state
  WHEN city IN ('C2', 'C5') THEN venue || ' in ' || city ELSE venue END AS venue FROM c""")
def two_key_correction(spark, sf_dir):
    places = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("venue"), F.concat(F.lit("N"), "c_nationkey").alias("state"),
        F.concat(F.lit("C"), F.col("c_custkey") % 7).alias("city"))
    by_state = places.where(F.col("state").isin("N1", "N3")).select("venue", "state").distinct().select(
        "venue", "state", F.lit(None).cast("string").alias("city"),
        F.concat("venue", F.lit(" of "), "state").alias("new_venue"))
    by_city = places.where(F.col("city").isin("C2", "C5")).select("venue", "city").distinct().select(
        "venue", F.lit(None).cast("string").alias("state"), "city",
        F.concat("venue", F.lit(" in "), "city").alias("new_venue"))
    return lookups.correct_place(places, by_state.unionByName(by_city)).select("c_custkey", "venue")


@query("p15_key_override", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'special-' || o_orderkey
  ELSE 'link-' || o_orderkey END AS link FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')""")
def key_override(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    linked = orders.select("o_orderkey", "o_custkey", F.concat(F.lit("link-"), "o_orderkey").alias("link"))
    special = orders.where("o_orderstatus = 'P'").select(
        "o_orderkey", "o_custkey", F.concat(F.lit("special-"), "o_orderkey").alias("link"))
    dropped = orders.where("o_orderstatus = 'F' AND o_orderpriority = '5-LOW'").select(
        "o_orderkey", "o_custkey", F.lit("NODATA").alias("link"))
    return lookups.override_keys(linked, special.unionByName(dropped), ["o_orderkey", "o_custkey"], "link").select(
        "o_orderkey", "link")


# --- filters -----------------------------------------------------------------------------------------------------


@query("f1_main_plays", "SELECT l_orderkey AS occasion_id, l_partkey AS item_id FROM lineitem WHERE l_returnflag <> 'R'")
def main_plays(spark, sf_dir):
    return bind.plays(spark, sf_dir).where("is_repeat = 0").select("occasion_id", "item_id")


@query("f2_originals", "SELECT p_partkey AS item_id, p_name AS item FROM part WHERE p_size <= 25")
def originals(spark, sf_dir):
    return bind.items(spark, sf_dir).where("is_original = 1").select("item_id", "item")


@query("f3_minimum_plays", "SELECT l_partkey AS item_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 30")
def minimum_plays(spark, sf_dir):
    return bind.plays(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n")).where("n > 30")


@query("f4_active_items", f"""WITH {PLAYS}, {DATED} SELECT item_id, strftime(max(occ_date), '%Y-%m-%d') AS ltp_date
FROM plays JOIN occ USING (occasion_id) GROUP BY item_id HAVING max(occ_date) > DATE '{AS_OF}' - 30""")
def active_items(spark, sf_dir):
    days = bind.calendar(spark, sf_dir).select("occasion_id", "occ_date")
    last = bind.plays(spark, sf_dir).join(days, "occasion_id").groupBy("item_id").agg(F.max("occ_date").alias("ltp_date"))
    return last.where(F.col("ltp_date") > days_before(F.lit(AS_OF).cast("date"), 30))


@query("f5_recent_plays", f"""WITH {PLAYS}, {DATED} SELECT occasion_id, item_id, position FROM plays JOIN occ
USING (occasion_id) WHERE occ_date > DATE '{AS_OF}' - 366""")
def recent_plays(spark, sf_dir):
    recent = bind.calendar(spark, sf_dir).where(F.col("occ_date") > days_before(F.lit(AS_OF).cast("date"), 366))
    return bind.plays(spark, sf_dir).join(recent.select("occasion_id"), "occasion_id").select(
        "occasion_id", "item_id", "position")


@query("f6_not_played_lately", f"""WITH {PLAYS}, {DATED}, s AS (SELECT item_id, (SELECT max(occ_seq) FROM occ) - max(occ_seq)
  AS current_gap FROM plays JOIN occ USING (occasion_id) GROUP BY item_id) SELECT * FROM s WHERE current_gap > 3""")
def not_played_lately(spark, sf_dir):
    days = bind.dated_occasions(spark, sf_dir).select("occasion_id", "occ_seq")
    last = bind.plays(spark, sf_dir).join(days, "occasion_id").groupBy("item_id").agg(F.max("occ_seq").alias("s"))
    top = days.agg(F.max("occ_seq")).scalar()
    return last.select("item_id", (top - F.col("s")).alias("current_gap")).where("current_gap > 3")


@query("f7_blacklist", """SELECT l_orderkey AS occasion_id, p_name AS item_id, l_linenumber AS position FROM lineitem
JOIN part ON l_partkey = p_partkey WHERE p_name NOT IN ('red widget', 'small ring')""")
def blacklist(spark, sf_dir):
    spec = PRESETS["named_by_link"].with_options(title_case=False, history_blacklist=("red widget", "small ring"))
    bundle = Bundle(bind.named_plays(spark, sf_dir), bind.calendar(spark, sf_dir))
    return history.clean_plays(bundle, spec).select("occasion_id", "item_id", "position")


@query("f8_null_safe_exclusion", """SELECT o_orderkey AS occasion_id FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'""")
def null_safe_exclusion(spark, sf_dir):
    bundle = Bundle(bind.plays(spark, sf_dir), bind.calendar(spark, sf_dir))
    return history.counted_occasions(bundle, PRESETS["keyed_with_exclusions"]).select("occasion_id")


@query("f9_not_null_key", """SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000
WHERE c_custkey IS NOT NULL""")
def not_null_key(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey")
    joined = table(spark, sf_dir, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.dropna(subset=["c_custkey"]).select("o_orderkey")


@query("f10_partition_key", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def partition_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")


@query("f11_past_and_future", """SELECT o_orderkey AS occasion_id, CASE WHEN CAST(o_orderdate AS DATE) < DATE '2000-06-15'
  THEN 'past' ELSE 'future' END AS side FROM orders""")
def past_and_future(spark, sf_dir):
    occasions = bind.calendar(spark, sf_dir)
    past = cal.past_occasions(occasions, "2000-06-15").select("occasion_id", F.lit("past").alias("side"))
    future = cal.future_occasions(occasions, "2000-06-15").select("occasion_id", F.lit("future").alias("side"))
    return past.unionByName(future)


@query("f12_up_to_first_future", """SELECT o_orderkey AS occasion_id FROM orders WHERE CAST(o_orderdate AS DATE) <=
  (SELECT min(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderdate >= DATE '2000-06-15')""")
def up_to_first_future(spark, sf_dir):
    return cal.up_to_first_future(bind.calendar(spark, sf_dir), "2000-06-15").select("occasion_id")


@query("f13_between_days", """SELECT o_orderkey AS occasion_id FROM orders
WHERE CAST(o_orderdate AS DATE) > DATE '1999-01-01' AND CAST(o_orderdate AS DATE) < DATE '1999-07-01'""")
def between_days(spark, sf_dir):
    day = F.col("occ_date")
    return bind.calendar(spark, sf_dir).where((day > "1999-01-01") & (day < "1999-07-01")).select("occasion_id")


@query("f14_membership", """SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent FROM orders
WHERE o_orderstatus NOT IN ('P')""")
def membership(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(~F.col("o_orderstatus").isin("P"))
    return orders.select("o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgent"))


@query("f15_no_pattern", "SELECT doc_id, source FROM documents WHERE NOT regexp_matches(text, 'http|@|[0-9]{3}')")
def no_pattern(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~F.col("text").rlike("|".join(["http", "@", "[0-9]{3}"]))).select(
        "doc_id", "source")


@query("f16_year_in_key", """SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y%m%d') LIKE '%2001%'
  OR strftime(o_orderdate, '%Y%m%d') LIKE '%2000%'""")
def year_in_key(spark, sf_dir):
    key = F.date_format(F.to_date("o_orderdate"), "yyyyMMdd")
    return table(spark, sf_dir, "orders").where(key.rlike("2001|2000")).select("o_orderkey")


# --- joins -------------------------------------------------------------------------------------------------------


@query("j1_plays_with_occasions", f"""WITH {PLAYS}, {DATED} SELECT occasion_id, item_id, position, occ_seq,
  strftime(occ_date, '%Y-%m-%d') AS occ_date FROM plays LEFT JOIN occ USING (occasion_id)""")
def plays_with_occasions(spark, sf_dir):
    spec = PRESETS["named_by_date"]
    return history.dated_plays(bind.dated_bundle(spark, sf_dir), spec).select(
        "occasion_id", "item_id", "position", "occ_seq", "occ_date")


@query("j2_plays_with_items", f"""WITH {PLAYS}, {ITEMS} SELECT occasion_id, item_id, item, is_original
FROM plays LEFT JOIN items USING (item_id)""")
def plays_with_items(spark, sf_dir):
    return bind.plays(spark, sf_dir).join(bind.items(spark, sf_dir), "item_id", "left").select(
        "occasion_id", "item_id", "item", "is_original")


SEQ_DATES = f"""WITH {PLAYS}, {NUMBERED}, s AS (SELECT item_id, min(occ_seq) AS debut, max(occ_seq) AS last_played
  FROM plays JOIN occ USING (occasion_id) GROUP BY item_id)"""


@query("j3_debut_and_last_date", f"""{SEQ_DATES} SELECT item_id, strftime(a.occ_date, '%Y-%m-%d') AS debut_date,
  strftime(b.occ_date, '%Y-%m-%d') AS ltp_date FROM s LEFT JOIN occ a ON a.occ_seq = debut
  LEFT JOIN occ b ON b.occ_seq = last_played""")
def debut_and_last_date(spark, sf_dir):
    numbered = bind.numbered_occasions(spark, sf_dir).select("occasion_id", "occ_seq", "occ_date")
    return bind.plays(spark, sf_dir).join(numbered, "occasion_id").groupBy("item_id").agg(
        F.min_by("occ_date", "occ_seq").alias("debut_date"), F.max_by("occ_date", "occ_seq").alias("ltp_date"))


@query("j4_last_date", f"""{SEQ_DATES} SELECT item_id, strftime(occ_date, '%Y-%m-%d') AS ltp_date
FROM s LEFT JOIN occ ON occ_seq = last_played""")
def last_date(spark, sf_dir):
    numbered = bind.numbered_occasions(spark, sf_dir).select("occasion_id", "occ_seq", "occ_date")
    return bind.plays(spark, sf_dir).join(numbered, "occasion_id").groupBy("item_id").agg(
        F.max_by("occ_date", "occ_seq").alias("ltp_date"))


@query("j5_two_catalogs", """SELECT p_partkey AS item_id, p_name AS item, times_played FROM part
JOIN (SELECT l_partkey, count(*) AS times_played FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def two_catalogs(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("item_id")).agg(F.count("*").alias("times_played"))
    return bind.items(spark, sf_dir).join(counted, "item_id").select("item_id", "item", "times_played")


@query("j6_occasions_with_venues", f"""WITH {DATED}, {VENUES} SELECT occasion_id, strftime(occ_date, '%Y-%m-%d') AS occ_date,
  venue, city, state, country FROM occ JOIN venues USING (venue_id)""")
def occasions_with_venues(spark, sf_dir):
    return bind.calendar(spark, sf_dir).join(bind.venues(spark, sf_dir), "venue_id").select(
        "occasion_id", "occ_date", "venue", "city", "state", "country")


@query("j7_plays_with_notes", """SELECT l_orderkey AS occasion_id, l_linenumber AS note_key, l_partkey AS item_id, text AS detail
FROM lineitem LEFT JOIN conversations ON conv_id = l_orderkey AND turn = l_linenumber""")
def plays_with_notes(spark, sf_dir):
    plays = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("occasion_id"), F.col("l_linenumber").cast("long").alias("note_key"),
        F.col("l_partkey").alias("item_id"))
    details = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("occasion_id"), F.col("turn").alias("note_key"), F.col("text").alias("detail"))
    return notes.attach_notes(plays, details, ["occasion_id", "note_key"])


def _occasion_notes(spark, sf_dir):
    """All turns of a conversation as the note of its occasion."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("occasion_id"), "turn", "text")
    return notes.concat_notes(turns, ["occasion_id"], ["turn"], "text", "occasion_notes")


@query("j8_plays_with_occasion_notes", """SELECT l_orderkey AS occasion_id, l_partkey AS item_id, text AS occasion_notes
FROM lineitem LEFT JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)
  ON conv_id = l_orderkey""")
def plays_with_occasion_notes(spark, sf_dir):
    per_occasion = _occasion_notes(spark, sf_dir)
    return bind.plays(spark, sf_dir).select("occasion_id", "item_id").join(per_occasion, "occasion_id", "left")


@query("j9_group_extremes", """SELECT l_orderkey AS occasion_id, l_linenumber AS position, l_partkey AS item_id,
  min(l_linenumber) OVER (PARTITION BY l_orderkey) AS min_set, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS max_set
FROM lineitem""")
def group_extremes(spark, sf_dir):
    plays = bind.plays(spark, sf_dir).select("occasion_id", "position", "item_id")
    return ordered.whole_group(plays, ["occasion_id"], min_set=F.min("position"), max_set=F.max("position"))


@query("j10_occasions_with_counts", """SELECT o_orderkey AS occasion_id, n_items FROM orders LEFT JOIN
  (SELECT l_orderkey, max(l_linenumber) AS n_items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def occasions_with_counts(spark, sf_dir):
    counts = enrich.items_per_occasion(bind.plays(spark, sf_dir))
    return bind.calendar(spark, sf_dir).join(counts, "occasion_id", "left").select("occasion_id", "n_items")


@query("j11_unseen_keys", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unseen_keys(spark, sf_dir):
    return sets.not_in(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("j12_footnote_references", """WITH refs AS (SELECT conv_id, turn, unnest([turn + 1, turn - 1]) AS ref,
  unnest([0, 1]) AS pos FROM conversations),
t AS (SELECT refs.conv_id, refs.turn, string_agg(coalesce(c.text, ''), ' ' ORDER BY pos) AS footnote FROM refs
  LEFT JOIN conversations c ON c.conv_id = refs.conv_id AND c.turn = refs.ref GROUP BY 1, 2)
SELECT conv_id, turn, trim(footnote) AS footnote FROM t""")
def footnote_references(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    cited = turns.select("conv_id", "turn", F.array(F.col("turn") + 1, F.col("turn") - 1).alias("refs"))
    details = turns.select("conv_id", F.col("turn").alias("ref"), "text")
    return notes.resolve_references(
        cited, "refs", details, ["conv_id"], "ref", "text", "footnote"
    ).select("conv_id", "turn", "footnote")


@query("j13_occasions_without_plays", """SELECT o_orderkey AS occasion_id FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def occasions_without_plays(spark, sf_dir):
    return sets.missing_plays(bind.calendar(spark, sf_dir).select("occasion_id"), bind.plays(spark, sf_dir))


# --- sorts, limits, sets -----------------------------------------------------------------------------------------


@query("o1_sort_nulls_last", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def sort_nulls_last(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(
        F.desc_nulls_last("c_acctbal"), "c_custkey")


@query("o2_sort_mixed", """SELECT o_orderkey, o_orderpriority FROM orders
ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey""")
def sort_mixed(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderpriority", "o_orderkey").select(
        "o_orderkey", "o_orderpriority")


@query("o6_top_rows", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def top_rows(spark, sf_dir):
    return sets.top_n(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"),
                      [F.desc("p_retailprice"), F.asc("p_partkey")], 50)


@query("o7_first_and_last_row", """SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key,
  arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders""")
def first_and_last_row(spark, sf_dir):
    order = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").agg(
        F.min_by("o_orderkey", order).alias("first_key"), F.max_by("o_orderkey", order).alias("last_key"))


@query("u1_union_all", """SELECT s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer""")
def union_all(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    return sets.union_all(suppliers, customers)


@query("u2_distinct_rows", "SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus").distinct()


@query("u3_keep_first_of_key", """SELECT c_nationkey, c_mktsegment, c_custkey, c_acctbal FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) = 1""")
def keep_first_of_key(spark, sf_dir):
    return sets.keep_first(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"],
                           ["c_acctbal", "c_custkey"]).select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")


@query("u4_difference_of_keys", """SELECT DISTINCT l_partkey AS item_id FROM lineitem WHERE l_partkey NOT IN
  (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)""")
def difference_of_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    other = lines.where("l_returnflag = 'R' AND l_discount > 0.08").select(F.col("l_partkey").alias("item_id"))
    return sets.not_in(lines.select(F.col("l_partkey").alias("item_id")).distinct(), other, ["item_id"])


# --- occasion enrichment -----------------------------------------------------------------------------------------


@query("c11_enriched_occasions", """WITH v AS (SELECT o_orderkey AS occasion_id, CAST(o_orderdate AS DATE) AS d,
  upper(c_name || ' ' || CAST(floor(c_acctbal / 100) AS INTEGER) || '.' || c_nationkey % 10 || CASE WHEN c_nationkey > 12 THEN 'FM' ELSE '' END
    || CASE WHEN c_mktsegment = 'BUILDING' THEN ' studio' ELSE ' HALL' END) AS venue_full
  FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id)
SELECT occasion_id, venue_full, CASE WHEN d < DATE '2000-06-15' THEN coalesce(n_items, 0) ELSE 0 END AS n_items,
  CASE WHEN d < DATE '2000-06-15' THEN coalesce(t, '') ELSE '' END AS occasion_notes,
  CASE WHEN regexp_matches(venue_full, '\\b\\d+\\.\\d+FM\\b') OR regexp_matches(venue_full, '\\b\\d+\\.\\d\\b')
    OR venue_full LIKE '% STUDIO%' OR venue_full LIKE '% RECORD%' THEN 1 ELSE 0 END AS is_radio,
  CASE WHEN d < DATE '2000-06-15' AND coalesce(t LIKE '%[Soundcheck; %', false) THEN 1 ELSE 0 END AS is_soundcheck,
  CASE WHEN d < DATE '2000-06-15' AND coalesce(lower(t) LIKE '%opened for%', false) THEN 1 ELSE 0 END AS is_opening_act,
  CASE WHEN d < DATE '2000-06-15' THEN 0 ELSE 1 END AS is_future, strftime(d, '%A') AS weekday
FROM v LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n_items FROM lineitem GROUP BY 1) ON l_orderkey = occasion_id
LEFT JOIN n ON conv_id = occasion_id""")
def enriched_occasions(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("venue_id"),
        F.upper(F.concat(
            "c_name", F.lit(" "), F.floor(F.col("c_acctbal") / 100).cast("int").cast("string"), F.lit("."),
            (F.col("c_nationkey") % 10).cast("string"), F.when(F.col("c_nationkey") > 12, "FM").otherwise(""),
            F.when(F.col("c_mktsegment") == "BUILDING", " studio").otherwise(" HALL"),
        )).alias("venue_full"))
    occasions = bind.calendar(spark, sf_dir).join(customers, "venue_id").select("occasion_id", "occ_date", "venue_full")
    return enrich.enrich_occasions(occasions, bind.plays(spark, sf_dir), "2000-06-15", _occasion_notes(spark, sf_dir)).drop("occ_date")


@query("c12_set_numbers", """WITH s AS (SELECT l_orderkey AS occasion_id, l_linenumber AS position, l_partkey AS item_id,
  CASE WHEN l_linenumber > 5 THEN 99 WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_linenumber - 1 END AS n FROM lineitem),
m AS (SELECT *, min(n) OVER (PARTITION BY occasion_id) AS mn, max(n) OVER (PARTITION BY occasion_id) AS mx FROM s)
SELECT occasion_id, position, item_id, CASE WHEN n = 0 AND mn = 0 AND mx IN (99, 0) THEN 1 ELSE n END AS set_no FROM m""")
def set_numbers(spark, sf_dir):
    plays = bind.plays(spark, sf_dir).select(
        "occasion_id", "position", "item_id",
        F.when(F.col("position") > 5, "E").when(F.col("occasion_id") % 3 == 0, "0")
        .otherwise((F.col("position") - 1).cast("string")).alias("set_label"))
    return enrich.renumber_sets(plays).select("occasion_id", "position", "item_id", "set_no")


@query("c16_calendar", """WITH o AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d, o_custkey FROM orders),
own AS (SELECT * FROM o WHERE o_orderpriority <> '5-LOW'),
chosen AS (SELECT * FROM own WHERE d < DATE '2000-06-15' UNION ALL
  (SELECT * FROM own WHERE d >= DATE '2000-06-15' ORDER BY d, o_orderkey LIMIT 1))
SELECT o_orderkey AS occasion_id, strftime(d, '%Y-%m-%d') AS occ_date, o_custkey AS venue_id,
  row_number() OVER (ORDER BY d, o_orderkey) AS occ_seq FROM chosen""")
def calendar_occasions(spark, sf_dir):
    return cal.calendar_occasions(_chosen(spark, sf_dir))


@query("c16_calendar_venues", """WITH o AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d, o_custkey FROM orders),
own AS (SELECT * FROM o WHERE o_orderpriority <> '5-LOW'),
chosen AS (SELECT * FROM own WHERE d < DATE '2000-06-15' UNION ALL
  (SELECT * FROM own WHERE d >= DATE '2000-06-15' ORDER BY d, o_orderkey LIMIT 1))
SELECT DISTINCT o_custkey AS venue_id, c_name AS venue, c_mktsegment AS city FROM chosen JOIN customer ON o_custkey = c_custkey""")
def calendar_venues(spark, sf_dir):
    return cal.calendar_venues(_chosen(spark, sf_dir))


def _chosen(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("venue_id"), F.col("c_name").alias("venue"), F.col("c_mktsegment").alias("city"))
    priorities = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("occasion_id"), "o_orderpriority")
    landed = bind.calendar(spark, sf_dir).join(priorities, "occasion_id").join(customers, "venue_id")
    return cal.chosen_occasions(landed, "2000-06-15", partition=F.col("o_orderpriority") != "5-LOW")
