import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from gapkit.operators import enrich, lookups, notes, sets
from gapkit.plans import calendar as cal, reports

AS_OF = date(2024, 6, 1)


def calendar(spark, days):
    data = [(i, d) for i, d in enumerate(days, 1)]
    return spark.createDataFrame(data, "occasion_id int, occ_date string").withColumn("occ_date", F.to_date("occ_date"))


def ids(df):
    return sorted(r.occasion_id for r in df.collect())


def test_past_and_next(spark):
    several = calendar(spark, ["2024-05-01", "2024-06-01", "2024-07-01", "2024-06-01", None])
    assert ids(cal.past_and_next(several, AS_OF, ["occasion_id"])) == [1, 2]
    assert ids(cal.past_and_next(calendar(spark, ["2024-05-01"]), AS_OF, ["occasion_id"])) == [1]
    assert ids(cal.past_and_next(calendar(spark, ["2024-06-02"]), AS_OF, ["occasion_id"])) == [1]


def test_up_to_first_future_and_undated(spark):
    with_future = calendar(spark, ["2024-05-01", None, "2024-07-01", "2024-07-01", "2024-08-01"])
    without = calendar(spark, ["2024-05-01", None])
    assert ids(cal.up_to_first_future(with_future, AS_OF)) == [1, 3, 4]
    assert ids(cal.up_to_first_future(without, AS_OF)) == [1, 2]
    assert ids(cal.up_to_first_future(with_future, AS_OF, undated="keep")) == [1, 2, 3, 4]
    assert ids(cal.up_to_first_future(without, AS_OF, undated="drop")) == [1]


def test_next_occasion(spark):
    occasions = calendar(spark, ["2024-06-05", "2024-06-01"]).withColumn("venue_id", F.col("occasion_id"))
    venues = spark.createDataFrame([(1, "Hall")], "venue_id int, venue string")
    today = cal.next_occasion(occasions, AS_OF, venues).first()
    assert (today.occasion_id, today.venue, today.days_until) == (2, None, 0)
    later = cal.next_occasion(occasions, AS_OF, venues, include_today=False).first()
    assert (later.occasion_id, later.venue, later.days_until) == (1, "Hall", 4)
    assert cal.next_occasion(occasions, date(2025, 1, 1), venues).count() == 0


def test_build_calendar(spark):
    landed = spark.createDataFrame(
        [(7, "2024-01-03", 1, "V1", 1, "t", 1, "us"), (5, "2024-01-02", 2, "V2", None, None, 2, "us"),
         (6, "2024-01-02", 2, "V2", None, None, 1, "us"), (8, "2024-01-01", 3, "V3", 1, "t", 1, "other"),
         (9, "2024-07-01", 4, "V4", 2, "u", 1, "us"), (10, "2024-08-01", 5, "V5", 2, "u", 1, "us")],
        "occasion_id int, occ_date string, venue_id int, venue string, tour_id int, tour_name string, occ_order int, who string",
    ).withColumn("occ_date", F.to_date("occ_date"))
    built = cal.build_calendar(landed, AS_OF, partition=F.col("who") == "us")
    assert [(r.occasion_id, r.occ_seq) for r in built["occasions"].orderBy("occ_seq").collect()] == [
        (6, 1), (5, 2), (7, 3), (9, 4)]
    assert [r.venue for r in built["venues"].collect()] == ["V1", "V2", "V4"]
    # another performer plays earlier: each has a next occasion
    other = landed.withColumn("who", F.when(F.col("occasion_id") == 9, "other").otherwise(F.col("who")))
    for who, last in (("us", 10), ("other", 9)):
        mine = cal.build_calendar(other, AS_OF, partition=F.col("who") == who)["occasions"]
        assert mine.orderBy(F.desc("occ_seq")).first().occasion_id == last
    assert [(r.tour_id, r.tour_name) for r in built["tours"].collect()] == [(None, None), (1, "t"), (2, "u")]


def test_corrections(spark):
    places = spark.createDataFrame(
        [("ADAMS CENTER", "X", "MT"), ("ADAMS CENTER", "X", "GA"), ("FLEET PAVILION", "BOSTON", "MA"),
         ("CAESAR'S TAHOE SHOWROOM", "STATELINE", "NV"), ("CAESAR'S TAHOE", "STATELINE", "NV"),
         ("23 EAST CABARET", "ARDMORE", "PA"), ("23 EAST CABARET", "ARDMORE", "NJ"), ("HALL", "N. LITTLE ROCK", "AR")],
        "venue string, city string, state string")
    got = [tuple(r) for r in lookups.correct_venue_and_city(places).collect()]
    assert got == [
        ("ADAMS FIELDHOUSE, UNIVERSITY OF MONTANA", "X", "MT"), ("ADAMS CENTER", "X", "GA"),
        ("CAESAR'S TAHOE", "BOSTON", "MA"),  # the city rule looks at the original venue
        ("CAESAR'S TAHOE", "STATELINE", "NV"), ("CAESAR'S TAHOE", "LAKE TAHOE", "NV"),
        ("23 EAST CABARET", "PHILADELPHIA", "PA"), ("23 EAST CABARET", "ARDMORE", "NJ"), ("HALL", "LITTLE ROCK", "AR")]


def test_two_key_correction_and_override(spark):
    places = spark.createDataFrame([("a", "S", "C"), ("a", "T", "C"), ("b", "T", "D")], "venue string, state string, city string")
    rules = spark.createDataFrame([("a", "S", None, "by state"), ("a", None, "C", "by city")],
                                  "venue string, state string, city string, new_venue string")
    assert sorted(r.venue for r in lookups.correct_place(places, rules).collect()) == ["b", "by city", "by state"]
    links = spark.createDataFrame([("d1", "v", "l1"), ("d2", "v", "l2"), ("d3", "v", "l3")], "d string, v string, link string")
    special = spark.createDataFrame([("d2", "v", "special"), ("d3", "v", "NODATA")], "d string, v string, link string")
    assert sorted(r.link for r in lookups.override_keys(links, special, ["d", "v"], "link").collect()) == ["l1", "special"]


def test_enrichment_flags(spark):
    df = spark.createDataFrame(
        [("WXRT 93.1FM", "[Soundcheck; x]"), ("KFOG 104.5", "Opened For Y"), ("BIG STUDIO", None), ("HALL", "soundcheck"), (None, "")],
        "v string, n string")
    got = [tuple(r) for r in df.select(
        enrich.is_radio(F.col("v")), enrich.is_soundcheck(F.col("n")), enrich.is_opening_act(F.col("n"))).collect()]
    assert got == [(1, 1, 0), (1, 0, 1), (1, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_enriched_occasions(spark):
    occasions = calendar(spark, ["2024-05-31", "2024-06-01"]).withColumn("venue_full", F.lit("HALL"))
    plays = spark.createDataFrame([(1, 4), (1, 2), (2, 9)], "occasion_id int, position int")
    texts = spark.createDataFrame([(1, "opened for X")], "occasion_id int, occasion_notes string")
    got = enrich.enrich_occasions(occasions, plays, AS_OF, texts).orderBy("occasion_id").collect()
    assert [(r.n_items, r.is_opening_act, r.is_future, r.weekday) for r in got] == [(4, 1, 0, "Friday"), (0, 0, 1, "Saturday")]


def test_set_numbers(spark):
    data = [(1, "0"), (1, "E"), (2, "0"), (2, "1"), (3, "0"), (4, "1"), (4, "E")]
    df = spark.createDataFrame(data, "occasion_id int, set_label string")
    got = sorted((r.occasion_id, r.set_no) for r in enrich.renumber_sets(df).collect())
    assert got == [(1, 1), (1, 99), (2, 0), (2, 1), (3, 1), (4, 1), (4, 99)]


def test_references_keep_their_order(spark):
    plays = spark.createDataFrame([(1, 1, ["2", "1"]), (1, 2, []), (2, 1, ["9"])], "o int, p int, refs array<string>")
    details = spark.createDataFrame([(1, "1", "one"), (1, "2", "two")], "o int, ref string, t string")
    got = notes.resolve_references(plays, "refs", details, ["o"], "ref", "t", "note").orderBy("o", "p")
    assert [r.note for r in got.collect()] == ["two one", "", ""]


def test_missing_plays_and_freshness(spark):
    occasions = calendar(spark, ["2024-01-01", "2024-01-02"])
    plays = spark.createDataFrame([(1,)], "occasion_id int")
    assert ids(sets.missing_plays(occasions, plays)) == [2]
    names = spark.createDataFrame([("a",), ("b",)], "source string")
    stamps = spark.createDataFrame([("a", "2024-01-01T00:00:00")], "source string, last_updated string")
    assert {r.source: r.last_updated for r in reports.freshness(stamps, names).collect()} == {
        "a": "2024-01-01T00:00:00", "b": "Unknown"}


def test_linked_calendar(spark):
    schedules = spark.createDataFrame(
        [(1999, "12/30/99 Adams Center, Missoula, MT 12/31/99 Adams Center, Missoula, MT ??/??/99 X, A, GA"),
         (2024, "01/05/24 X, A, GA 07/01/24 Y, B, GA 07/01/24 Y, B, GA 08/01/24 Z, C, GA")],
        "list_year int, text string")
    got = cal.linked_calendar(schedules, AS_OF).orderBy("occ_seq").collect()
    assert [(r.occasion_id, r.occ_seq, r.seq_in_year, r.run_index, r.venue) for r in got] == [
        ("19991230a", 1, 1, 1, "ADAMS FIELDHOUSE, UNIVERSITY OF MONTANA"),
        ("19991231a", 2, 2, 1, "ADAMS FIELDHOUSE, UNIVERSITY OF MONTANA"),
        ("20240105a", 4, 1, 2, "X"), ("20240701a", 5, 2, 3, "Y"), ("20240701b", 6, 3, 3, "Y")]


def test_linked_calendar_over_many_buckets_deals_its_rows_out_twice(spark, monkeypatch):
    rng = random.Random(8)
    schedules = [(year, " ".join(f"01/{rng.randint(1, 9):02}/{year % 100:02} {rng.choice('AB')}, X, GA" for _ in range(7)))
                 for year in range(1990, 2000)] + [(None, "01/01/92 A, X, GA ??/??/92 A, X, GA")]
    df = spark.createDataFrame(schedules, "list_year int, text string")
    whole = cal.linked_calendar(df, AS_OF)
    want = sorted(map(tuple, whole.collect()), key=repr)
    assert len(want) == 72
    with monkeypatch.context() as m:
        m.setattr(cal, "seq_bucket", lambda c: F.floor(F.col(c) / 5))
        m.setattr("gapkit.operators.runs.SEQ_BUCKET", 4)
        assert sorted(map(tuple, cal.linked_calendar(df, AS_OF).collect()), key=repr) == want
    # the rows go once by day and once by number; the third such step, by year, is gone
    plan = cal.linked_calendar(df, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    dealt = {line.split("RepartitionByExpression ")[1].split("]")[0].count("#") for line in plan.splitlines() if "RepartitionByExpression" in line}
    assert dealt == {1, 2} and plan.count("list_year") and "Window [row_number() windowspecdefinition(list_year" not in plan


@pytest.mark.parametrize("today", [True, False])
def test_next_occasions_of_all_groups_and_days(spark, today, monkeypatch):
    monkeypatch.setattr(cal, "seq_bucket", lambda c: F.floor(F.col(c) / 5))
    rng = random.Random(4)
    start = date(2024, 1, 1)
    occasions = [(rng.choice("abc"), start + timedelta(days=rng.randint(0, 60)) if i % 9 else None, i) for i in range(60)]
    days = [(rng.choice(["a", "b", "d", None]), start + timedelta(days=rng.randint(-5, 65)) if i % 11 else None, f"row {i}") for i in range(80)]
    got = cal.next_occasions(
        spark.createDataFrame(days * 2, "g string, day date, payload string"),
        spark.createDataFrame(occasions, "g string, occ_date date, occasion_id int"), ["g"], include_today=today).collect()
    want = []
    for g, day, payload in days:
        ahead = [(d, i) for h, d, i in occasions if h == g and d is not None and day is not None and (d >= day if today else d > day)]
        d, i = min(ahead, default=(None, None))
        want.append((g, day, payload, d, i, d and (d - day).days))
    assert sorted(map(tuple, got), key=repr) == sorted(want * 2, key=repr) and any(w[3] for w in want)
