import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from brute import rankings as brute_rankings
from gapkit.plans import history, rankings, reports
from gapkit.spec import PRESETS, Bundle, GapSpec

AS_OF = date(2024, 6, 1)
PLAYS = "occasion_id int, item_id string, position int, is_repeat int, is_original int"
OCCASIONS = "occasion_id int, occ_seq int, occ_date date, exclude_from_stats int"


def make(seed, n_occasions=120, n_items=12):
    rng = random.Random(seed)
    start = AS_OF - timedelta(days=900)
    occasions = {i: (i, start + timedelta(days=7 * i), rng.choice([None, 0, 0, 1])) for i in range(1, n_occasions + 1)}
    plays = []
    for i in occasions:
        names = [f"i{rng.randint(0, n_items)}" for _ in range(6)] + (["i0"] if i % 2 else [])
        rng.shuffle(names)
        for pos, name in enumerate(names, 1):
            plays.append((i, name, pos, int(name in names[:pos - 1]) if rng.random() < 0.8 else 1, rng.choice([0, 1, 1])))
    plays += [(9999, "i1", 1, 0, 1), (5, None, 9, 0, 1), (6, "unknown", 8, 0, 1)]
    items = {f"i{k}": (f"name {k % 8}", None if k == 3 else k % 3 and 1) for k in range(n_items + 1)}
    return plays, occasions, items


def bundle_of(spark, plays, occasions, items):
    return Bundle(
        spark.createDataFrame(plays, PLAYS),
        spark.createDataFrame([(k, s, d, e) for k, (s, d, e) in occasions.items()], OCCASIONS),
        spark.createDataFrame([(k, n, f) for k, (n, f) in items.items()], "item_id string, item string, is_original int"),
    )


def collected(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("preset", sorted(PRESETS))
@pytest.mark.parametrize("seed", [1, 2])
def test_rankings_match_brute_force(spark, preset, seed, monkeypatch):
    spec = PRESETS[preset].with_options(
        title_case=False, history_blacklist=("i2",), result_blacklist=("i4", "name 5"), rotation_date_format=None)
    # narrow buckets, so that items cross many bucket edges
    monkeypatch.setattr(history, "seq_bucket", lambda c: F.floor(F.col(c) / 9))
    plays, occasions, items = make(seed)
    counted = {k: (s, d) for k, (s, d, e) in occasions.items() if not (spec.exclude_flagged and e == 1)}
    top = max(s for s, _ in counted.values())
    last = {"max": top, "max_minus_one": top - 1, "max_played": top}[spec.last_seq]
    dicts = [dict(zip(("occasion_id", "item_id", "position", "is_repeat", "is_original"), p)) for p in plays]
    want = brute_rankings(dicts, counted, items, spec, AS_OF, last)
    bundle = bundle_of(spark, plays, occasions, items)
    assert collected(rankings.overdue(bundle, spec, AS_OF)) == want[0]
    assert collected(rankings.rotation(bundle, spec, AS_OF)) == want[1]
    assert want[0] and want[1]


def test_rotation_shuffles_old_plays_folded(spark):
    """Old plays of an item reach the window as one row."""
    plays, occasions, items = make(3)
    bundle = bundle_of(spark, plays, occasions, items)
    spec = PRESETS["named_by_date"]
    since = F.lit(AS_OF - timedelta(days=30))
    folded = history.play_points(bundle, spec, since)
    full = history.play_points(bundle, spec)
    recent = full.where(F.col("occ_date") > since)
    key = ["item_id", "occ_seq", "prev_seq"]
    assert sorted(collected(folded.select(*key))) == sorted(collected(recent.select(*key)))
    unfolded = history.play_points(bundle, spec.with_options(seq_follows_date=False), since)
    assert sorted(collected(unfolded.select(*key))) == sorted(collected(recent.select(*key)))


def small(spark, plays, n=30):
    days = [(i, i, date(2024, 1, 1) + timedelta(days=i), None) for i in range(1, n + 1)]
    return Bundle(spark.createDataFrame(plays, PLAYS), spark.createDataFrame(days, OCCASIONS))


def test_repeat_before_main_play_takes_the_gap(spark):
    plays = [(1, "a", 1, 0, 1), (4, "a", 1, 1, 1), (4, "a", 2, 0, 1), (9, "a", 3, 0, 1), (9, "a", 7, 1, 1)]
    spec = GapSpec("t", repeat_policy="flag_after")
    got = history.play_history(small(spark, plays), spec).orderBy("occasion_id", "position")
    assert [r.gap for r in got.collect()] == [None, 3, 0, 5, 0]
    stats = rankings.item_stats(small(spark, plays), spec).first()
    assert (stats.n_plays, stats.avg_gap, stats.med_gap) == (3, 2.5, 2.5)
    deduped = history.play_history(small(spark, plays), GapSpec("t")).orderBy("occasion_id")
    assert [(r.position, r.gap) for r in deduped.collect()] == [(1, None), (1, 3), (3, 5)]


def test_history_keeps_plays_without_occasion(spark):
    plays = [(1, "a", 1, 0, 1), (77, "a", 1, 0, 1), (3, "a", 1, 0, 1), (3, None, 2, 0, 1)]
    for policy in ("flag_after", "dedupe_before"):
        got = history.play_history(small(spark, plays), GapSpec("t", repeat_policy=policy)).orderBy("occasion_id")
        assert [(r.occasion_id, r.occ_seq, r.gap) for r in got.collect()] == [(1, 1, None), (3, 3, 2), (77, None, None)]


def test_constant_gap_ranks_by_sign(spark):
    """Zero spread: above the mean first, below it last, equal to it after all."""
    plays = [(i, "even", 1, 0, 1) for i in range(2, 27, 2)] + [(i, "late", 1, 0, 1) for i in range(1, 13)]
    plays += [(i, "now", 1, 0, 1) for i in range(19, 31)]
    spec = GapSpec("t", min_plays=10, active_days=None)
    scores = {r.item: r.gap_zscore for r in rankings.overdue_scores(small(spark, plays, 28), spec, AS_OF).collect()}
    assert scores == {"even": None, "late": float("inf")} or scores["late"] == float("inf")
    ranked = [r.item for r in rankings.overdue(small(spark, plays, 28), spec, AS_OF).collect()]
    assert ranked[0] == "late"


def test_single_play_has_no_statistics(spark):
    stats = rankings.item_stats(small(spark, [(3, "a", 1, 0, 1)]), GapSpec("t")).first()
    assert (stats.n_plays, stats.avg_gap, stats.med_gap, stats.std_gap) == (1, None, None, None)


def test_ties_are_broken_by_name(spark):
    plays = [(i, name, 1, 0, 1) for name in ("b", "a", "c") for i in range(1, 14)]
    spec = GapSpec("t", active_days=None)
    assert [r.item for r in rankings.overdue(small(spark, plays), spec, AS_OF).collect()] == ["a", "b", "c"]
    assert [r.item for r in rankings.rotation(small(spark, plays), spec, AS_OF).collect()] == ["a", "b", "c"]


def test_invariants(spark):
    plays, occasions, items = make(11)
    bundle = bundle_of(spark, plays, occasions, items)
    spec = PRESETS["named_by_date"]
    points = history.play_points(bundle, spec)
    sums = points.groupBy("item_id").agg(
        F.sum(F.col("occ_seq") - F.col("prev_seq")).alias("g"), F.count("prev_seq").alias("k"), F.count("*").alias("n"),
        (F.max("occ_seq") - F.min("occ_seq")).alias("span"))
    for r in sums.collect():
        assert (r.g or 0) == r.span and r.k == r.n - 1
    over = rankings.overdue(bundle, spec, AS_OF).collect()
    assert all(r.times_played_total > 10 for r in over)
    assert len({r.item for r in over}) == len(over)
    rot = rankings.rotation(bundle, spec, AS_OF).collect()
    assert all(r.current_gap > 3 for r in rot)
    counts = [r.times_played_recent for r in rot]
    assert counts == sorted(counts, reverse=True)


def test_last_sequence_policies(spark):
    bundle = small(spark, [(5, "a", 1, 0, 1)], n=10)
    seqs = {p: rankings.last_sequence(bundle, GapSpec("t", last_seq=p), date(2024, 1, 8)).first()[0]
            for p in ("max", "max_minus_one", "max_played", "last_past")}
    assert seqs == {"max": 10, "max_minus_one": 9, "max_played": 5, "last_past": 6}


def test_groups_in_one_plan_equal_single_groups(spark):
    plays, occasions, items = make(5)
    single = bundle_of(spark, plays, occasions, items)
    tagged = Bundle(
        single.plays.withColumn("g", F.explode(F.array(F.lit("x"), F.lit("y")))),
        single.occasions.withColumn("g", F.explode(F.array(F.lit("x"), F.lit("y")))),
    )
    policies = spark.createDataFrame([("x", 10, 400, 100, 3), ("y", 20, None, 366, 1)],
                                     "g string, min_plays int, active_days int, window_days int, min_current_gap int")
    spec = GapSpec("all", group=("g",))
    over, rot = rankings.rank_groups(tagged, spec, policies, AS_OF)
    for g, options in (("x", dict(min_plays=10, active_days=400, window_days=100, min_current_gap=3)),
                       ("y", dict(min_plays=20, active_days=None, window_days=366, min_current_gap=1))):
        alone = GapSpec("one", **options)
        assert collected(over.where(F.col("g") == g).drop("g")) == collected(rankings.overdue(single, alone, AS_OF))
        assert collected(rot.where(F.col("g") == g).drop("g")) == collected(rankings.rotation(single, alone, AS_OF))


def test_run_all_isolates_failures(spark):
    stored = {}

    def broken():
        raise OSError("no files")

    entries = {
        "bad": (GapSpec("bad"), broken),
        "good": (GapSpec("good"), lambda: small(spark, [(1, "a", 1, 0, 1)])),
    }
    outcome = rankings.run_all(entries, AS_OF, lambda name, tables: stored.update({name: sorted(tables)}))
    assert outcome["good"] == "ok" and outcome["bad"].startswith("failed: no files")
    assert stored == {"good": ["overdue", "rotation"]}


def test_spec_checks(spark):
    with pytest.raises(ValueError):
        GapSpec("t", repeat_policy="other")
    with pytest.raises(ValueError):
        GapSpec("t", originals_only=True)
    bundle = small(spark, [(1, "a", 1, 0, 1)])
    with pytest.raises(ValueError, match="items"):
        rankings.overdue(bundle, PRESETS["keyed_with_repeats"], AS_OF)
    with pytest.raises(ValueError, match="plays"):
        Bundle_without = Bundle(bundle.plays.drop("item_id"), bundle.occasions)
        rankings.overdue(Bundle_without, GapSpec("t"), AS_OF)


def test_report_ranks_and_headings(spark):
    plays = [(i, f"i{k:02d}", 1, 0, 1) for k in range(60) for i in range(1, 14)]
    scores = rankings.overdue_scores(small(spark, plays), GapSpec("t", active_days=None), AS_OF)
    report = reports.overdue_report(scores, headings=reports.OVERDUE_HEADINGS)
    assert report.columns == list(reports.OVERDUE_HEADINGS.values())
    rows = report.collect()
    assert [r["Rank"] for r in rows] == list(range(1, 51))
    assert [r["Song"] for r in rows] == [f"i{k:02d}" for k in range(50)]


def test_plans_have_no_cross_join(spark):
    plays, occasions, items = make(1)
    bundle = bundle_of(spark, plays, occasions, items)
    for preset in PRESETS.values():
        for df in (rankings.overdue(bundle, preset, AS_OF), rankings.rotation(bundle, preset, AS_OF)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dealt_points_hold_no_hash_table_and_edges_read_the_plays(spark):
    import re

    from gapkit.plans.history import play_points
    from gapkit.session import prepare
    from gapkit.spec import PRESETS, Bundle

    prepare(spark)
    plays = spark.createDataFrame([(o, f"i{o % 3}", 1, 0) for o in range(60)] * 2, "occasion_id long, item_id string, position int, is_repeat int")
    calendar = spark.range(60).selectExpr("id AS occasion_id", "id * 40000 AS occ_seq", "DATE'2000-01-01' + CAST(id AS int) AS occ_date")
    points = play_points(Bundle(plays, calendar), PRESETS["named_by_link"].with_options(title_case=False, history_blacklist=()))
    found = {(r.item_id, r.occ_seq, r.prev_seq, str(r.occ_date), r.n_plays) for r in points.collect()}
    day = calendar.selectExpr("occ_seq", "CAST(occ_date AS string) d").collect()
    days = {r.occ_seq: r.d for r in day}
    assert found == {(f"i{o % 3}", o * 40000, (o - 3) * 40000 if o > 2 else None, days[o * 40000], 1) for o in range(60)}
    plan = points._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert not re.search(r"HashAggregate\(keys?=\[item_id[^\]]*occ_seq", plan) and len(re.findall(r"SortAggregate\(keys?=\[item_id[^\]]*occ_seq", plan)) == 1


def test_rows_are_dealt_out_once_for_all_their_readers(spark):
    spec = PRESETS["keyed_with_repeats"]
    bundle = bundle_of(spark, *make(9, n_occasions=30))
    found = history.play_history(bundle, spec)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]
    # what orders the plays is made after they were dealt out
    dealt = found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "named_struct" not in dealt.split("Join")[0]


def test_statistics_by_the_ranked_columns_are_not_sampled_for_the_sort(spark):
    bundle = bundle_of(spark, *make(9, n_occasions=30))
    ranking = rankings.overdue(bundle, PRESETS["named_by_date"], AS_OF)
    assert "REPARTITION_BY_COL" in ranking._jdf.queryExecution().executedPlan().toString()
