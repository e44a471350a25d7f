from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from gapkit.plans import history, rankings, state as gap_state
from gapkit.spec import PRESETS
from test_rankings import AS_OF, bundle_of, collected, make


def _spec(preset):
    return PRESETS[preset].with_options(
        title_case=False, history_blacklist=("i2",), result_blacklist=("i4", "name 5"), rotation_date_format=None, window_days=100, min_plays=3, min_current_gap=-2)


@pytest.mark.parametrize("preset", sorted(PRESETS))
def test_state_and_increment_equal_the_full_run_on_every_split(spark, preset, monkeypatch):
    monkeypatch.setattr(history, "seq_bucket", lambda c: F.floor(F.col(c) / 9))
    spec = _spec(preset)
    plays, occasions, items = make(5, n_occasions=14, n_items=6)
    occasions = {k: (s, AS_OF - timedelta(days=21 * (14 - k)), e) for k, (s, _, e) in occasions.items()}
    bundle = bundle_of(spark, plays, occasions, items)
    bundle = type(bundle)(*(None if t is None else t.coalesce(1) for t in (bundle.plays, bundle.occasions, bundle.items)))
    want = collected(rankings.overdue(bundle, spec, AS_OF)), collected(rankings.rotation(bundle, spec, AS_OF))
    assert want[0] and want[1]
    before, last_rotation = None, max(s for s, d, _ in occasions.values() if d <= AS_OF - timedelta(days=100))
    for cut in range(0, 15, 1 if preset == "keyed_with_repeats" else 7):
        # every state is made from the one before, and read back as stored rows are
        state = gap_state.close(bundle, spec, cut, before)
        before = gap_state.GapState(cut, *(spark.createDataFrame(t.collect(), t.schema) for t in (state.histogram, state.tails)))
        assert collected(gap_state.overdue_from(before, bundle, spec, AS_OF)) == want[0], cut
        if cut <= last_rotation:
            assert collected(gap_state.rotation_from(before, bundle, spec, AS_OF)) == want[1], cut


def test_state_is_stored_in_versions_and_reads_the_increment_only(spark, tmp_path):
    spec, path = _spec("keyed_with_repeats"), str(tmp_path / "state")
    plays, occasions, items = make(7, n_occasions=40)
    bundle = bundle_of(spark, plays, occasions, items)
    assert gap_state.load(spark, path) is None
    first = gap_state.store(gap_state.close(bundle, spec, 10), path)
    assert first.cut == 10 and gap_state.load(spark, path).cut == 10
    # plays up to the state's cut are not read: they are not there
    later = bundle_of(spark, [p for p in plays if p[0] > 10], occasions, items)
    second = gap_state.store(gap_state.close(later, spec, 30, gap_state.load(spark, path)), path)
    rest = bundle_of(spark, [p for p in plays if p[0] > 30], occasions, items)
    assert second.cut == 30
    assert collected(gap_state.overdue_from(second, rest, spec, AS_OF)) == collected(rankings.overdue(bundle, spec, AS_OF))


def test_what_a_state_cannot_answer_is_refused(spark):
    spec = _spec("named_by_date")
    bundle = bundle_of(spark, *make(3, n_occasions=30))
    state = gap_state.close(bundle, spec, 30)
    with pytest.raises(ValueError, match="inside the window"):
        gap_state.rotation_from(state, bundle, spec, date(2022, 6, 1))
    with pytest.raises(ValueError, match="closed up to"):
        gap_state.close(bundle, spec, 20, state)
    with pytest.raises(ValueError, match="each group"):
        gap_state.close(bundle, spec.with_options(group=("g",)), 20)
    assert gap_state.cut_before(bundle, spec, "1990-01-01") == 0


def test_a_state_reads_the_plays_in_one_pass(spark, tmp_path):
    spec = _spec("keyed_with_repeats")
    bundle = bundle_of(spark, *make(6, n_occasions=30))
    first = gap_state.store(gap_state.close(bundle, spec, 12), str(tmp_path / "s"))
    both = gap_state.close(bundle, spec, 20, first)
    # the calendar tells which plays are read, and last points come from the exchange of the points
    assert "LeftSemi" not in both.histogram._jdf.queryExecution().optimizedPlan().toString()
    table = both.histogram.withColumn("tail_seq", F.lit(None).cast("long")).unionByName(both.tails, allowMissingColumns=True)
    table.collect()
    final = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("REPARTITION_BY_COL") == 2, final
    # closed rows, which are folded, are not folded again
    ranked = gap_state.overdue_from(both, bundle, spec, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    above = ranked[:ranked.index("Union")]
    assert above.count("Aggregate") == 2, above  # the last number and the statistics
