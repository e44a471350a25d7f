import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from gapkit.sources.tables import write_table
from gapkit.streaming import incremental as inc, streams

AS_OF = date(2024, 6, 1)
SCHEMA = "occasion_id int, item_id string, occ_date string, payload string"


def plays(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumn("occ_date", F.to_date("occ_date"))


@pytest.fixture
def sides(spark):
    existing = plays(spark, [(1, "a", "2022-01-01", "old"), (3, "a", "2024-03-01", "old"), (3, "b", "2024-03-01", "old")])
    incoming = plays(spark, [
        (1, "z", "2022-01-01", "new"),   # late, more than two years back
        (2, "a", "2023-05-01", "new"),   # late, within two years
        (3, "a", "2024-03-01", "new"),   # known key
        (4, "a", "2024-05-01", "new"), (4, "a", "2024-05-01", "other"), (5, "a", "2024-06-01", "new"),
    ])
    return existing, incoming


def keys(df):
    return sorted((r.occasion_id, r.item_id, r.payload) for r in df.collect())


OLD = [(1, "a", "old"), (3, "a", "old"), (3, "b", "old")]


def test_append_misses_late_plays(sides):
    assert keys(inc.append_past_mark(*sides, AS_OF)) == OLD + [(4, "a", "new"), (4, "a", "other")]


def test_append_to_nothing_takes_all_of_the_past(spark, sides):
    empty = plays(spark, [])
    assert len(keys(inc.append_past_mark(empty, sides[1], AS_OF))) == 5


@pytest.mark.parametrize("dedupe", [True, False])
def test_upsert_catches_late_plays_of_two_years(sides, dedupe):
    existing, incoming = sides
    merged = inc.upsert_keep_existing(
        existing, inc.recent_years(incoming, AS_OF), ["occasion_id", "item_id"], ["payload"], dedupe_existing=dedupe)
    assert keys(merged) == [(1, "a", "old"), (2, "a", "new"), (3, "a", "old"), (3, "b", "old"), (4, "a", "new"), (5, "a", "new")]


def test_upsert_matches_null_keys(spark):
    a = plays(spark, [(1, None, "2024-01-01", "old")])
    b = plays(spark, [(1, None, "2024-01-01", "new"), (2, None, "2024-01-01", "new")])
    for dedupe in (True, False):
        merged = inc.upsert_keep_existing(a, b, ["occasion_id", "item_id"], ["payload"], dedupe_existing=dedupe)
        assert [(r.occasion_id, r.payload) for r in merged.orderBy("occasion_id").collect()] == [(1, "old"), (2, "new")]


def test_unseen_occasions(sides):
    assert keys(inc.append_unseen(*sides)) == sorted(
        OLD + [(2, "a", "new"), (4, "a", "new"), (4, "a", "other"), (5, "a", "new")])


def test_method_choice(spark, sides, tmp_path):
    path = str(tmp_path / "plays")
    assert inc.load_method(spark, path) == "all"
    write_table(sides[0], path)
    assert inc.load_method(spark, path, ["occasion_id"]) == "update"
    assert inc.load_method(spark, path, ["other"]) == "all"
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no parquet")
    assert inc.load_method(spark, str(tmp_path / "broken")) == "all"


def land(spark, df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_stream_append_equals_batch(spark, sides, tmp_path):
    existing, incoming = sides
    folder, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    land(spark, incoming, folder)
    stream = streams.read_landed(spark, folder, incoming.schema)
    streams.stream_append(stream, target, progress, AS_OF, existing).awaitTermination()
    stored = streams.stored(spark, target, incoming.schema)
    assert keys(existing.unionByName(stored)) == keys(inc.append_past_mark(existing, incoming, AS_OF))
    # a later file continues from the stored mark
    land(spark, plays(spark, [(6, "q", "2024-05-20", "new"), (7, "q", "2024-04-20", "late")]), folder)
    later = streams.read_landed(spark, folder, incoming.schema)
    streams.stream_append(later, target, progress, AS_OF, existing, run="1").awaitTermination()
    assert (6, "q", "new") in keys(streams.stored(spark, target, incoming.schema))
    assert (7, "q", "late") not in keys(streams.stored(spark, target, incoming.schema))


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_stream_append_of_many_files_equals_batch(spark, sides, tmp_path, parts):
    existing, incoming = sides
    more = plays(spark, [(10 + i, "z", f"2024-05-{20 - i // 2:02d}", "new") for i in range(10)])  # days fall, and two rows share one
    incoming = incoming.unionByName(more)
    folder, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for i in range(parts):
        land(spark, incoming.where(F.pmod("occasion_id", F.lit(parts)) == i), folder)
    stream = streams.read_landed(spark, folder, incoming.schema, files_per_batch=1)
    streams.stream_append(stream, target, progress, AS_OF, existing).awaitTermination()
    stored = streams.stored(spark, target, incoming.schema)
    assert keys(existing.unionByName(stored)) == keys(inc.append_past_mark(existing, incoming, AS_OF))


def test_update_is_stored_twice(spark, sides, tmp_path):
    existing, incoming = sides
    path = str(tmp_path / "plays")
    update = lambda stored: inc.append_past_mark(stored, incoming, AS_OF)
    assert keys(inc.refresh_stored(spark, path, lambda: existing, update, ["occasion_id"])) == OLD
    want = keys(inc.append_past_mark(existing, incoming, AS_OF))
    for _ in range(2):
        assert keys(inc.refresh_stored(spark, path, lambda: existing, update, ["occasion_id"])) == want
    assert inc.load_method(spark, path, ["occasion_id"]) == "update"
    # the current version and the one before it stay
    assert len(list((tmp_path / "plays").glob("version=*"))) == 2
    assert keys(inc.refresh_stored(spark, path, lambda: existing, update, ["occasion_id"])) == want
    assert len(list((tmp_path / "plays").glob("version=*"))) == 2


def test_a_fault_of_the_store_does_not_rebuild(spark, sides, tmp_path, monkeypatch):
    path = str(tmp_path / "plays")
    write_table(sides[0], path)

    def fault(*_):
        raise OSError("connection reset")

    monkeypatch.setattr(inc, "_stored_at", lambda spark, p: p)
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameReader.parquet", fault)
    with pytest.raises(OSError):
        inc.load_method(spark, path)


def test_a_table_is_not_overwritten_by_what_reads_it(spark, sides, tmp_path):
    path = str(tmp_path / "plays")
    write_table(sides[0], path)
    with pytest.raises(ValueError):
        write_table(spark.read.parquet(path).where("occasion_id = 1"), path)
    assert keys(spark.read.parquet(path)) == OLD
    write_table(spark.read.parquet(path), f"{path}2")


def test_undated_rows_of_recent_keys(spark):
    df = plays(spark, [(20240101, "a", None, "x"), (20210101, "a", None, "x"), (1, "a", "2023-01-01", "x"), (2, "a", "2022-12-31", "x"),
                       (3, "a", "2025-01-01", "x"), (4, "a", "2024-12-31", "x")])
    year = F.floor(F.col("occasion_id") / 10000).cast("int")
    assert sorted(r.occasion_id for r in inc.recent_years(df, "2024-06-15").collect()) == [1, 4]
    assert sorted(r.occasion_id for r in inc.recent_years(df, "2024-06-15", key_year=year).collect()) == [1, 4, 20240101]


def test_stream_upsert_equals_batch(spark, sides, tmp_path):
    existing, incoming = sides
    folder, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    by = ["occasion_id", "item_id"]
    for part in (incoming.where("occasion_id < 4"), incoming.where("occasion_id >= 4"), incoming.limit(3)):
        land(spark, part, folder)
        stream = streams.read_landed(spark, folder, incoming.schema, files_per_batch=1)
        streams.stream_upsert(stream, target, progress, by, ["payload"], existing).awaitTermination()
    stored = streams.stored(spark, target, incoming.schema)
    batch = inc.upsert_keep_existing(existing, incoming, by, ["payload"], dedupe_existing=False)
    assert keys(existing.unionByName(stored)) == keys(batch)


def test_repeated_batch_replaces_its_output(spark, sides, tmp_path):
    existing, incoming = sides
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, incoming, folder)
    for attempt in ("p1", "p2"):  # the progress of the first run is lost, as after a failure
        stream = streams.read_landed(spark, folder, incoming.schema)
        streams.stream_upsert(stream, target, str(tmp_path / attempt), ["occasion_id", "item_id"], ["payload"],
                              existing).awaitTermination()
    assert len(keys(streams.stored(spark, target, incoming.schema))) == 4


@pytest.mark.parametrize("form", ["stream_upsert", "stream_upsert_state"])
@pytest.mark.parametrize("own", [True, False])
def test_runs_of_one_target_store_a_key_once(spark, sides, tmp_path, form, own):
    existing, incoming = sides
    folder, target, by = str(tmp_path / "in"), str(tmp_path / "out"), ["occasion_id", "item_id"]
    later = plays(spark, [(4, "a", "2024-05-01", "again"), (8, "a", "2024-05-02", "new"), (1, "z", "2022-01-01", "again")])
    base = str(tmp_path / "base")
    write_table(existing, base)
    for i, part in enumerate((incoming.where("occasion_id < 4"), incoming, later)):
        land(spark, part, folder)
        stream = streams.read_landed(spark, folder, incoming.schema, files_per_batch=1)
        known = streams.read_landed(spark, base, existing.schema) if form == "stream_upsert_state" else existing
        getattr(streams, form)(stream, target, str(tmp_path / (f"p{i}" if own else "p")), by, ["payload"], known).awaitTermination()
    got = keys(streams.stored(spark, target, incoming.schema))
    assert got == [(1, "z", "new"), (2, "a", "new"), (4, "a", "new"), (5, "a", "new"), (8, "a", "new")]


@pytest.mark.parametrize("form", ["stream_append", "stream_upsert", "stream_upsert_state"])
def test_a_start_that_failed_in_a_batch_goes_on(spark, sides, tmp_path, form):
    existing, incoming = sides
    folder, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for n in (5, 4, 1, 2, 3):  # the latest day comes first
        land(spark, incoming.where(F.col("occasion_id") == n), folder)
        time.sleep(1.1)

    def start():
        stream = streams.read_landed(spark, folder, incoming.schema, files_per_batch=1)
        if form == "stream_append":
            return streams.stream_append(stream, target, progress, "2024-06-02", plays(spark, [(0, "a", "2022-06-01", "old")]))
        return getattr(streams, form)(stream, target, progress, ["occasion_id", "item_id"], ["payload"])

    calls = []
    real = streams._Log.begin

    def failing(self, batch_id):
        first = real(self, batch_id)
        calls.append(batch_id)
        if batch_id == 2 and calls.count(2) == 1:
            raise RuntimeError("an executor is gone")
        return first

    streams._Log.begin = failing
    try:
        with pytest.raises(Exception, match="gone"):
            start().awaitTermination()
        start().awaitTermination()
    finally:
        streams._Log.begin = real
    got = {r[:2] for r in keys(streams.stored(spark, target, incoming.schema))}
    want = {(2, "a"), (3, "a"), (4, "a"), (5, "a")} | ({(1, "z")} if form != "stream_append" else set())
    assert got == want and calls.count(2) == 2


def test_a_second_start_has_a_new_mark_and_keeps_what_is_stored(spark, sides, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    rounds = [("p", [(1, "a", "2024-01-05", "1")]), ("p", [(2, "a", "2024-01-03", "late"), (3, "a", "2024-01-07", "2")]),
              ("q", [(4, "a", "2024-01-06", "late"), (5, "a", "2024-01-08", "3")])]
    for progress, rows in rounds:
        land(spark, plays(spark, rows), folder)
        stream = streams.read_landed(spark, folder, sides[1].schema)
        streams.stream_append(stream, target, str(tmp_path / progress), AS_OF).awaitTermination()
    assert keys(streams.stored(spark, target, sides[1].schema)) == [(1, "a", "1"), (3, "a", "2"), (5, "a", "3")]


def test_a_run_name_belongs_to_one_checkpoint(spark, sides, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, sides[1], folder)
    stream = streams.read_landed(spark, folder, sides[1].schema)
    streams.stream_append(stream, target, str(tmp_path / "p"), AS_OF, run="daily").awaitTermination()
    with pytest.raises(ValueError, match="another checkpoint"):
        streams.stream_append(stream, target, str(tmp_path / "q"), AS_OF, run="daily")
    assert len(keys(streams.stored(spark, target, sides[1].schema))) == 5


def test_an_update_by_year_leaves_other_years_alone(spark, sides, tmp_path):
    existing, incoming = sides
    path, by = str(tmp_path / "by_year"), ["occasion_id", "item_id"]
    inc.store_by_year(existing.unionByName(plays(spark, [(-1, "old", "1999-05-05", "old")])), path)
    files = lambda year: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "by_year" / f"year={year}").glob("part-*"))
    before = {year: files(year) for year in (1999, 2022, 2024)}
    want = sorted(keys(existing) + [(-1, "old", "old"), (2, "a", "new"), (4, "a", "new"), (5, "a", "new")])
    for _ in range(2):
        assert keys(inc.upsert_years(spark, path, incoming, AS_OF, by, ["payload"])) == want
    assert files(1999) == before[1999] != [] and files(2022) == before[2022] != [] and files(2024) != before[2024]


def test_a_bucketed_table_is_not_shuffled(spark, sides, tmp_path):
    existing, incoming = sides
    by, path = ["occasion_id", "item_id"], str(tmp_path / "bucketed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        inc.store_bucketed(existing, "bucketed_plays", path, by, 4)
        recent = inc.recent_years(incoming, AS_OF)
        new = inc.new_rows_bucketed(spark, "bucketed_plays", recent, by, ["payload"])
        new.collect()
        plan = new._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        scan = next(i for i, x in enumerate(plan) if "bucketed_plays" in x or "Bucketed: true" in x)
        join = next(i for i, x in enumerate(plan) if "LeftAnti" in x)
        stored_side = plan[max(i for i in range(join, scan) if "+-" in plan[i][:plan[join].index("+-") + 8]):scan + 1]
        assert not any("Exchange" in x for x in stored_side) and any("Exchange" in x for x in plan)
        want = keys(inc.upsert_keep_existing(existing, recent, by, ["payload"]))
        for _ in range(2):
            assert keys(inc.upsert_bucketed(spark, "bucketed_plays", recent, by, ["payload"], 4)) == want
        inc.attach_bucketed(spark, "again", path, existing.schema, by, 4)
        assert keys(spark.table("again")) == want
        with pytest.raises(Exception, match="a row without item_id"):
            inc.new_rows_bucketed(spark, "again", plays(spark, [(1, None, "2024-01-01", "x")]), by, ["payload"]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_plays")
        spark.sql("DROP TABLE IF EXISTS again")


def test_merged_new_rows_equal_new_rows_with_one_shuffle_of_each_side(spark):
    import re

    from gapkit.streaming.incremental import new_rows, new_rows_merged

    schema = "a long, b string, v int"
    stored = spark.createDataFrame([(i % 50, None if i % 7 == 0 else f"b{i % 5}", i) for i in range(120)], schema)
    landed = spark.createDataFrame([(None if i % 11 == 0 else i % 80, None if i % 6 == 0 else f"b{i % 6}", i % 9) for i in range(600)], schema)
    want = sorted(map(tuple, new_rows(stored, landed, ["a", "b"], ["v"]).collect()), key=repr)
    merged = new_rows_merged(stored, landed, ["a", "b"], ["v"])
    assert merged.columns == landed.columns and sorted(map(tuple, merged.collect()), key=repr) == want and want
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = new_rows_merged(stored, landed, ["a", "b"], ["v"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(re.findall("Exchange hashpartitioning", plan)) == 2, plan


def test_the_state_of_an_upsert_is_on_disk_and_keys_only(spark, tmp_path):
    folder, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows = spark.range(600).select((F.col("id") % 200).alias("k"), ((F.col("id") * 7919) % 601).alias("v"))
    land(spark, rows.repartition(5), folder)
    said = spark.conf.getAll
    stream = streams.read_landed(spark, folder, rows.schema)
    query = streams.stream_upsert_state(stream, target, progress, ["k"], ["v"])
    query.awaitTermination()
    assert spark.conf.getAll == said
    (state,) = query.lastProgress["stateOperators"]
    assert state["operatorName"] == "dedupe" and state["numRowsUpdated"] == 200
    assert any(name.startswith("rocksdb") for name in state["customMetrics"])
    first = rows.groupBy("k").agg(F.min("v").alias("v"))
    assert sorted(map(tuple, streams.stored(spark, target, rows.schema).collect())) == sorted(map(tuple, first.collect()))


def test_a_store_that_the_session_names_is_kept(spark, sides, tmp_path):
    folder, name = str(tmp_path / "in"), "spark.sql.streaming.stateStore.providerClass"
    land(spark, sides[1], folder)
    stream = streams.read_landed(spark, folder, sides[1].schema)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        query = streams.stream_upsert_state(stream, str(tmp_path / "out"), str(tmp_path / "p"), ["occasion_id", "item_id"], ["payload"])
        query.awaitTermination()
        assert "HDFSBacked" in spark.conf.get(name)
    finally:
        spark.conf.unset(name)
    assert not any(x.startswith("rocksdb") for x in query.lastProgress["stateOperators"][0]["customMetrics"])
    assert len(keys(streams.stored(spark, str(tmp_path / "out"), sides[1].schema))) == 5


@pytest.mark.parametrize("partitions", ["7", "2"])
def test_the_first_row_of_a_key_is_stored_with_other_partitions_as_well(spark, tmp_path, partitions):
    """Stored rows before landed ones, nulls first, and with one shuffle after a start with other settings too."""
    folder, target, progress, base = (str(tmp_path / n) for n in ("in", "out", "progress", "base"))
    schema, kept = "k long, part string, v int", spark.conf.get("spark.sql.shuffle.partitions")
    data = [(None if i % 40 == 0 else i % 40, None if i % 3 == 0 else f"p{i % 3}", None if i % 71 == 0 else (i * 37) % 101) for i in range(900)]
    spark.createDataFrame([(n, "p1", 0) for n in range(0, 40, 2)], schema).write.parquet(base)
    try:
        for count, some in ((kept, data[:450]), (partitions, data + [(k + 100 if k else k, p, v) for k, p, v in data[450:]])):
            spark.conf.set("spark.sql.shuffle.partitions", count)
            land(spark, spark.createDataFrame(some, schema).repartition(4), folder)
            stream = streams.read_landed(spark, folder, schema)
            query = streams.stream_upsert_state(stream, target, progress, ["k", "part"], ["v"], streams.read_landed(spark, base, schema))
            query.awaitTermination()
            assert spark.conf.get("spark.sql.shuffle.partitions") == count
            plan = query._jsq.explainInternal(False)
            assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Sort [") < plan.index("Exchange hashpartitioning"), plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    want, known = {}, {(n, "p1") for n in range(0, 40, 2)}
    for some in (data[:450], data + [(k + 100 if k else k, p, v) for k, p, v in data[450:]]):
        batch = {}
        for k, p, v in some:
            if (k, p) not in known:
                batch[k, p] = min(batch.get((k, p), (2, 0)), (v is not None, v or 0))
        want |= {key: v if there else None for key, (there, v) in batch.items()}
        known |= set(batch)
    got = [tuple(r) for r in streams.stored(spark, target, stream.schema).collect()]
    assert sorted(got, key=repr) == sorted(((*key, v) for key, v in want.items()), key=repr)


def test_fractions_as_keys_have_one_zero_and_one_nan(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, spark.createDataFrame([(0.0, 5), (-0.0, 3), (float("nan"), 2), (float("nan"), 1), (None, 4), (1.5, 6)], "k double, v int"), folder)
    land(spark, spark.createDataFrame([(-0.0, 1)], "k double, v int"), folder)
    stream = streams.read_landed(spark, folder, "k double, v int")
    streams.stream_upsert_state(stream, target, str(tmp_path / "p"), ["k"], ["v"]).awaitTermination()
    got = sorted(map(str, (tuple(r) for r in streams.stored(spark, target, stream.schema).collect())))
    assert got == ["(0.0, 1)", "(1.5, 6)", "(None, 4)", "(nan, 1)"]
