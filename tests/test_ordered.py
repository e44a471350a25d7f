"""Bucketed windows against plain ones, hot keys included."""

import random

import pytest
from pyspark.sql import Window, functions as F

from gapkit.operators import ordered, runs, sequence, sets


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data, seq = [], 0
    for _ in range(3000):
        seq += rng.randint(1, 5)
        key = "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 40)}"
        data.append((key, seq, rng.choice("abc"), rng.choice([None, "x", "y"]), rng.randint(0, 9)))
    return spark.createDataFrame(data, "k string, s int, place string, label string, v int").cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def by_key():
    return Window.partitionBy("k").orderBy("s")


@pytest.mark.parametrize("width", [1, 7, 100, 10**6])
@pytest.mark.parametrize("value", ["s", "label"])
def test_lag_and_lead(skewed, width, value):
    bucket = ordered.seq_bucket("s", width)
    same(ordered.lag_value(skewed, ["k"], ["s"], value, "o", bucket), skewed.withColumn("o", F.lag(value).over(by_key())))
    same(ordered.lead_value(skewed, ["k"], ["s"], value, "o", bucket), skewed.withColumn("o", F.lead(value).over(by_key())))


def test_lag_default_is_for_missing_rows_only(skewed):
    bucket = ordered.seq_bucket("s", 50)
    same(ordered.lag_value(skewed, ["k"], ["s"], "label", "o", bucket, "***"),
         skewed.withColumn("o", F.lag("label", 1, "***").over(by_key())))


@pytest.mark.parametrize("width", [1, 64, 10**6])
def test_running_functions(skewed, width):
    bucket = ordered.seq_bucket("s", width)
    upto = by_key().rowsBetween(Window.unboundedPreceding, 0)
    same(ordered.running_sum(skewed, ["k"], ["s"], "v", "o", bucket), skewed.withColumn("o", F.sum("v").over(upto)))
    same(ordered.row_ordinal(skewed, ["k"], ["s"], "o", bucket),
         skewed.withColumn("o", F.row_number().over(by_key()).cast("long")))
    same(ordered.carry_forward(skewed, ["k"], ["s"], "label", "o", bucket),
         skewed.withColumn("o", F.last("label", ignorenulls=True).over(upto)))


@pytest.mark.parametrize("width", [1, 7, 64, 10**6])
def test_sums_of_key_and_part_from_one_exchange(skewed, width):
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    keyed = skewed.withColumn("k", F.when(F.col("k") != "k7", F.col("k")))
    got = ordered.running_sums(keyed, ["k"], "place", ["s"], "v", "o", "op", ordered.seq_bucket("s", width))
    same(got, keyed.withColumns({
        "o": F.sum("v").over(upto(by_key())), "op": F.sum("v").over(upto(Window.partitionBy("k", "place").orderBy("s")))}))
    assert ordered.running_sums(
        skewed.limit(0), ["k"], "place", ["s"], "v", "o", "op", ordered.seq_bucket("s", width)).collect() == []


@pytest.mark.parametrize("width", [1, 64])
def test_shared_exchange_changes_nothing(skewed, width):
    bucket = ordered.seq_bucket("s", width)
    upto = by_key().rowsBetween(Window.unboundedPreceding, 0)
    same(ordered.lag_value(skewed, ["k"], ["s"], "label", "o", bucket, "***", share=True),
         skewed.withColumn("o", F.lag("label", 1, "***").over(by_key())))
    same(ordered.running_sum(skewed, ["k"], ["s"], "v", "o", bucket, share=True),
         skewed.withColumn("o", F.sum("v").over(upto)))
    same(ordered.carry_forward(skewed, ["k"], ["s"], "label", "o", bucket, share=True),
         skewed.withColumn("o", F.last("label", ignorenulls=True).over(upto)))


def test_without_keys(skewed):
    w = Window.partitionBy(F.lit(0)).orderBy("s")
    same(ordered.row_ordinal(skewed, [], ["s"], "o", ordered.seq_bucket("s", 99)),
         skewed.withColumn("o", F.row_number().over(w).cast("long")))


def test_whole_group(skewed):
    plain = Window.partitionBy("k")
    same(ordered.whole_group(skewed, ["k"], lo=F.min("v"), hi=F.max("v")),
         skewed.withColumn("lo", F.min("v").over(plain)).withColumn("hi", F.max("v").over(plain)))


def test_edge_table_reuses_the_shuffle(spark, skewed, tmp_path):
    skewed.write.parquet(str(tmp_path / "plays"))
    points = spark.read.parquet(str(tmp_path / "plays")).where("k IS NOT NULL").groupBy("k", "s").agg(F.max("v").alias("v"))
    lagged = ordered.lag_value(points, ["k"], ["s"], "s", "p", ordered.seq_bucket("s", 50), share=True)
    lagged.collect()
    assert "ReusedExchange" in lagged._jdf.queryExecution().executedPlan().toString()


def test_global_sequence_numbers_everything_once(spark, skewed):
    numbered = sequence.global_sequence(skewed, ["s"], "n")
    got = [tuple(r) for r in numbered.orderBy("s").select("n").collect()]
    assert [n for (n,) in got] == list(range(1, skewed.count() + 1))


def test_global_sequence_spreads_copies(spark):
    copies = spark.range(5000).select(F.lit("same").alias("k"))
    numbered = sequence.global_sequence(copies, ["k"], "n")
    assert sorted(r.n for r in numbered.select("n").collect()) == list(range(1, 5001))


def test_ordinal_within_hot_key_with_copies(spark):
    data = [("hot", 1)] * 300 + [("hot", 2)] * 5 + [("b", 9), ("b", 8), ("b", 8)]
    df = spark.createDataFrame(data, "k string, p int")
    got = sequence.ordinal_within(df, ["k"], ["p"], "n")
    by_key = {}
    for k, p, n in sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[2])):
        by_key.setdefault(k, []).append((p, n))
    assert [n for _, n in by_key["hot"]] == list(range(1, 306))
    assert [p for p, _ in by_key["hot"]] == [1] * 300 + [2] * 5
    assert by_key["b"] == [(8, 1), (8, 2), (9, 3)]


def test_date_sequence_is_dense(spark):
    df = spark.sql("SELECT * FROM VALUES (date'2020-01-01'), (date'2020-01-01'), (date'2021-05-05'), (null) t(d)")
    got = {str(r.d): r.n for r in sequence.with_date_sequence(df, "d", "n").collect()}
    assert got == {"2020-01-01": 1, "2021-05-05": 2, "None": None}


RUNS = [  # seq, day, place
    (1, "2020-01-01", "A"), (2, "2020-01-02", "A"), (3, "2020-01-04", "A"), (4, "2020-01-05", None),
    (5, "2020-01-06", None), (6, "2020-01-07", "B"), (7, "2020-01-08", "A"), (8, "2020-01-09", "A"),
]


@pytest.mark.parametrize("width", [1, 3, 100])
def test_runs(spark, width):
    df = spark.createDataFrame(RUNS, "s int, d string, place string").withColumn("d", F.to_date("d"))
    bucket = ordered.seq_bucket("s", width)
    by_place = runs.run_index(df, "place", ["s"], bucket=bucket)
    assert [r.run_index for r in by_place.orderBy("s").collect()] == [1, 1, 1, 2, 3, 4, 5, 5]
    by_day = runs.run_index(df, "place", ["s"], date_col="d", bucket=bucket)
    assert [r.run_index for r in by_day.orderBy("s").collect()] == [1, 1, 2, 3, 4, 5, 6, 6]
    placed = runs.position_in_run(by_place, "run_index", "s")
    assert [r.pos_in_run for r in placed.orderBy("s").collect()] == [1, 2, 3, 1, 1, 1, 1, 2]


def test_keep_first_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    kept = sets.keep_first(df, ["k"], ["v"])
    assert sorted(map(tuple, kept.collect())) == [("a", 1), ("b", 3)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("width", [1, 7, 10**6])
@pytest.mark.parametrize("default", [None, "***"])
def test_both_neighbours_at_once(skewed, width, default):
    got = ordered.neighbour_values(skewed, ["k"], ["s"], "label", "a", "b", ordered.seq_bucket("s", width), default)
    w = by_key()
    same(got, skewed.withColumns({"a": F.lag("label", 1, default).over(w), "b": F.lead("label", 1, default).over(w)}))


@pytest.fixture(scope="module")
def line(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), rng.choice([None, None, "x", "y"]), rng.randint(0, 9)) for i in range(40_000) if i % 7 or i > 39_000]
    return spark.createDataFrame(data, "s long, place string, label string, v int").cache()


@pytest.mark.parametrize("fan", [4096, 3])
def test_without_keys_many_small_buckets_are_scanned_as_a_tree(line, monkeypatch, fan):
    """10,000 buckets of 4 rows at most, against plain windows."""
    monkeypatch.setattr(ordered, "FAN", fan)
    bucket, w = ordered.seq_bucket("s", 4), Window.partitionBy(F.lit(0)).orderBy("s")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    same(ordered.lag_value(line, [], ["s"], "label", "o", bucket, "***"), line.withColumn("o", F.lag("label", 1, "***").over(w)))
    same(ordered.lead_value(line, [], ["s"], "label", "o", bucket), line.withColumn("o", F.lead("label").over(w)))
    same(ordered.neighbour_values(line, [], ["s"], "v", "a", "b", bucket, -1),
         line.withColumns({"a": F.lag("v", 1, -1).over(w), "b": F.lead("v", 1, -1).over(w)}))
    same(ordered.running_sum(line, [], ["s"], "v", "o", bucket), line.withColumn("o", F.sum("v").over(upto)))
    same(ordered.row_ordinal(line, [], ["s"], "o", bucket), line.withColumn("o", F.row_number().over(w).cast("long")))
    same(ordered.carry_forward(line, [], ["s"], "label", "o", bucket), line.withColumn("o", F.last("label", ignorenulls=True).over(upto)))
    breaks = F.when(F.lag("place").over(w) == F.col("place"), 0).otherwise(1)
    plain = line.withColumn("f", breaks).withColumn("run_index", F.sum("f").over(upto)).drop("f")
    same(runs.run_index(line, "place", ["s"], bucket=bucket), plain)


def test_without_keys_one_task_sees_blocks_only(spark, line, tmp_path):
    """What goes to a single place has been summed up to blocks before, and the rows are dealt out once."""
    line.write.parquet(str(tmp_path / "line"))
    stored = spark.read.parquet(str(tmp_path / "line"))
    numbered = runs.run_index(stored, "place", ["s"], bucket=ordered.seq_bucket("s", 4))
    numbered.collect()
    plan = numbered._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    single = [i for i, x in enumerate(plan) if "Exchange SinglePartition" in x]
    assert single and all(any("keys=[__block" in y or "key=[__block" in y for y in plan[i:i + 8]) for i in single)
    assert sum("REPARTITION_BY_COL" in x and "Reused" not in x for x in plan) == 1


@pytest.mark.parametrize("fan", [2, 4096])
@pytest.mark.parametrize("width", [1, 5, 1000])
def test_positions_in_blocks_and_runs_from_one_exchange(spark, monkeypatch, fan, width):
    monkeypatch.setattr(ordered, "FAN", fan)
    rng = random.Random(11)
    years = sorted((rng.choice([None, 1, 2, 3, 4, 5, 6]) for _ in range(150)), key=lambda y: y or 0)
    line = spark.createDataFrame([(i + 1, y, rng.choice(["a", "b", None])) for i, y in enumerate(years)], "s long, y int, place string")
    got = runs.run_index(line, "place", ["s"], bucket=ordered.seq_bucket("s", width), blocks={"n": ["y"]})
    plain = runs.run_index(line, "place", ["s"], bucket=ordered.seq_bucket("s", 1000))
    same(got.select("s", "n", "run_index"), plain.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("s")))
         .select("s", "n", "run_index"))
