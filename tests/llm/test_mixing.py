import pytest
from pyspark.sql import functions as F

from gapkit.llm.mixing import MixParams, mixed, mixed_texts, targets

from .helpers import documents, empty, frame, with_clashes, words


def brute_targets(sizes, cycle=(5, 2, 1), total=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    rest, full = total * sum(sizes.values()), {}
    while True:
        level = rest / sum(weight[s] for s in names if s not in full) if len(full) < len(names) else 0
        over = [s for s in names if s not in full and weight[s] * level > repeats * sizes[s]]
        if not over:
            return {s: full.get(s, weight[s] * level) for s in names}
        for s in over:
            full[s] = repeats * sizes[s]
            rest -= full[s]


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 5, "b": 100, "c": 100, None: 7}, {"a": 0, "b": 3}, {chr(97 + i): i * i for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(df, MixParams()).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


@pytest.mark.parametrize("params", [MixParams(), MixParams(block_words=7, shard_words=500, bucket_rows=16), MixParams(block_words=None)])
def test_mixture(spark, params):
    rows = documents(8, 60) + [documents(8, 60)[0]]
    df = with_clashes(frame(spark, rows))
    mix = mixed(df, params)
    blocks = mix.blocks.collect()
    docs = mix.documents.collect()
    assert len(docs) == len(rows)
    sizes, source_sizes = {}, {}
    for r in docs:
        sizes[r["doc_id"], r["copy"]] = r["size"]
        source_sizes[r["source"]] = source_sizes.get(r["source"], 0) + r["size"]
    assert {r[0]: len(words(r[1])) for r in rows} == {k[0]: v for k, v in sizes.items()}
    want = brute_targets(source_sizes)
    taken, by_source, covered = {}, {}, {}
    for b in blocks:
        key = b["doc_id"], b["copy"]
        taken[key] = taken.get(key, 0) + b["n"]
        by_source[b["source"]] = by_source.get(b["source"], 0) + b["n"]
        places = covered.setdefault((key, b["pass"]), set())
        run = set(range(b["start"], b["start"] + b["n"]))
        assert not places & run and b["start"] + b["n"] <= sizes[key]
        places |= run
    assert all(abs(by_source.get(s, 0) - t) <= 1 for s, t in want.items())
    assert all(n <= 2 * sizes[k] for k, n in taken.items())
    shards = {}
    for b in blocks:
        shards.setdefault(b["shard"], []).append(b["position"])
    assert all(sorted(p) == list(range(len(p))) for p in shards.values())
    counts = [len(p) for p in shards.values()]
    if params.shard_words == 500:
        assert len(counts) > 8 and max(counts) - min(counts) <= 6
    again = mixed(df.repartition(7), params).blocks.collect()
    assert sorted(map(repr, blocks)) == sorted(map(repr, again))


def test_a_shard_is_a_sample_of_the_whole(spark):
    rows = [(i, "w " * 40, None, ["a", "b"][i % 4 == 0], None) for i in range(800)]
    mix = mixed(frame(spark, rows), MixParams(block_words=10, shard_words=6000))
    got = mix.blocks.groupBy("shard").agg(F.avg(F.when(F.col("source") == "a", 1).otherwise(0)).alias("a"), F.count("*").alias("n")).collect()
    share = mix.blocks.where("source = 'a'").count() / mix.blocks.count()
    assert len(got) == 8 and all(abs(r["a"] - share) < 0.1 for r in got) and len({r["a"] for r in got}) > 1


def test_texts_and_empty(spark):
    assert mixed(empty(spark)).blocks.collect() == []
    assert mixed_texts(empty(spark), mixed(empty(spark))).collect() == []
    rows = documents(3, 30)
    df = with_clashes(frame(spark, rows))
    mix = mixed(df, MixParams(block_words=None))
    got = mixed_texts(df, mix).collect()
    assert got and set(got[0].asDict()) == set(df.columns)
    assert sum(len(words(r["text"])) for r in got) == mix.blocks.agg(F.sum("n")).first()[0]
    texts = {r[0]: r[1] for r in rows}
    cut = [r for r in got if r["text"] != texts[r["doc_id"]]]
    assert len(cut) <= 5 and all(" ".join(words(texts[r["doc_id"]])).startswith(r["text"]) for r in cut)
