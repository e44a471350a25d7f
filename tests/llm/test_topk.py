import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapkit.llm.topk import TopKParams, candidates_of, scaled, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    vectors = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            vectors[i] = min(vectors.get(i, w), w)
    out = set()
    for q, a in vectors.items():
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in vectors.items() if c != q and len(a) == len(b))
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("params", [TopKParams(), TopKParams(block=40, query_block=2, few=6)])
def test_equals_brute_force(spark, params):
    rng = random.Random(3)
    common = [0.5] * 8
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)] if i % 3 else common, 0) for i in range(400)]
    rows += [(500, None, 0), (501, [0.1, None] * 4, 0), (502, [float("nan")] * 8, 0), (503, [float("inf")] * 8, 0), (None, common, 0),
             (550, [1.0, 2.0], 0), (551, [1.0, 1.0], 0), (600, [], 0), (1, [9.0] * 8, 0), (650, [0.0] * 8, 0)]
    rows.append(rows[7])
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"c": F.lit("clash"), "q": F.lit("clash"), "dim": F.lit("clash")})
    got = top_k(df.select("*", scaled(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0, params).collect()
    want = brute(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_k(df.select("vec_id", scaled(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("size", [100, 30_000, 2_000_000_000])
def test_bounds_keep_all_that_qualify(size):
    rng = np.random.default_rng(1)
    x, q = (rng.integers(-size, size, (n, 12)) for n in (300, 9))
    found = candidates_of(x, q, 6, TopKParams(few=10))
    exact = x.astype(object) @ q.T.astype(object)
    for i in range(9):
        rows, scores = found[i]
        assert [int(s) for s in scores] == [int(exact[r, i]) for r in rows]
        assert set(np.flatnonzero(exact[:, i] >= sorted(exact[:, i])[-6])) <= set(rows.tolist())
