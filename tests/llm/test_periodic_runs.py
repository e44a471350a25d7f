import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapkit.llm.periodic_runs import RunParams, periodic_runs, runs_in
from gapkit.llm.queries import op13_periodic_runs

from .helpers import documents, empty, frame, invented, with_clashes, words


def brute(w, least=6, times=4):
    """Maximal stretches of every period; of several periods of one stretch the smallest."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("times", [3, 4, 5])
def test_runs_equal_brute_force(times):
    rng = random.Random(times)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 60))]
            if w and rng.random() < 0.6:
                s = rng.randrange(len(w))
                q = rng.randint(1, 1 + (len(w) - s) // 3)
                w[s:] = [w[s + i % q] for i in range(len(w) - s)]
            docs.append(w)
        bounds = np.cumsum([0, *map(len, docs)])
        of, start, length, period = runs_in(np.array(sum(docs, []), np.int64), bounds, RunParams(6, times))
        for d, w in enumerate(docs):
            got = sorted(zip(start[of == d].tolist(), period[of == d].tolist(), length[of == d].tolist()))
            assert got == brute(w, 6, times)


def test_long_texts_are_read_whole_and_stay_cheap():
    n = 300_000
    assert [x.tolist() for x in runs_in(np.zeros(n, np.int64), np.array([0, n]))] == [[0], [0], [n], [1]]
    period = np.random.default_rng(5).integers(0, 9, n // 4)
    assert (0, 0, n, n // 4) in zip(*(x.tolist() for x in runs_in(np.tile(period, 4), np.array([0, n]))))


def test_rows_of_all_kinds(spark):
    rng = random.Random(4)
    rows = documents(3, 40)
    for i in range(20):
        w = invented(rng, rng.randint(1, 50))
        rows.append((5000 + i, " ".join(invented(rng, 3) + w[:rng.randint(1, 9)] * rng.randint(2, 7) + w), None, None, 0))
    rows += [(None, "a b a b a b a b a", None, None, None), (5000, "x x x x x x", None, None, None)]
    got = periodic_runs(with_clashes(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        w = words(r[1])
        runs = brute(w)
        best = max(runs, key=lambda x: (Fraction(x[2], x[1]), -x[0], -x[1]), default=None)
        want.append((r[0], len(w), runs, None if best is None else best, collapsed(w, runs)))
    mine = [(r["doc_id"], r["n_words"], list(zip(r["starts"], r["periods"], r["lengths"])),
             None if r["best"] is None else (r["starts"][r["best"]], r["periods"][r["best"]], r["lengths"][r["best"]]), r["collapsed"]) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr) and any(r[2] for r in want)
    assert periodic_runs(empty(spark)).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    rows = [r for r in documents(8, 200) if r[0] is not None]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    sha, planted = lambda x: hashlib.sha256(x.encode()).hexdigest(), 0
    want = []
    for doc_id, text, *_ in rows:
        w = words(text)
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = brute(w) if len(w) < 5000 else brute_sparse(w)
        best = max(runs, key=lambda x: (Fraction(x[2], x[1]), -x[0], -x[1]), default=(None,) * 3)
        text = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
        want.append((doc_id, len(runs), best[0], best[2], best[1], best[1] and 1000 * best[2] // best[1], sha(text), sha(collapsed(w, runs))))
    assert sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect())) == sorted(want) and planted > 10


def brute_sparse(w):
    """As ``brute``, for one long text: only lags at which some word recurs are tried, with numpy."""
    ids = np.unique(np.array(w), return_inverse=True)[1]
    found = {}
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
    return sorted((s, q, n) for (s, n), q in found.items())


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        RunParams(times=2)
