import hashlib

import pytest

from gapkit.llm.substring_dedup import RepeatParams, without_repeats

from .helpers import documents, empty, frame, thue_morse, with_clashes, words


def brute(rows, window):
    first, out = {}, {}
    ordered = sorted((r[0], r[1]) for r in rows if r[1] is not None)
    gone = {}
    for doc, text in ordered:
        w = words(text)
        gone[doc] = set()
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i:i + window]), (doc, i)) != (doc, i):
                gone[doc].update(range(i, i + window))
    for r in rows:
        w, g = words(r[1]), gone.get(r[0], set())
        out[r[0]] = (len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g))
    return out


@pytest.mark.parametrize("window", [20, 13, 33])
def test_equals_brute_force(spark, window):
    rows = documents(11, 90)
    got = without_repeats(with_clashes(frame(spark, rows)), RepeatParams(window=window)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(rows, window) and len(got) == len(rows)


def test_repeats_inside_and_across(spark):
    a = [f"w{i}" for i in range(25)]
    rows = [(5, " ".join(a + a), None, None, None), (9, " ".join(["x"] + a), None, None, None), (7, "\n".join(a * 3), None, None, None),
            (8, " ".join(["same"] * 100), None, None, None)]
    got = without_repeats(frame(spark, rows), RepeatParams(window=20)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(rows, 20)


def test_digest_and_awkward_rows(spark):
    assert without_repeats(empty(spark)).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, None, None, None)] * 2 + [(None, text, None, None, None), (2, text, None, None, None), (3, None, None, None, None)]
    got = sorted(map(tuple, without_repeats(frame(spark, rows), RepeatParams(window=20), digest=True).collect()), key=repr)
    full, none = (hashlib.sha256(x.encode()).hexdigest() for x in (text, ""))
    assert got == sorted([(1, 30, 0, full), (1, 30, 0, full), (None, 30, 0, full), (2, 30, 30, none), (3, 0, 0, none)], key=repr)


def test_words_made_to_clash_are_different(spark):
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(i, f"{x} {tail}", None, None, None) for i, x in enumerate(thue_morse())]
    got = without_repeats(frame(spark, rows), RepeatParams(window=20)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(rows, 20) and all(r["n_removed"] == 0 for r in got)


def test_cover_is_checked():
    with pytest.raises(ValueError):
        RepeatParams(cover=(0, 1, 3))
