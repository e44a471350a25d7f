import hashlib

import numpy as np
from pyspark.sql import functions as F

from gapkit.llm.fingerprint import as_text, edited, fingerprint, fingerprinted, likeness, with_next, words

from .helpers import documents, empty, frame, with_clashes, words as plain_words


def shingles(text):
    w = plain_words(text.lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_next_document_edit_and_likeness(spark):
    rows = documents(4, 70)
    got = {r["doc_id"]: r for r in fingerprinted(with_clashes(frame(spark, rows))).select(
        "doc_id", "text", "edited", likeness(F.col("own"), F.col("changed")).alias("a"), likeness(F.col("own"), F.col("following")).alias("b"),
        as_text(F.col("own")).alias("print")).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: -r[0])
    errors, prints = [], {}
    for i, row in enumerate(ordered):
        text, follower = row[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        want = text[:len(text) - third] + follower[:third]
        r = got[row[0]]
        assert r["text"] == text and r["edited"] == want
        assert prints.setdefault(text, r["print"]) == r["print"]
        for value, other in ((r["a"], want), (r["b"], follower)):
            a, b = shingles(text), shingles(other)
            if a == b:
                assert value == 1.0
            elif len(a | b) > 30:
                errors.append(value - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.25
    assert prints[""] == "" and all(len(p) == 256 for t, p in prints.items() if plain_words(t))


def test_many_ranges_repeated_ids_and_nulls(spark):
    rows = [(i // 2 if i % 7 else None, f"text {i}", None, None, None) for i in range(60)]
    got = with_next(frame(spark, rows), rows=5).select("doc_id", "text", "next.text").collect()
    ordered = sorted(((-r[0] if r[0] is not None else 10**9, r[1]) for r in rows))
    follow = {a[1]: b[1] for a, b in zip(ordered, ordered[1:] + ordered[:1])}
    assert {r[1]: r[2] for r in got} == follow
    one = with_next(frame(spark, [(1, "only", None, None, None)])).select("next.text").collect()
    assert [r[0] for r in one] == ["only"]
    assert fingerprinted(empty(spark)).collect() == []


def test_edit_counts_code_points(spark):
    df = spark.createDataFrame([("añ😀bcd", "😀xyz"), ("ab", "zz"), ("abcdef", "z"), ("", "q")], "t string, n string")
    assert [r[0] for r in df.select(edited(F.col("t"), F.col("n"))).collect()] == ["añ😀b😀x", "ab", "abcdz", ""]


def test_sparse_texts_are_filled_alike(spark):
    df = spark.createDataFrame([("one two", "one two"), ("one", "two"), (None, None), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(likeness(fingerprint(F.col("a")), fingerprint(F.col("b")))).collect()]
    assert got[0] == 1.0 and got[1] < 0.3 and got[2:] == [1.0, 0.0]
    assert df.select(words(F.col("a"))).collect()[2][0] == []
    assert hashlib.sha256(b"").hexdigest() == df.select(F.sha2(F.lit(""), 256)).first()[0]
