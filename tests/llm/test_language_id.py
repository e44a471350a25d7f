import random
import zlib

from gapkit.llm.language_id import LanguageParams, fit_languages, identify_languages, languages_of

from .helpers import SCHEMA, empty, frame, invented, with_clashes

SOUNDS = {
    "en": "the ing and ow th er wh ould is".split(), "de": "sch ung ich ei keit zu ver der ü".split(),
    "fr": "eau oux que les é tion aire è".split(), "es": "ción ado os ñ el ar ez ía".split(),
}


def rows(n=240, seed=5):
    rng = random.Random(seed)
    langs = list(SOUNDS)
    return [(i, " ".join(invented(rng, rng.randint(3, 80), SOUNDS[langs[i % 4]])), langs[i % 4], None, None) for i in range(n)]


def test_held_out_accuracy_and_folds(spark):
    data = rows()
    extra = [(1000, None, "en", None, None), (1001, "", None, None, None), (1002, "123 !? \t", "de", None, None), (1003, "x", None, None, None),
             (None, "the owing", "en", None, None), (0, data[0][1], "en", None, None)]
    got = languages_of(with_clashes(frame(spark, data + extra)).withColumnRenamed("score", "score")).collect()
    assert len(got) == len(data) + len(extra)
    truth = {r[0]: r[2] for r in data}
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and r["held_out"]]
    assert len(right) > 40 and sum(right) / len(right) > 0.97
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1000, 1001, 1002))


def test_languages_come_from_the_text_alone(spark):
    data = rows()
    model = fit_languages(frame(spark, data))
    a = identify_languages(frame(spark, data), model).collect()
    other = [(-r[0], r[1], "zz", "other", 7) for r in data]
    b = identify_languages(frame(spark, other, 5), model).collect()
    assert {r[0]: r[1:] for r in a} == {-r[0]: r[1:] for r in b}
    assert set(model.members) == {"germanic", "romance"} and model.members["germanic"] == ["de", "en"]


def test_nothing_and_one_language(spark):
    assert languages_of(empty(spark)).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None, None, None)], SCHEMA)
    assert [tuple(r)[2:] for r in languages_of(unlabelled).collect()] == [("und", 0.0)]
    one = frame(spark, [r for r in rows(60) if r[2] == "en"])
    assert {r["lang_pred"] for r in languages_of(one).collect()} == {"en"}


def test_sample_is_bounded(spark):
    data = rows(240)
    model = fit_languages(frame(spark, data), LanguageParams(per_language=20, sample=40))
    got = identify_languages(frame(spark, data), model).collect()
    truth = {r[0]: r[2] for r in data}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.9


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    data, n = [], 0
    for k in range(70):  # the last languages have one text, the others four
        sounds = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)]
        for _ in range(4 if k < 66 else 1):
            data.append((n, " ".join(invented(rng, 30, sounds)), f"l{k:02}", None, None))
            n += 1
    model = fit_languages(frame(spark, data), LanguageParams(sample=70, pieces=1, bits=10))
    assert sorted(model.members["other"]) == sorted({r[2] for r in data})
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(frame(spark, data), model).collect()}
    assert all(got[r[0]] == r[2] for r in data if r[2] >= "l64")
