from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gapkit import functions as G


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


@pytest.mark.parametrize("value", [0.125, 2.345, 1.005, 1.015, 2.355, -0.125, -2.5, 7.605, 0.0, 1e6 + 0.005])
def test_round2_is_numpy_rounding(spark, value):
    assert one(spark, [value], G.round2, "double") == [np.round(value, 2)]


def test_round2_on_many_values(spark):
    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.floats(-1e6, 1e6), min_size=200, max_size=400))
    def check(values):
        assert one(spark, values, G.round2, "double") == list(np.round(np.array(values), 2))

    check()


def test_zscore_with_zero_spread(spark):
    df = spark.createDataFrame([(5, 2.0, 0.0), (1, 2.0, 0.0), (2, 2.0, 0.0), (5, 2.0, 1.5), (5, None, None)],
                               "c int, m double, s double")
    got = [r[0] for r in df.select(G.gap_zscore(F.col("c"), F.col("m"), F.col("s"))).collect()]
    assert got == [float("inf"), float("-inf"), None, 2.0, None]


def test_sample_std(spark):
    df = spark.createDataFrame([(1, 3.0, 9.0), (3, 9.0, 27.0), (3, 6.0, 14.0)], "n long, s double, q double")
    got = [r[0] for r in df.select(G.sample_std(F.col("n"), F.col("s"), F.col("q"))).collect()]
    assert got == [None, 0.0, 1.0]


@pytest.mark.parametrize("text", ["DON'T stop", "can't", "élan VITAL", "2nd time", "a-b_c", "", "x  y"])
def test_py_title(spark, text):
    assert one(spark, [text], G.py_title) == [text.title()]


@pytest.mark.parametrize("text", ["jAM session", "a", "", "ÉTÉ", "3 dogs"])
def test_capitalize_first(spark, text):
    assert one(spark, [text], G.capitalize_first) == [text.capitalize()]


@pytest.mark.parametrize("text", ["  x \t\n", " y ", "", "a b"])
def test_strip(spark, text):
    assert one(spark, [text], G.strip) == [text.strip()]


def test_articles(spark):
    assert one(spark, ["Fillmore, The", "The Met", "Them, There"], G.front_article) == [
        "The Fillmore", "The Met", "Them, There"]
    assert one(spark, ["Fillmore, The", "Hall THE ", "Theatre"], G.trim_trailing_the) == ["Fillmore,", "Hall ", "Theatre"]


def test_slug_skips_missing_parts(spark):
    df = spark.createDataFrame([("Red Rocks", None, "", "USA")], "a string, b string, c string, d string")
    assert df.select(G.slug(*[F.col(c) for c in "abcd"])).first()[0] == "red-rocks-usa"


def test_split_place_from_the_right(spark):
    texts = ["A, B, C, D", "A, B, C", "A, B", "A"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [tuple(r) for r in df.select(*G.split_place(F.col("v"))).collect()]
    assert got == [("A, B", "C", "D"), ("A", "B", "C"), ("A", "B", None), ("A", None, None)]


def test_two_digit_years(spark):
    texts = ["12/31/68", "01/01/69", "06/06/87", "03/21/25", "00/00/85", "02/30/99", "junk", None]
    assert one(spark, texts, G.parse_mdy2) == [
        date(2068, 12, 31), date(1969, 1, 1), date(1987, 6, 6), date(2025, 3, 21), None, None, None, None]


def test_date_keys(spark):
    assert one(spark, ["06/06/87", "00/00/85", "01/05/03", "01/05/30"], G.date_key) == [
        "19870606", "19850000", "20030105", "300105"]


def test_partial_labels(spark):
    rows = [("06", "06"), ("00", "17"), ("02", "00"), ("00", "00")]
    df = spark.createDataFrame([(date(1987, 6, 6), "1987", m, d) for m, d in rows], "x date, y string, m string, d string")
    got = [r[0] for r in df.select(G.partial_date_label(*[F.col(c) for c in "xymd"])).collect()]
    assert got == ["1987-06-06", "??/17/87", "02/??/87", "??/??/87"]


def test_alternate_elements_and_letters(spark):
    df = spark.createDataFrame([(["a", "b", "c"], 2)], "l array<string>, n int")
    assert tuple(df.select(G.even_elements(F.col("l")), G.odd_elements(F.col("l")), G.ordinal_letter(F.col("n"))).first()) == (
        ["a", "c"], ["b"], "b")


def test_invalid_iso_dates_are_null(spark):
    assert one(spark, ["2001-02-31", "2001-02-03", "x"], G.parse_iso) == [None, date(2001, 2, 3), None]


def test_letters_stay_distinct(spark):
    values = [1, 26, 27, 31, 32, 159, 160, 161, 1000]
    assert one(spark, values, G.ordinal_letter, "long") == [chr(ord("a") + n - 1) for n in values]
