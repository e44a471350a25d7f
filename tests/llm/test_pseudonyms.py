import itertools
import random
import re

from pyspark.sql import functions as F

from gapkit.llm.pseudonyms import permuted_pair, permuted_text, pseudonymized

from .helpers import SCHEMA, documents, empty, frame, with_clashes


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def changed(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    return [r["text"] for r in pseudonymized(df, key).orderBy("doc_id").collect()]


VALID = ["4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111", "378282246310005", "Jo.Doe+x9@mail.example.org", "ünï.77@a.example.com",
         "192.168.0.254", "+1 (487) 555-7209", "+49 30 1234567", "2001-02-28", "31.12.1999", "12/25/2020", "25/12/2020", "123-45-6789",
         "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"]
INVALID = ["4111111111111112", "1234567890123", "300.1.1.1", "1.2.3", "2001-02-30", "99.99.1999", "13/32/2020", "1850-01-01", "000-12-3456", "666-12-3456",
           "123-00-4567", "GB82WEST12345698765431", "a@b", "12345", "41111111111111110000", "abc4111111111111111", "1.2.3.4.5"]


def test_valid_values_keep_their_format_and_invalid_ones_stay(spark):
    new = changed(spark, [f"see {v}, ok" for v in VALID] + [f"see {v} ok" for v in INVALID])
    shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", t)))
    for v, n in zip(VALID, new):
        assert n != f"see {v}, ok" and n.startswith("see ") and n.endswith(", ok")
        got = n[4:-4]
        if v == "192.168.0.254":
            assert all(0 <= int(o) <= 255 and str(int(o)) == o for o in got.split("."))
        elif not v.startswith("9b0"):
            assert shape(got) == shape(v)
        if v[0] in "43" and "." not in v:
            assert luhn(re.sub(r"\D", "", got))
        if v[:2] in ("GB", "DE"):
            assert mod97(got.replace(" ", "")) == 1 and got[:2] == v[:2]
    assert new[len(VALID):] == [f"see {v} ok" for v in INVALID]


def test_equal_values_stay_linked_and_keys_differ(spark):
    card, mail = "4111111111111111", "a.b77@x.example.com"
    one, two, other = changed(spark, [f"{card} {mail}", f"x {mail}\n{card}", f"{card.replace('1', '1')} x"])
    assert one.split()[0] == two.split()[2] == other.split()[0] and one.split()[1] == two.split()[1]
    assert changed(spark, [card], "k") != changed(spark, [card], "other")


def test_permutations_are_permutations(spark):
    pairs = spark.createDataFrame([(i // 13, i % 13) for i in range(7 * 13)], "a long, b long")
    got = {tuple(r[0]) for r in pairs.select(permuted_pair(F.col("a"), F.col("b"), 7, 13, "k", "t")).collect()}
    assert got == set(itertools.product(range(7), range(13)))
    texts = [f"{i:03d}" for i in range(1000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0] for r in df.select(permuted_text(F.col("t"), "k", "t")).collect()} == set(texts)
    words = [f"{a}{b}-Z" for a in "abcdef" for b in "0123456789"]
    df = spark.createDataFrame([(t,) for t in words], "t string")
    new = [r[0] for r in df.select(permuted_text(F.col("t"), "k", "h", 6)).collect()]
    assert set(new) == {w for w in words}


def test_all_dates_of_a_year_stay_apart(spark):
    days = spark.sql("SELECT CAST(d AS STRING) AS text FROM (SELECT explode(sequence(DATE'2000-01-01', DATE'2000-12-31')) AS d)")
    df = days.selectExpr("1L AS doc_id", "text", "'x' AS lang", "'y' AS source", "1L AS n_chars")
    new = {r[0] for r in pseudonymized(df, "k").select("text").collect()}
    assert len(new) == 366 and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", d) for d in new)


def test_awkward_rows(spark):
    assert pseudonymized(empty(spark), "k").collect() == []
    rows = documents(2, 20) + [(9000, "4111111111111111" * 1, None, None, None), (9000, "4111111111111111", None, None, None),
                               (9001, "a" * 200_000 + " 4111111111111111 4111111111111111", None, None, None)]
    df = with_clashes(frame(spark, rows)).withColumn("n_values", F.lit("clash"))
    got = pseudonymized(df, "k")
    assert set(got.columns) == set(df.columns)
    by_id = {r["doc_id"]: r for r in got.collect()}
    for r in documents(2, 20):
        assert (by_id[r[0]]["text"], by_id[r[0]]["n_values"], by_id[r[0]]["lang"]) == (r[1], 0, r[2])
    assert by_id[9001]["n_values"] == 2 and len(by_id[9001]["text"]) == 200_034 and by_id[9001]["g"] == "clash"


MORE = ["3/4/1980", "12/5/1999", "25/3/2001", "(743) 555-3824", "(743)555-3824", "743-555-3824", "743.555.3824"]


def test_more_forms_of_dates_and_phones(spark):
    new = changed(spark, [f"on {v}, ok" for v in MORE] + ["at 2021-03-04T10:15:00Z.", "at 2021-03-04.", "no 143-555-3824, 743-155-3824 or 1743-555-3824"])
    for v, n in zip(MORE, new):
        got = n[3:-4]
        assert n != f"on {v}, ok" and n.startswith("on ") and n.endswith(", ok")
        if "/" in v:
            assert re.fullmatch(r"\d{1,2}/\d{1,2}/(19|20)\d\d", got) and not re.search(r"(^|/)0", got)
        else:
            assert re.sub(r"\d", "9", got) == re.sub(r"\d", "9", v)
            assert re.fullmatch(r"[2-9]..[2-9]......", re.sub(r"\D", "", got))
    stamp, day, left = new[len(MORE):]
    assert stamp.endswith("T10:15:00Z.") and stamp[3:13] == day[3:13] != "2021-03-04"  # a date and its time stamps stay linked
    assert left.startswith("no 143-555-3824, 743-155-3824")
    # the same number is the same in all forms
    assert len({re.sub(r"\D", "", n) for n in new[3:7]}) == 1


def test_long_and_hostile_texts_end(spark):
    n = 1_000_000
    texts = ["x@" + "a." * n + "a", "a@" * n, "a." * n, "+1 " * n, "1.1.1.1." * n, "2001-01-" * n, "12/12/" * n, "743-555-" * n, "(743) " * n,
             "4111 " * n, "4" * n, "123-45-" * n, "GB82 WEST " * n, "AB12" * n, "deadbeef0" * n, "a-b." * n + "@", "é.%+" * n + "@x"]
    assert changed(spark, texts) == texts
    long = "x@" + ".".join(["abc"] * 70) + ".org"
    assert changed(spark, [long])[0] != long and len(changed(spark, [long])[0]) == len(long)


# What is found, by a plain scanner: all maximal matches of each kind, from left to right.
def scan(text):
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    mail = r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    found = [m.span() for m in re.finditer(mail, text)]
    for m in re.finditer(rf"(?<![\w.]){octet}(?:\.{octet}){{3}}(?!\w|\.[0-9])", text):
        found.append(m.span())
    for m in re.finditer(r"(?<![\w-])[0-9]{13,19}(?![\w-])", text):
        if luhn(m.group()):
            found.append(m.span())
    for m in re.finditer(r"(?<![\w./-])([0-9]{4})-([0-9]{2})-([0-9]{2})(?![\w/-]|\.[0-9])", text):
        if 1900 <= int(m[1]) < 2100 and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 28:
            found.append(m.span())
    for m in re.finditer(r"(?<!\w)[0-9a-f]{32,128}(?!\w)", text):
        if not m.group().isdigit() and not m.group().isalpha():
            found.append(m.span())
    return sorted(found)


def test_detection_equals_a_plain_scanner(spark):
    rng = random.Random(9)
    values = ["jo.do@ex.org", "a@b", "10.0.0.1", "10.0.0.256", "4111111111111111", "4111111111111112", "2001-02-28", "2001-13-28", "x", "-", ".", "/", ",", "12"]
    texts = [" ".join(rng.choice(values) + rng.choice(["", "", ",", "."]) for _ in range(12)) for _ in range(200)]
    texts += ["".join(rng.choice([*values, " "]) for _ in range(8)) for _ in range(200)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    for r in pseudonymized(df, "k").collect():
        old, spans, at = texts[r["doc_id"]], scan(texts[r["doc_id"]]), 0
        if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
            continue  # kinds that overlap: the first alternative counts
        assert r["n_values"] == len(spans), old
        for lo, hi in spans:
            assert r["text"].startswith(old[at:lo]) or at, old
            at = hi
        assert len(r["text"]) >= len(old) - 12 * len(spans)
