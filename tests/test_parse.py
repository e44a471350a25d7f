from datetime import date

from pyspark.sql import functions as F

from gapkit.operators.ordered import seq_bucket
from gapkit.plans import parse
from gapkit.sources import html


def lines(spark, texts, occasion="o"):
    data = [(occasion, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "occasion_id string, line_no int, text string")


def test_setlist(spark):
    df = lines(spark, [
        "06/06/87 Somewhere", "1: First > Second, Third* > ???", "2: Lawyers, Guns, And Money > Last**", "E: Encore",
        "E2: More", "* with guest ** again", "[note]",
    ])
    known = {"fragments": parse.COMMA_FRAGMENTS, "titles": parse.COMMA_TITLES, "repairs": parse.ITEM_REPAIRS}
    got = [tuple(r) for r in parse.parse_setlist(df, **known).orderBy("position").select(
        "set_label", "position", "position_in_set", "item", "segue_in", "segue_out", "note_key").collect()]
    assert got == [
        ("1", 1, 1, "FIRST", 0, 1, ""), ("1", 2, 2, "SECOND", 1, 0, ""), ("1", 3, 3, "THIRD", 0, 1, "*"),
        ("1", 4, 4, "JAM", 1, 0, ""), ("2", 5, 1, "LAWYERS GUNS AND MONEY", 0, 1, ""), ("2", 6, 2, "LAST", 1, 0, "**"),
        ("E", 7, 1, "ENCORE", 0, 0, ""), ("E2", 8, 1, "MORE", 0, 0, ""),
    ]


def test_fragments_belong_to_their_title_only(spark):
    df = lines(spark, ["1: Rattle That Lock, Guns Of Brixton, Song, Shake, Rattle, And Roll, Rattle (a.b"])
    plain = [r.item for r in parse.parse_setlist(df).orderBy("position").collect()]
    assert plain == ["RATTLE THAT LOCK", "GUNS OF BRIXTON", "SONG", "SHAKE", "RATTLE", "AND ROLL", "RATTLE (A.B"]
    known = parse.parse_setlist(df, fragments=[*parse.COMMA_FRAGMENTS, "(a.b"], titles={"Shake": "Shake, Rattle, And Roll", "X": "Y"})
    assert [r.item for r in known.orderBy("position").collect()] == [
        "RATTLE THAT LOCK", "GUNS OF BRIXTON", "SONG", "SHAKE, RATTLE, AND ROLL"]


def test_setlist_lines_of_one_set_continue(spark):
    df = lines(spark, ["1: A, B", "1: C", "2: D"]).unionByName(lines(spark, ["1: X"], "p"))
    got = [tuple(r) for r in parse.parse_setlist(df).orderBy("occasion_id", "position").select(
        "item", "position", "position_in_set").collect()]
    assert got == [("A", 1, 1), ("B", 2, 2), ("C", 3, 3), ("D", 4, 1), ("X", 1, 1)]


def test_line_classes(spark):
    df = lines(spark, ["1: a", "E1: a", "??/??/85", "12/31/99", "* x", "[y]", "z"])
    assert [r[0] for r in df.orderBy("line_no").select(parse.line_class(F.col("text"))).collect()] == [
        "set", "set", "details", "details", "song_notes", "show_notes", "other"]


def test_star_notes(spark):
    df = spark.createDataFrame([("o", "* with guest ** second [show note]")], "occasion_id string, text string")
    got = [(r.note_key, r.detail) for r in parse.star_notes(df).orderBy("note_no").collect()]
    assert got == [("*", " with guest "), ("**", " second ")]


def test_numbered_notes(spark):
    df = spark.createDataFrame([("o", "head [1] x\ny [2]z [10] "), ("p", "none")], "occasion_id string, text string")
    got = [(r.occasion_id, r.ref, r.detail) for r in parse.numbered_notes(df).orderBy("note_no").collect()]
    assert got == [("o", "1", "x\ny"), ("o", "2", "z"), ("o", "10", "")]


def test_schedule(spark):
    text = "06/06/87 Hall, Athens, GA  06/06/87 The Bar, Annex, Athens, GA ??/??/85 House, Athens, GA 01/02/04 Solo"
    raw = spark.createDataFrame([(1985, text)], "list_year int, text string")
    entries = parse.parse_schedule(raw)
    got = parse.schedule_occasions(entries, ["entry_no"], seq_bucket("entry_no"), link_suffix=".x").orderBy("entry_no")
    shown = [(r.occasion_id, r.occ_date, r.day_label, r.venue, r.city, r.state, r.weekday) for r in got.collect()]
    assert shown == [
        ("19870606a.x", date(1987, 6, 6), "1987-06-06", "HALL", "ATHENS", "GA", "Saturday"),
        ("19870606b.x", date(1987, 6, 6), "1987-06-06", "THE BAR, ANNEX", "ATHENS", "GA", "Saturday"),
        ("19850000a.x", None, "??/??/85", "HOUSE", "ATHENS", "GA", None),
        ("20040102a.x", date(2004, 1, 2), "2004-01-02", "SOLO", None, None, "Friday"),
    ]


def test_set_names(spark):
    df = spark.createDataFrame([("Set 1",), ("Encore 2",), ("Set 3:",), ("Acoustic",)], "s string")
    assert [r[0] for r in df.select(parse.short_set_name(F.col("s"))).collect()] == ["1", "e", "3", "Acoustic"]


PAGE = """<html><head><title>History of "Some Song" live</title></head><table><tr><td>x</td></tr></table>
<TABLE class=a><tr><th>Date</th><th>Venue</th></tr>
<tr><td>2024-01-01</td><td><a href="/song/a-b">A &amp; B</a></td></tr><tr><td>2024-01-02</td></tr></TABLE>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<title>plain</title>")], "page_id int, html string")
    rows = [(r.page_id, r.row_no, r.cells) for r in html.page_rows(pages, table_no=1).orderBy("row_no").collect()]
    assert rows == [(1, 0, ["Date", "Venue"]), (1, 1, ["2024-01-01", "A & B"]), (1, 2, ["2024-01-02"])]
    named = html.with_header(pages, ["Venue", "Date", "Footnote"], table_no=1).orderBy("row_no").collect()
    assert [(r.Venue, r.Date, r.Footnote) for r in named] == [("A & B", "2024-01-01", None), (None, "2024-01-02", None)]
    assert [r.target for r in html.links(pages, r'href="/song/([^"]+)"').collect()] == ["a-b"]
    assert {r.page_id: r.title for r in html.quoted_title(pages).collect()} == {1: "Some Song", 2: "Unknown Title"}


def test_page_plays(spark):
    boxes = spark.createDataFrame(
        [("o", 0, 0, "Set 1:", "A,", ["1"]), ("o", 0, 1, None, "B >", []), ("o", 1, 0, None, "C", ["2", "1"]),
         ("o", 2, 0, "Encore:", "D", ["9"]), ("p", 0, 0, None, "E", [])],
        "occasion_id string, paragraph_no int, box_no int, label string, item string, refs array<string>")
    details = spark.createDataFrame([("o", "1", "one"), ("o", "2", "two")], "occasion_id string, ref string, detail string")
    got = parse.page_plays(boxes, details).orderBy("occasion_id", "paragraph_no", "box_no").collect()
    assert [(r.set_label, r.item, r.item_before, r.item_after, r.footnote) for r in got] == [
        ("1", "A", "***", "B", "one"), ("1", "B", "A", "***", ""), ("1", "C", "***", "***", "two one"),
        ("e", "D", "***", "***", ""), ("", "E", "***", "***", "")]


def test_venue_texts(spark):
    df = spark.createDataFrame([("Ram's Head! & Co, The",), ("Plain",)], "v string")
    assert [r[0] for r in df.select(parse.venue_key_text(F.col("v"))).collect()] == ["The Ram039s Head amp Co", "Plain"]
    df = spark.createDataFrame([("Ram039s Head Live, Baltimore, MD",), ("A amp B, X",), ("Camp, the",)], "v string")
    assert [r[0] for r in df.select(parse.repair_venue_text(F.col("v"))).collect()] == [
        "Ram's Head Live!, Baltimore, MD", "A & B, X", "Camp,"]
