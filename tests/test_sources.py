import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gapkit.plans import rankings
from gapkit.sources import html, tables
from gapkit.sources.layouts import FILES, LAYOUTS
from gapkit.spec import PRESETS, Registry, register, registered

AS_OF = date(2024, 3, 1)


def write(folder, name, text):
    (folder / FILES[name]).write_text(text)


def test_keyed_layout(spark, tmp_path):
    write(tmp_path, "items", "song_id,song,is_original,original_artist,debut_date,last_played,times_played,avg_show_gap\n"
          '1,"Song, One",1,,2024-01-01,,3,\n2,Cover,0,X,,,1,1.5\n')
    write(tmp_path, "occasions", "show_number,show_id,show_date,venue_id,tour_id,show_order\n" + "".join(
        f"{i},{100 + i},2024-01-{i:02d},1,,1\n" for i in range(1, 30)))
    write(tmp_path, "plays", "uniqueid,show_id,song_id,setnumber,position,tracktime,transition_id,isreprise,isjam,footnote,"
          "isjamchart,jamchart_notes,soundcheck,isverified,isrecommended\n" + "".join(
              f"{i},{100 + i},1,1,1,,1,0,0,\"say \"\"hi\"\", you\",0,,,1,0\n" for i in range(1, 14)))
    bundle = tables.load_tables(spark, str(tmp_path), "keyed_with_repeats")
    assert bundle.venues is None and bundle.tours is None
    assert bundle.plays.first().footnote == 'say "hi", you'
    row = rankings.overdue(bundle, PRESETS["keyed_with_repeats"], AS_OF).first()
    assert (row.item, row.times_played_total, row.ltp_date, row.current_gap, row.avg_gap) == (
        "Song, One", 13, date(2024, 1, 13), 15, 1.0)


def test_excluded_layout(spark, tmp_path):
    write(tmp_path, "items", "song_id,song,original_artist,debut_date\n1,A,,\n")
    write(tmp_path, "occasions", "show_number,showid,showdate,venueid,tourid,exclude_from_stats,setlist_notes\n" + "".join(
        f"{i},{i},2024-01-{i:02d},1,7,{'1' if i == 3 else ''},\n" for i in range(1, 30)))
    header = ("showid,uniqueid,songid,set,position,transition,isreprise,isjam,isjamchart,jamchart_description,tracktime,gap,"
              "is_original,soundcheck,footnote,exclude\n")
    write(tmp_path, "plays", header + "".join(f"{i},{i},1,1,1,1,0,0,0,,,,1,,,0\n" for i in range(1, 14)))
    bundle = tables.load_tables(spark, str(tmp_path), "keyed_with_exclusions")
    row = rankings.overdue(bundle, PRESETS["keyed_with_exclusions"], AS_OF).first()
    assert (row.times_played_total, row.current_gap, row.avg_gap, row.med_gap) == (12, 15, 1.09, 1.0)


def test_dated_layout(spark, tmp_path):
    header = "Song Name,Date Played,Venue,Set,Song Before,Song After,Footnote\n"
    plays = "".join(f" A ,2024-01-{i:02d},V,1,***,***,\n" for i in range(1, 13))
    plays += "A,2024-01-05,V,e,***,***,again\nB,2024-02-20,V,1,***,***,\n,2024-02-21,V,1,***,***,\n"
    write(tmp_path, "plays", header + plays)
    bundle = tables.load_tables(spark, str(tmp_path), "named_by_date")
    row = rankings.overdue(bundle, PRESETS["named_by_date"], AS_OF).first()
    assert (row.item, row.times_played_total, row.current_gap) == ("A", 12, 1)


def test_linked_layout(spark, tmp_path):
    write(tmp_path, "occasions", "date,year,month,day,weekday,date_ec,venue,city,state,show_index_overall,"
          "show_index_withinyear,run_index,venue_full,link\n" + "".join(
              f"{'' if i == 2 else f'01/{i:02d}/24'},2024,01,{i:02d},,,V,C,S,{i},{i},1,V,u{i}\n" for i in range(1, 20)))
    plays = "song_name,set,song_index_set,song_index_show,into,link,song_note_detail\n"
    plays += "".join(f"CAN'T STOP,1,1,1,0,u{i},\n" for i in range(1, 15))
    plays += "CAN'T STOP,2,1,5,0,u3,\nJAM,1,2,2,0,u3,\nDRUMS,1,3,3,0,u3,\n"
    write(tmp_path, "plays", plays)
    bundle = tables.load_tables(spark, str(tmp_path), "named_by_link")
    spec = PRESETS["named_by_link"]
    over = rankings.overdue(bundle, spec, AS_OF).collect()
    assert [(r.item, r.times_played_total, r.ltp_date, r.current_gap) for r in over] == [
        ("Can'T Stop", 14, date(2024, 1, 14), 5)]
    rot = rankings.rotation(bundle, spec, AS_OF).collect()
    assert [(r.item, r.times_played_recent, r.ltp_date) for r in rot] == [("Can'T Stop", 13, "01/14/24")]


def test_missing_table(spark, tmp_path):
    with pytest.raises(ValueError, match="missing"):
        tables.load_tables(spark, str(tmp_path), "keyed_with_repeats")
    assert set(LAYOUTS) == set(PRESETS)


def test_envelope_and_stamps(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"id": 1, "name": "x"}, {"id": 2, "extra": 0}]}, indent=1))
    got = tables.read_envelope(spark, str(tmp_path / "a.json"), "id: int, name: string")
    assert [tuple(r) for r in got.collect()] == [(1, "x"), (2, None)]
    (tmp_path / "s.json").write_text('{"last_updated": "2025-01-01T00:00:00"}')
    (tmp_path / "e.json").write_text("{}")
    read = lambda name: tables.read_stamp(spark, str(tmp_path / name), "g").first().last_updated
    assert [read("s.json"), read("e.json"), read("none.json")] == ["2025-01-01T00:00:00", "Unknown", "Unknown"]
    tables.write_stamp(spark, str(tmp_path / "w"), datetime(2025, 2, 3, 4, 5, 6))
    assert read("w") == "2025-02-03T04:05:06"


def test_next_occasion_file(spark, tmp_path):
    occasions = spark.createDataFrame([(1, 7)], "occasion_id int, venue_id int").withColumn("occ_date", F.lit(date(2024, 4, 1)))
    venues = spark.createDataFrame([(7, "Hall", "Athens", None)], "venue_id int, venue string, city string, state string")
    path = str(tmp_path / "next")
    tables.write_next_occasion(occasions, AS_OF, path, venues)
    row = tables.read_next_occasion(spark, path).first()
    assert (row.date, row.venue_id, row.venue, row.city, row.state) == ("2024-04-01", "7", "Hall", "Athens", None)
    tables.write_next_occasion(occasions, date(2025, 1, 1), path, venues)
    assert tables.read_next_occasion(spark, path).count() == 0


def test_next_occasion_of_a_source_with_keys(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"next_show": {"showdate": "2024-04-01", "venueid": 7, "other": 1}}')
    venues = spark.createDataFrame([(7, "Hall", "Athens", "GA")], "venue_id int, venue string, city string, state string")
    path = str(tmp_path / "n.json")
    assert tuple(tables.read_next_occasion(spark, path, venues).first()) == ("2024-04-01", "7", "Hall", "Athens", "GA")
    assert tuple(tables.read_next_occasion(spark, path).first()) == ("2024-04-01", "7", None, None, None)


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('b,extra,a\n1,x,"q ""r"", s"\n2,y,t\n')
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), "a string, b int")
    assert got.columns == ["a", "b"] and [tuple(r) for r in got.collect()] == [('q "r", s', 1), ("t", 2)]
    (tmp_path / "m.csv").write_text('a,b\n"two\nlines",3\n')
    assert tables.read_csv(spark, str(tmp_path / "m.csv"), "b int, a string", multi_line=True).first().a == "two\nlines"
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "a.csv"), "a string, c int")


def test_write_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert tables.write_tables({"t": df, "u": df}, str(tmp_path)) == ["t", "u"]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    with pytest.raises(ValueError):
        tables.write_table(df, str(tmp_path / "x"), "pickle")


def test_registry():
    registry = Registry()
    with pytest.raises(TypeError):
        registry.add("not a spec", lambda: None)
    with pytest.raises(TypeError):
        registry.add(PRESETS["named_by_date"], "not callable")
    register(PRESETS["named_by_date"], lambda: None)
    assert "named_by_date" in registered()


def test_publish_keeps_order_and_names(spark, tmp_path):
    over = spark.createDataFrame([("b", 3), ("a", 9)], "item string, times_played_total int").orderBy("times_played_total")
    rot = spark.createDataFrame([("c", 5)], "item string, times_played_recent int")
    tables.publish(str(tmp_path), over, rot)
    text = "".join(p.read_text() for p in sorted((tmp_path / "overdue").glob("part-*.csv")))
    assert [ln for ln in text.splitlines() if not ln.startswith("song,")] == ["b,3", "a,9"]
    assert "song,times_played_in_last_year" in next((tmp_path / "rotation").glob("part-*.csv")).read_text()


def grid(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    out = {}
    for r in html.table_grid(df).orderBy("page_id", "table_no", "row_no").collect():
        out.setdefault((r.page_id, r.table_no), []).append(r.cells)
    return out


def test_tables_are_laid_out_with_spans_and_without_end_tags(spark):
    got = grid(
        spark,
        "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>",
        "<table><tr><td>a<td>b<tr><td>c<td>d</table> text <table><tr><th>x",
        "<table><tr><td rowspan=2>a<td colspan=2>b<tr><td>c<td>d<tr><td>e</table>",
        "<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<tr><td>e<td>f</table>",
        "<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c</table>",
        "<table><tr><td>a<td>b<td rowspan=2>c<tr><td>d<tr><td>e</table>",
        "<table><thead><tr><th>h</thead><tbody><tr></tr><tr><td colspan=0 rowspan=x>&lt;1&gt; <b>z</b></tbody></table>",
        None, "no table", "<table><caption>c</caption><TR><TD COLSPAN='2'>a</TD></TR></TABLE>")
    assert got == {
        (0, 0): [["a", "b"], ["c", "d"]], (1, 0): [["a", "b"], ["c", "d"]], (1, 1): [["x"]],
        (2, 0): [["a", "b", "b"], ["a", "c", "d"], ["e"]], (3, 0): [["a", "b", "c"], ["d", "b"], ["e", "b", "f"]],
        (4, 0): [["a", "a", "b"], ["a", "a", "c"]], (5, 0): [["a", "b", "c"], ["d", None, "c"], ["e"]],
        (6, 0): [["h"], ["<1> z"]], (9, 0): [["a", "a"]]}


def plain_grid(rows):
    """Row by row over an occupancy map."""
    taken, out = {}, []
    for r, cells in enumerate(rows):
        c = 0
        for text, columns, height in cells:
            while (r, c) in taken:
                c += 1
            for i in range(columns):
                for j in range(height):
                    taken[r + j, c + i] = text  # of two that overlap, the later one shows
            c += columns
        width = max((x for y, x in taken if y == r), default=-1) + 1
        out.append([taken.get((r, x)) for x in range(width)])
    return out


def test_random_tables_equal_an_occupancy_map(spark):
    rng = random.Random(6)
    tables_ = []
    for _ in range(40):
            tables_.append([[(f"t{rng.randint(0, 99)}", *rng.choice([(1, 1), (1, 1), (2, 1), (1, 2), (1, 3)])) for _ in range(rng.randint(1, 4))]
                        for _ in range(rng.randint(1, 5))])
    pages = ["<table>" + "".join("<tr>" + "".join(f'<td colspan="{c}" rowspan={h}>{t}' for t, c, h in row) for row in rows) + "</table>" for rows in tables_]
    got = grid(spark, *pages)
    for i, rows in enumerate(tables_):
        want = plain_grid(rows)
        assert got[(i, 0)] == want, pages[i]


# One file of each table, with what may go wrong in values.
LANDED = {
    "keyed_with_repeats": {
        "items": 'song_id,song,is_original,original_artist,debut_date,last_played,times_played,avg_show_gap\n1,"Song, ""One""",1,,2024-01-01,x,3,1.5\n2,Cover,y,X,2024-02-30,,99999999999,z\n',
        "occasions": "show_number,show_id,show_date,venue_id,tour_id,show_order\n1,101,2024-01-05,1,,1\n2,102,,,7,\n",
        "plays": "uniqueid,show_id,song_id,setnumber,position,tracktime,transition_id,isreprise,isjam,footnote,isjamchart,jamchart_notes,"
                 "soundcheck,isverified,isrecommended\n1,101,1,1,1,,1,0,0,\"two\nlines, \"\"q\"\"\",0,,,1,0\n"},
    "keyed_with_exclusions": {
        "venues": "venueid,venue,city,state,country\n1,Hall,Athens,GA,\n",
        "plays": "showid,uniqueid,songid,set,position,transition,isreprise,isjam,isjamchart,jamchart_description,tracktime,gap,"
                 "is_original,soundcheck,footnote,exclude\n1,2,3,E,1,1,0,0,0,,,,1,,,0\n"},
    "named_by_date": {
        "plays": "Song Name,Date Played,Venue,Set,Song Before,Song After,Footnote\nA,2024-01-01,V,1,***,B,\nB,,V,1,A,***,again\n"},
    "named_by_link": {
        "occasions": "date,year,month,day,weekday,date_ec,venue,city,state,show_index_overall,show_index_withinyear,run_index,venue_full,link\n"
                     "12/31/68,2068,12,31,,,V,C,S,1,1,1,V,u1\n01/01/69,1969,01,01,,,V,C,S,2,2,1,V,u2\n??/01/85,1985,,01,,??/01/85,V,C,S,3,3,1,V,u3\n",
        "plays": "song_name,set,song_index_set,song_index_show,into,link,song_note_detail\nX,1,1,1,0,u1,\n"},
}


@pytest.mark.parametrize("layout", sorted(LANDED))
def test_formats_give_the_rows_of_load_tables(spark, tmp_path, layout):
    from gapkit.sources import datasource

    shape = LAYOUTS[layout]
    for name, text in LANDED[layout].items():
        write(tmp_path, name, text)
        got = datasource.read_table(spark, str(tmp_path), layout, name)
        raw = tables.read_csv(spark, f"{tmp_path}/{FILES[name]}", shape.schemas[name], name in shape.multi_line)
        want = raw.withColumnsRenamed(shape.renames.get(name, {}))
        for column, pattern in shape.date_columns.get(name, {}).items():
            want = want.withColumn(column, (tables.parse_iso if pattern == "yyyy-MM-dd" else tables.parse_mdy2)(F.col(column)))
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr), name


def test_formats_have_a_partition_for_each_file_and_stream(spark, tmp_path):
    from gapkit.sources import datasource

    folder = tmp_path / FILES["plays"]
    folder.mkdir()
    header = LANDED["named_by_link"]["plays"].splitlines()[0]
    land = lambda i: (folder / f"part-{i}.csv").write_text(f"{header}\nX{i},1,1,1,0,u{i},\n")
    for i in range(3):
        land(i)
    df = datasource.read_table(spark, str(tmp_path), "named_by_link", "plays")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 3
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for i in (None, 3, None):
        if i is not None:
            land(i)
        stream = spark.readStream.format("gapkit_named_by_link").option("table", "plays").load(str(tmp_path))
        stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    assert sorted(r.item_id for r in spark.read.parquet(out).collect()) == ["X0", "X1", "X2", "X3"]
    with pytest.raises(Exception, match="missing"):
        datasource.read_table(spark, str(tmp_path / "none"), "named_by_link", "plays").collect()
    with pytest.raises(Exception, match="no table"):
        datasource.read_table(spark, str(tmp_path), "named_by_link", "tours").collect()


def test_formats_read_large_files_and_long_rows_in_bounded_memory(tmp_path):
    import pyarrow as pa

    from gapkit.sources import datasource

    header = LANDED["named_by_link"]["plays"].splitlines()[0]
    reader = datasource.LayoutReader("named_by_link", {"path": str(tmp_path), "table": "plays"}, datasource.table_schema("named_by_link", "plays"))
    large = tmp_path / "large.csv"
    large.write_text(header + "\n" + "".join(f"X{i},1,1,{i},0,u{i},{'n' * 8000}\n" for i in range(10000)))
    before, most, keys = pa.total_allocated_bytes(), 0, []
    for batch in reader.read(datasource.FilePartition(str(large))):
        keys += batch.column(batch.schema.get_field_index("occasion_id")).to_pylist()
        most = max(most, pa.total_allocated_bytes() - before)
    assert keys == [f"u{i}" for i in range(10000)] and most < 56 << 20  # of 80 MB
    long = tmp_path / "long.csv"  # the note of a row in the middle has more bytes than a block
    long.write_text(header + "\n" + "".join(f"X{i},1,1,{i},0,u{i},{'n,' * 5 if i != 40000 else 'n' * (20 << 20)}\n".replace("n,n,n,n,n,", '"n,\nn"') for i in range(80000)))
    found = pa.Table.from_batches(list(reader.read(datasource.FilePartition(str(long)))))
    assert found["occasion_id"].to_pylist() == [f"u{i}" for i in range(80000)] and found.num_rows == 80000


def test_each_table_is_parsed_once(spark):
    pages = spark.createDataFrame([(0, "<table><tr><td>a</table><table><tr><td COLSPAN = '2'>b<td rowspan=007>c<tr><td>d</table>")], "page_id int, html string")
    found = html.table_grid(pages)
    assert [r.cells for r in found.orderBy("table_no", "row_no").collect()] == [["a"], ["b", "b", "c"], ["d", None, "c"]]
    # once for tables with spans, once for others; not again in filters below
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?is)<tr") == 2
