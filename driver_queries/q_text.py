"""Scalar functions, pages and parsed texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.bind import table
from driver_queries.registry import query
from gapkit import functions as G
from gapkit.operators.ordered import seq_bucket
from gapkit.plans import parse
from gapkit.sources import html
from gapkit.sources.tables import read_envelope, read_optional, write_table

# --- strings -----------------------------------------------------------------------------------------------------


@query("x1_title_case", r"""SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all(lower(t), '[a-z]+|[^a-z]+'),
  lambda x: upper(x[1]) || x[2:]), '') AS title FROM (SELECT o_orderkey, 'DON''T stop ' || o_orderpriority || ' 2nd' AS t FROM orders)""")
def title_case(spark, sf_dir):
    text = F.concat(F.lit("DON'T stop "), "o_orderpriority", F.lit(" 2nd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", G.py_title(text).alias("title"))


@query("x2_letter_case", """SELECT doc_id, upper(source) AS upper_source, lower(lang) AS lower_lang,
  upper(left(source, 1)) || lower(substr(source, 2)) AS capitalized FROM documents""")
def letter_case(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.upper("source").alias("upper_source"), F.lower("lang").alias("lower_lang"),
        G.capitalize_first(F.col("source")).alias("capitalized"))


@query("x3_strip", r"""SELECT doc_id, regexp_replace(text || E' \n\t', '^\s+|\s+$', '', 'g') AS stripped,
  regexp_replace('  ' || source, '^\s+', '') AS lstripped FROM documents""")
def strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", G.strip(F.concat("text", F.lit(" \n\t"))).alias("stripped"),
        F.regexp_replace(F.concat(F.lit("  "), "source"), r"^\s+", "").alias("lstripped"))


@query("x4_literal_replace", "SELECT doc_id, replace(text, '*', '') AS plain FROM documents")
def literal_replace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("*"), F.lit("")).alias("plain"))


@query("x5_regex_replace", r"SELECT doc_id, regexp_replace(text, '[,>]$|\d+', '#', 'g') AS marked FROM documents")
def regex_replace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[,>]$|\d+", "#").alias("marked"))


@query("x6_split", """SELECT doc_id, pos - 1 AS pos, piece FROM (SELECT doc_id, unnest(string_split(text, ',')) AS piece,
  generate_subscripts(string_split(text, ','), 1) AS pos FROM documents)""")
def split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", ",")).alias("pos", "piece"))


@query("x7_right_split", """WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment || ', ' || c_name
  ELSE 'The ' || c_mktsegment || ', Hall, ' || c_name || ', N' || c_nationkey END AS s FROM customer),
p AS (SELECT c_custkey, string_split(s, ', ') AS a FROM t)
SELECT c_custkey, CASE WHEN len(a) > 2 THEN array_to_string(a[:len(a) - 2], ', ') ELSE a[1] END AS venue,
  CASE WHEN len(a) > 2 THEN a[len(a) - 1] ELSE a[2] END AS city, CASE WHEN len(a) > 2 THEN a[len(a)] END AS state FROM p""")
def right_split(spark, sf_dir):
    key = F.col("c_custkey") % 4
    text = (
        F.when(key == 0, F.col("c_mktsegment"))
        .when(key == 1, F.concat("c_mktsegment", F.lit(", "), "c_name"))
        .otherwise(F.concat(F.lit("The "), "c_mktsegment", F.lit(", Hall, "), "c_name", F.lit(", N"), "c_nationkey"))
    )
    venue, city, state = G.split_place(text)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", venue.alias("venue"), city.alias("city"), state.alias("state"))


@query("x8_extract", r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host,
  regexp_extract(url, 'page=(\d+)', 1) AS page_no FROM pages""")
def extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"),
        F.regexp_extract("url", r"page=(\d+)", 1).alias("page_no"))


@query("x9_find_all", r"""SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+)', 1)) AS word FROM documents""")
def find_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1))).alias("word"))


@query("x10_count_and_repeat", """SELECT doc_id, length(text) - length(replace(text, '*', '')) AS stars,
  repeat('*', length(text) - length(replace(text, '*', ''))) AS note_key FROM documents""")
def count_and_repeat(spark, sf_dir):
    stars = G.count_of(F.col("text"), "*")
    return table(spark, sf_dir, "documents").select(
        "doc_id", stars.alias("stars"), F.repeat(F.lit("*"), stars).alias("note_key"))


PREFIXED = """SELECT conv_id, turn, (CASE turn % 6 WHEN 0 THEN '1: ' WHEN 1 THEN 'E: ' WHEN 2 THEN '*' WHEN 3 THEN '['
  WHEN 4 THEN '12/' ELSE '' END) || text AS t FROM conversations"""


@query("x12_line_class", f"""SELECT conv_id, turn, CASE WHEN left(t, 2) IN ('0:','1:','2:','3:','4:','E:','E1','E2','E3','E4') THEN 'set'
  WHEN t LIKE '??%' OR regexp_matches(t, '^[0-9][0-9]/') THEN 'details' WHEN t LIKE '*%' THEN 'song_notes'
  WHEN t LIKE '[%' THEN 'show_notes' ELSE 'other' END AS class FROM ({PREFIXED})""")
def line_class(spark, sf_dir):
    turn = F.col("turn") % 6
    prefix = (F.when(turn == 0, "1: ").when(turn == 1, "E: ").when(turn == 2, "*").when(turn == 3, "[")
              .when(turn == 4, "12/").otherwise(""))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", parse.line_class(F.concat(prefix, "text")).alias("class"))


@query("x13_article_in_front", r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'The ' || p_name ELSE p_name END AS name,
  CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || ' hall' END AS without FROM part""")
def article_in_front(spark, sf_dir):
    size = F.col("p_size")
    name = F.when(size % 2 == 0, F.concat("p_name", F.lit(", The"))).otherwise(F.col("p_name"))
    trailing = F.when(size % 3 == 0, F.concat("p_name", F.lit(" THE"))).otherwise(F.concat("p_name", F.lit(" hall")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", G.front_article(name).alias("name"), G.trim_trailing_the(trailing).alias("without"))


@query("x14_slug", """SELECT c_custkey, concat_ws('-', lower(replace(nullif(c_mktsegment, 'BUILDING'), ' ', '-')),
  lower(replace(c_name, ' ', '-')), lower(n_name)) AS slug FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def slug(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    first = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    return joined.select("c_custkey", G.slug(first, F.col("c_name"), F.col("n_name")).alias("slug"))


@query("x15_slices", "SELECT c_custkey, substr(c_name, 10) AS tail, left(c_name, 4) AS head, c_name[2:3] AS mid FROM customer")
def slices(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.substring("c_name", 10, 2**31 - 1).alias("tail"), F.left("c_name", F.lit(4)).alias("head"),
        F.substring("c_name", 2, 2).alias("mid"))


@query("x17_contains", """SELECT doc_id, contains(text, '***') AS has_stars, starts_with(source, 'w') AS starts_w,
  ends_with(text, '.') AS ends_dot FROM documents""")
def contains(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.contains("***").alias("has_stars"), F.col("source").startswith("w").alias("starts_w"),
        text.endswith(".").alias("ends_dot"))


@query("x18_join_and_format", """SELECT c_custkey, concat_ws(', ', c_name, c_mktsegment, n_name) AS joined,
  printf('%s (%05d)', c_name, c_custkey) AS formatted FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def join_and_format(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", F.concat_ws(", ", "c_name", "c_mktsegment", "n_name").alias("joined"),
                         F.format_string("%s (%05d)", "c_name", "c_custkey").alias("formatted"))


# --- dates -------------------------------------------------------------------------------------------------------


@query("d1_parse_dates", """SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END, '%Y-%m-%d') AS day
FROM orders""")
def parse_dates(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 5 > 0, F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd")).otherwise("2001-02-31")
    return table(spark, sf_dir, "orders").select("o_orderkey", G.parse_iso(text).alias("day"))


SHORT = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '00/00/' || yy WHEN 1 THEN '00/17/' || yy WHEN 2 THEN mm || '/00/' || yy
  ELSE mm || '/' || dd || '/' || yy END AS s FROM (SELECT o_orderkey, strftime(o_orderdate, '%m') AS mm, strftime(o_orderdate, '%d') AS dd,
  lpad(CAST((year(o_orderdate) + o_orderkey * 7) % 100 AS VARCHAR), 2, '0') AS yy FROM orders)"""
BAD_DAY = "s[:2] = '00' OR s[4:5] = '00' OR (s[:5] = '02/29' AND try_cast(c || yy || '-02-29' AS DATE) IS NULL)"
EXPANDED = f"""SELECT *, s[7:8] AS yy, CASE WHEN s[7:8] >= '69' THEN '19' ELSE '20' END AS c FROM ({SHORT})"""


def _short_dates(spark, sf_dir):
    day = F.to_date("o_orderdate")
    year = F.lpad(((F.year(day) + F.col("o_orderkey") * 7) % 100).cast("string"), 2, "0")
    month, dom, case = F.date_format(day, "MM"), F.date_format(day, "dd"), F.col("o_orderkey") % 6
    text = (
        F.when(case == 0, F.concat(F.lit("00/00/"), year)).when(case == 1, F.concat(F.lit("00/17/"), year))
        .when(case == 2, F.concat(month, F.lit("/00/"), year)).otherwise(F.concat_ws("/", month, dom, year))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("s"))


@query("d3_two_digit_years", f"""SELECT o_orderkey, CASE WHEN {BAD_DAY} THEN NULL ELSE c || yy || '-' || s[:2] || '-' || s[4:5] END AS day
FROM ({EXPANDED})""")
def two_digit_years(spark, sf_dir):
    return _short_dates(spark, sf_dir).select("o_orderkey", G.parse_mdy2(F.col("s")).alias("day"))


@query("d4_date_arithmetic", """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 366, '%Y-%m-%d') AS year_before,
  strftime(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH, '%Y-%m-%d') AS twelve_months_before,
  date_diff('day', DATE '1999-12-31', CAST(o_orderdate AS DATE)) AS days FROM orders""")
def date_arithmetic(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", G.days_before(day, 366).alias("year_before"), F.add_months(day, -12).alias("twelve_months_before"),
        F.datediff(day, F.lit("1999-12-31").cast("date")).alias("days"))


@query("d6_weekday_and_formats", """SELECT o_orderkey, strftime(o_orderdate, '%A') AS weekday, strftime(o_orderdate, '%m/%d/%y') AS short_day,
  lower(strftime(o_orderdate, '%B-%-d-%Y')) AS slug_day, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders""")
def weekday_and_formats(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", G.weekday_name(day).alias("weekday"), G.format_day(day, "MM/dd/yy").alias("short_day"),
        G.format_slug_day(day).alias("slug_day"), F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"))


@query("d8_date_key_and_label", f"""WITH e AS ({EXPANDED}), k AS (SELECT *, CASE WHEN yy[1] IN ('8', '9') THEN '19' WHEN yy[1] IN ('0', '1', '2') THEN '20'
  ELSE '' END || yy || s[:2] || s[4:5] AS key FROM e)
SELECT o_orderkey, key AS day_key, CASE WHEN s[:2] = '00' AND s[4:5] = '00' THEN '??/??/' || yy WHEN s[:2] = '00' THEN '??/' || s[4:5] || '/' || yy
  WHEN s[4:5] = '00' THEN s[:2] || '/??/' || yy WHEN {BAD_DAY} THEN NULL ELSE c || yy || '-' || s[:2] || '-' || s[4:5] END AS day_label FROM k""")
def date_key_and_label(spark, sf_dir):
    s = F.col("s")
    label = G.partial_date_label(G.parse_mdy2(s), F.substring(s, 7, 2), F.substring(s, 1, 2), F.substring(s, 4, 2))
    return _short_dates(spark, sf_dir).select("o_orderkey", G.date_key(s).alias("day_key"), label.alias("day_label"))


@query("d10_time_stamps", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, strftime(ts, '%B %d, %Y') AS shown FROM events""")
def time_stamps(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.date_format(ts, "MMMM dd, yyyy").alias("shown"))


# --- numbers, arrays, JSON ---------------------------------------------------------------------------------------


@query("m1_round_half_even", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
  (CASE WHEN y - floor(y) = 0.5 THEN floor(y) + abs(floor(y) % 2) ELSE round(y) END) / 100 AS rounded
FROM (SELECT *, ((l_quantity / 8) * 100) AS y FROM lineitem)""")
def round_half_even(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", G.round2(F.col("l_quantity") / 8).alias("rounded"))


@query("m2_guarded_division", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax <> 0 THEN (l_discount - 0.05) / l_tax
  WHEN l_discount > 0.05 THEN 'inf'::DOUBLE WHEN l_discount < 0.05 THEN '-inf'::DOUBLE END AS z FROM lineitem""")
def guarded_division(spark, sf_dir):
    z = G.gap_zscore(F.col("l_discount"), F.lit(0.05), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", z.alias("z"))


@query("r2_alternate_elements", """WITH t AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents)
SELECT doc_id, len(a) AS n, array_to_string(list_filter(a, lambda x, i: i % 2 = 1), '|') AS keys,
  array_to_string(list_filter(a, lambda x, i: i % 2 = 0), '|') AS vals,
  array_to_string(list_filter(a, lambda x: starts_with(x, 'e')), '|') AS with_e FROM t""")
def alternate_elements(spark, sf_dir):
    words = F.split("text", " ")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(words).alias("n"), F.array_join(G.even_elements(words), "|").alias("keys"),
        F.array_join(G.odd_elements(words), "|").alias("vals"),
        F.array_join(F.filter(words, lambda w: w.startswith("e")), "|").alias("with_e"))


@query("r4_zip_lists", """SELECT doc_id, pos - 1 AS pos, a, b FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS a,
  unnest(string_split(replace(text, 'e', 'E'), ' ')) AS b, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents)""")
def zip_lists(spark, sf_dir):
    zipped = F.arrays_zip(F.split("text", " ").alias("a"), F.split(F.replace("text", F.lit("e"), F.lit("E")), " ").alias("b"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(zipped).alias("pos", "z")).select(
        "doc_id", "pos", "z.a", "z.b")


@query("k1_map_lookup", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders""")
def map_lookup(spark, sf_dir):
    codes = F.create_map(F.lit("F"), F.lit(1), F.lit("O"), F.lit(2))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_element_at(codes, F.col("o_orderstatus")).alias("code"))


@query("k2_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  '{"next":{"id":' || event_id || ',"type":"' || event_type || '"}}' AS document FROM events""")
def json_fields(spark, sf_dir):
    parsed = F.from_json("props", "k int")
    document = F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")).alias("next")))
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), document.alias("document"))


# --- sources -----------------------------------------------------------------------------------------------------


def _scratch(spark) -> str:
    """A new folder beside the checkpoints, which all executors can reach."""
    import uuid
    from gapkit.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


@query("s1_csv_round_trip", """SELECT o_orderkey AS occasion_id, strftime(o_orderdate, '%Y-%m-%d') AS occ_date, o_orderpriority AS note, o_totalprice
FROM orders""")
def csv_round_trip(spark, sf_dir):
    path = f"{_scratch(spark)}/orders"
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("occasion_id"), F.to_date("o_orderdate").alias("occ_date"),
        F.col("o_orderpriority").alias("note"), "o_totalprice")
    write_table(orders, path, "csv")
    return read_optional(spark, path, "occasion_id long, occ_date date, note string, o_totalprice double")


@query("s3_missing_table", "SELECT o_orderkey FROM orders")
def missing_table(spark, sf_dir):
    absent = read_optional(spark, f"{sf_dir}/venuedata.csv", "venue_id int")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders if absent is None else orders.limit(0)


@query("s5_json_envelope", """SELECT c_custkey AS venue_id, c_name AS venue, c_acctbal AS balance FROM customer""")
def json_envelope(spark, sf_dir):
    path = f"{_scratch(spark)}/venues"
    row = F.struct(F.col("c_custkey").alias("venue_id"), F.col("c_name").alias("venue"), F.col("c_acctbal").alias("balance"))
    documents = table(spark, sf_dir, "customer").select(F.array(row).alias("data"))
    documents.select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    return read_envelope(spark, path, "venue_id: bigint, venue: string, balance: double", multi_line=False)


@query("s6_json_metadata", """SELECT c_name AS source, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE 'day ' || c_nationkey END
  AS last_updated FROM customer""")
def json_metadata(spark, sf_dir):
    path = f"{_scratch(spark)}/stamps"
    stamp = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("day "), "c_nationkey"))
    table(spark, sf_dir, "customer").select(F.col("c_name").alias("source"), stamp.alias("last_updated")).write.json(path)
    stored = spark.read.schema("source string, last_updated string").json(path)
    return stored.select("source", F.coalesce("last_updated", F.lit("Unknown")).alias("last_updated"))


@query("s11_partitioned_table", "SELECT doc_id, n_chars, lang FROM documents WHERE lang = 'de'")
def partitioned_table(spark, sf_dir):
    path = f"{_scratch(spark)}/documents"
    write_table(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), path, partition_by=("lang",))
    return spark.read.parquet(path).where("lang = 'de'").select("doc_id", "n_chars", "lang")


@query("s7_page_rows", r"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:li)\b[^>]*>(.*?)</(?:li)>', 1)) AS row_html,
  generate_subscripts(regexp_extract_all(html, '(?is)<(?:li)\b[^>]*>(.*?)</(?:li)>', 1), 1) - 1 AS row_no FROM pages)
SELECT page_id, row_no, array_to_string(list_transform(regexp_extract_all(row_html, '(?is)<(?:a)\b[^>]*>(.*?)</(?:a)>', 1),
  lambda c: trim(replace(replace(replace(replace(replace(replace(regexp_replace(c, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))), '|') AS cells FROM r""")
def page_rows(spark, sf_dir):
    rows = html.page_rows(table(spark, sf_dir, "pages"), row_tag="li", cell_tag="a")
    return rows.select("page_id", "row_no", F.array_join("cells", "|").alias("cells"))


@query("s8_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target,
  generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) - 1 AS link_no FROM pages""")
def page_links(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages"))


@query("s9_quoted_title", r"""WITH t AS (SELECT page_id, regexp_extract(regexp_extract(
  CASE WHEN page_id % 2 = 0 THEN regexp_replace(html, '<title>(.*?)</title>', '<title>All "\1" plays</title>') ELSE html END,
  '(?is)<title[^>]*>(.*?)</title>', 1), '"(.*?)"', 1) AS q FROM pages)
SELECT page_id, CASE WHEN q = '' THEN 'Unknown Title' ELSE q END AS title FROM t""")
def quoted_title(spark, sf_dir):
    quoted = F.regexp_replace("html", "<title>(.*?)</title>", '<title>All "$1" plays</title>')
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 2 == 0, quoted).otherwise(F.col("html")))
    return html.quoted_title(pages)


@query("s10_header_row", """SELECT c_custkey AS page_id, CAST(1 AS INTEGER) AS row_no, c_name AS "Song Name", CAST(c_acctbal AS VARCHAR) AS "Last Played",
  CAST(NULL AS VARCHAR) AS "Debut" FROM customer""")
def header_row(spark, sf_dir):
    markup = F.concat(
        F.lit("<p>x</p><table><tr><td>0</td></tr></table><table><tr><th>Last Played</th><th>Song Name</th></tr><tr><td><b>"),
        F.col("c_acctbal").cast("string"), F.lit("</b></td><td> "), "c_name", F.lit(" </td></tr></table>"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), markup.alias("html"))
    return html.with_header(pages, ["Song Name", "Last Played", "Debut"], table_no=1)


@query("s7_table_grid", """WITH c AS (SELECT c_custkey AS page_id, c_name AS n, CAST(c_acctbal AS VARCHAR) AS b, c_mktsegment AS m FROM customer)
SELECT page_id, CAST(0 AS INTEGER) AS table_no, CAST(r AS INTEGER) AS row_no, cells FROM (
  SELECT page_id, 0 AS r, 'Song|Plays|Plays' AS cells FROM c UNION ALL SELECT page_id, 1, n || '|' || b || '|x' FROM c
  UNION ALL SELECT page_id, 2, n || '|' || m || '|' || m FROM c UNION ALL SELECT page_id, 3, 'last|' || m || '|' || m FROM c)""")
def table_grid(spark, sf_dir):
    """Tables without end tags, with cells over several columns and rows."""
    markup = F.concat(
        F.lit("<h1>x</h1><table class='a'><thead><tr><th>Song<th colspan=2>Plays<tbody><tr><td rowspan=\"2\"><b>"), "c_name",
        F.lit("</b><td>"), F.col("c_acctbal").cast("string"), F.lit("<td>x</td><TR><TD colspan='2' rowspan='2'> "), "c_mktsegment",
        F.lit(" <tr><td>last</table><p>end"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), markup.alias("html"))
    return html.table_grid(pages).select("page_id", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


# --- parsed texts ------------------------------------------------------------------------------------------------

LINE_SQL = """l AS (SELECT doc_id AS occasion_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
s AS (SELECT occasion_id, line_no, CASE line_no % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'E' END AS set_label,
  string_split(replace(replace(replace(' ' || replace(line, 'ß', 'ss'), 'ï', 'i'), '. ', ' > '), '>', ',>'), ',') AS a FROM l WHERE line_no % 4 < 3),
k AS (SELECT occasion_id, line_no, set_label, list_filter(a, lambda p, i: NOT (regexp_matches(p, 'leaux|Rattle')
  AND coalesce(regexp_replace(replace(list_filter(a[1:i - 1], lambda q: NOT regexp_matches(q, 'leaux|Rattle'))[-1], '>', ''),
    '^[ \\t\\n\\r\\f\\v]+', '') = 'The', false))) AS a FROM s),
x AS (SELECT occasion_id, line_no, set_label, a, unnest(a) AS piece, generate_subscripts(a, 1) AS i FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY occasion_id ORDER BY line_no, i) AS position,
  row_number() OVER (PARTITION BY occasion_id, set_label ORDER BY line_no, i) AS position_in_set,
  regexp_replace(replace(piece, '>', ''), '^[ \\t\\n\\r\\f\\v]+', '') AS raw FROM x),
y AS (SELECT *, CASE raw WHEN 'The' THEN 'The Completed' ELSE raw END AS full_raw FROM n)"""


def _set_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("occasion_id"), F.posexplode(F.split("text", "\n")).alias("p", "line")
    ).withColumn("line_no", F.col("p") + 1)
    case = F.col("line_no") % 4
    prefix = F.when(case == 0, "1: ").when(case == 1, "2: ").when(case == 2, "E: ").otherwise("Notes ")
    return lines.select("occasion_id", "line_no", F.concat(
        # DuckDB has its own capital of the sharp s
        prefix, F.lit(" "), F.replace(F.replace("line", F.lit("ß"), F.lit("ss")), F.lit(". "), F.lit(" > "))
    ).alias("text"))


@query("c13_setlist_text", f"""WITH {LINE_SQL}
SELECT occasion_id, line_no, set_label, position, position_in_set, upper(replace(trim(full_raw, ' ' || chr(9) || chr(13)), '*', '')) AS item,
  CASE WHEN contains(piece, '>') THEN 1 ELSE 0 END AS segue_in,
  CASE WHEN coalesce(contains(a[i + 1], '>'), false) THEN 1 ELSE 0 END AS segue_out,
  repeat('*', length(full_raw) - length(replace(full_raw, '*', ''))) AS note_key FROM y""")
def setlist_text(spark, sf_dir):
    return parse.parse_setlist(
        _set_lines(spark, sf_dir), fragments=("leaux", "Rattle"), titles={"The": "The Completed"}, repairs={})


@query("c14_star_notes", r"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(' ' || replace(text, '#', '['), '(\*+|\[|[^*\[]+)', 1),
  lambda x: starts_with(x, ' ') OR starts_with(x, '*')) AS a FROM documents),
p AS (SELECT doc_id, list_filter(a, lambda x, i: i % 2 = 1) AS k, list_filter(a, lambda x, i: i % 2 = 0) AS d FROM t)
SELECT doc_id, note_no, note_key, detail FROM (SELECT doc_id, unnest(k[:len(d)]) AS note_key, unnest(d) AS detail,
  generate_subscripts(d, 1) - 1 AS note_no FROM p)""")
def star_notes(spark, sf_dir):
    text = F.concat(F.lit(" "), F.replace("text", F.lit("#"), F.lit("[")))
    return parse.star_notes(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


@query("c14_numbered_notes", r"""WITH t AS (SELECT conv_id, turn, string_split(text, '.') AS a FROM conversations)
SELECT conv_id, turn, note_no, CAST(note_no + 1 AS VARCHAR) AS ref, regexp_replace(detail, '^\s+|\s+$', '', 'g') AS detail
FROM (SELECT conv_id, turn, unnest(a) AS detail, generate_subscripts(a, 1) - 1 AS note_no FROM t)""")
def numbered_notes(spark, sf_dir):
    numbered = F.array_join(F.transform(
        F.split("text", r"\."), lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "")
    texts = table(spark, sf_dir, "conversations").select("conv_id", "turn", numbered.alias("text"))
    return parse.numbered_notes(texts)


@query("j12_page_plays", """WITH b AS (SELECT conv_id, turn // 3 AS par, turn, CASE WHEN turn % 3 = 0 THEN 'Set ' || (turn // 3 + 1) END AS label,
  regexp_replace(role || ',', '[,>]$', '') || turn AS item FROM conversations),
f AS (SELECT conv_id, turn, string_agg(coalesce(t, ''), ' ' ORDER BY pos) AS footnote FROM (
  SELECT b.conv_id, b.turn, pos, d.t FROM (SELECT conv_id, turn, unnest([turn + 2, turn]) AS ref, unnest([0, 1]) AS pos FROM b) b
  LEFT JOIN (SELECT conv_id, turn, role || '-' || turn AS t FROM conversations) d ON d.conv_id = b.conv_id AND d.turn = b.ref)
  GROUP BY 1, 2)
SELECT conv_id AS occasion_id, par AS paragraph_no, turn AS box_no, CASE WHEN set_label IN ('Set 1', 'Set 2', 'Set 3') THEN set_label[5:]
  ELSE set_label END AS set_label, item, item_before, item_after, trim(footnote) AS footnote FROM (SELECT *,
  last_value(label IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS set_label,
  lag(item, 1, '***') OVER (PARTITION BY conv_id, par ORDER BY turn) AS item_before,
  lead(item, 1, '***') OVER (PARTITION BY conv_id, par ORDER BY turn) AS item_after FROM b) JOIN f USING (conv_id, turn)""")
def page_plays(spark, sf_dir):
    turn = F.col("turn")
    turns = table(spark, sf_dir, "conversations")
    boxes = turns.select(
        F.col("conv_id").alias("occasion_id"), F.floor(turn / 3).alias("paragraph_no"), turn.alias("box_no"),
        F.when(turn % 3 == 0, F.concat(F.lit("Set "), F.floor(turn / 3) + 1)).alias("label"),
        F.concat("role", turn, F.lit(",")).alias("item"), F.array(turn + 2, turn).alias("refs"))
    details = turns.select(
        F.col("conv_id").alias("occasion_id"), turn.alias("ref"), F.concat_ws("-", "role", "turn").alias("detail"))
    return parse.page_plays(boxes, details)


SCHEDULE = """e AS (SELECT o_orderkey, 0 AS entry_no, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%m/00/%y')
    ELSE strftime(o_orderdate, '%m/%d/%y') END AS day_text, c_name || ', Hall, ' || c_mktsegment || ', N' || c_nationkey AS venue_full
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT o_orderkey, 1, strftime(CAST(o_orderdate AS DATE) + 1, '%m/%d/%y'), c_mktsegment || ', N' || c_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _schedules(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    day = F.to_date("o_orderdate")
    first = F.when(F.col("o_orderkey") % 7 == 0, F.date_format(day, "MM/'??'/yy")).otherwise(F.date_format(day, "MM/dd/yy"))
    state = F.concat(F.lit("N"), "c_nationkey")
    return orders.select("o_orderkey", F.concat(
        first, F.lit(" "), "c_name", F.lit(", Hall, "), "c_mktsegment", F.lit(", "), state, F.lit("  "),
        F.date_format(F.date_add(day, 1), "MM/dd/yy"), F.lit(" "), "c_mktsegment", F.lit(", "), state).alias("text"))


@query("c15_schedule_text", f"WITH {SCHEDULE} SELECT o_orderkey, entry_no, day_text, venue_full FROM e")
def schedule_text(spark, sf_dir):
    return parse.parse_schedule(_schedules(spark, sf_dir))


@query("c15_schedule_occasions", f"""WITH {SCHEDULE},
k AS (SELECT *, CASE WHEN day_text[7:7] IN ('8', '9') THEN '19' ELSE '20' END || day_text[7:8] || day_text[:2] || day_text[4:5] AS key,
  string_split(venue_full, ', ') AS a FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o_orderkey, entry_no) AS r,
  CASE WHEN day_text[4:5] <> '00' THEN strptime(day_text, '%m/%d/%y') END AS d FROM k)
SELECT o_orderkey, entry_no, 'u/' || key || chr(CAST(96 + r AS INTEGER)) || '.asp' AS occasion_id, strftime(d, '%Y-%m-%d') AS occ_date,
  key[:4] AS year, key[5:6] AS month, key[7:8] AS day, strftime(d, '%A') AS weekday,
  CASE WHEN d IS NULL THEN day_text[:2] || '/??/' || day_text[7:8] ELSE strftime(d, '%Y-%m-%d') END AS day_label,
  upper(CASE WHEN len(a) > 2 THEN array_to_string(a[:len(a) - 2], ', ') ELSE a[1] END) AS venue,
  upper(CASE WHEN len(a) > 2 THEN a[len(a) - 1] ELSE a[2] END) AS city, CASE WHEN len(a) > 2 THEN a[len(a)] END AS state FROM n""")
def schedule_occasions(spark, sf_dir):
    entries = parse.parse_schedule(_schedules(spark, sf_dir))
    occasions = parse.schedule_occasions(
        entries, ["o_orderkey", "entry_no"], seq_bucket("o_orderkey"), link_prefix="u/", link_suffix=".asp")
    return occasions.select("o_orderkey", "entry_no", "occasion_id", "occ_date", "year", "month", "day", "weekday",
                            "day_label", "venue", "city", "state")


@query("c16_linked_calendar", f"""WITH {SCHEDULE},
k AS (SELECT *, CASE WHEN day_text[7:7] IN ('8', '9') THEN '19' ELSE '20' END || day_text[7:8] || day_text[:2] || day_text[4:5] AS key,
  string_split(venue_full, ', ') AS a FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o_orderkey, entry_no) AS r,
  upper(CASE WHEN len(a) > 2 THEN array_to_string(a[:len(a) - 2], ', ') ELSE a[1] END) AS venue,
  row_number() OVER (ORDER BY o_orderkey, entry_no) AS occ_seq,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY entry_no) AS seq_in_year,
  CASE WHEN day_text[4:5] <> '00' THEN CAST(strptime(day_text, '%m/%d/%y') AS DATE) END AS d FROM k),
v AS (SELECT *, CASE WHEN lag(venue) OVER (ORDER BY occ_seq) = venue THEN 0 ELSE 1 END AS brk FROM n),
g AS (SELECT *, sum(brk) OVER (ORDER BY occ_seq) AS run_index FROM v)
SELECT key || chr(CAST(96 + r AS INTEGER)) AS occasion_id, strftime(d, '%Y-%m-%d') AS occ_date, venue, occ_seq, seq_in_year, run_index
FROM g WHERE d <= (SELECT min(d) FROM g WHERE d >= DATE '2000-06-15')""")
def linked_calendar(spark, sf_dir):
    from gapkit.plans.calendar import linked_calendar as build
    schedules = _schedules(spark, sf_dir).withColumnRenamed("o_orderkey", "list_year")
    return build(schedules, "2000-06-15").select("occasion_id", "occ_date", "venue", "occ_seq", "seq_in_year", "run_index")
