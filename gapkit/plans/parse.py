"""Landed text to rows: set lists, footnotes and schedules.

Each text is split inside its own row with array functions. Only positions across the lines of an occasion
need an order, and they come from running item counts per line.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from gapkit.functions import (
    capitalize_first, count_of, date_key, even_elements, front_article, odd_elements, ordinal_letter, parse_mdy2,
    partial_date_label, split_place, strip, trim_trailing_the, weekday_name,
)
from gapkit.operators.lookups import map_or_self
from gapkit.operators.notes import resolve_references
from gapkit.operators.ordered import carry_forward, neighbour_values, row_ordinal, running_sums, seq_bucket

# Markers and name repairs of set-list text. Fixed values.
SET_PREFIXES = ("0:", "1:", "2:", "3:", "4:", "E:", "E1", "E2", "E3", "E4")
COMMA_FRAGMENTS = (
    "Guns", "And Money", "Let Me Follow You Down", "Let Me Hold Your Hand", "Please Don't Go", "Rattle",
    "And Roll", "Narrow Mind", "Woman Smarter",
)
COMMA_TITLES = {
    "Lawyers": "Lawyers Guns And Money",
    "Baby": "One of the 3 Baby Songs",
    "Shake": "Shake, Rattle, And Roll",
    "Weak Brain": "Weak Brain, Narrow Mind",
    "Man Smart": "Man Smart, Woman Smarter",
}
ITEM_REPAIRS = {
    "???": "JAM",
    "ARU/WSP JAM": "JAM",
    "THIS MUST BE THE PLACE (NA<EF>VE MELODY)": "THIS MUST BE THE PLACE (NAIEVE MELODY)",
    "W<CR>M": "WURM",
}
TEXT_REPAIRS = {"ï": "i"}
DAY_PATTERN = r"\d{2}/\d{2}/\d{2}"
NO_NEIGHBOUR = "***"
SET_NAMES = (("Encore", "e"), ("Set 1", "1"), ("Set 2", "2"), ("Set 3", "3"))
VENUE_TEXT_REPAIRS = {
    "Express Live, Columbus, OH": "Express Live!, Columbus, OH",
    "Kemba Live, Columbus, OH": "KEMBA Live!, Columbus, OH",
    "Ram's Head Live, Baltimore, MD": "Ram's Head Live!, Baltimore, MD",
    "Virginia Credit Union Live, Richmond, VA": "Virginia Credit Union Live!, Richmond, VA",
}
VENUE_ADDRESS_MARKS = (("&", "amp"), ("'", "039"), ("!", ""))


def line_class(text: Column) -> Column:
    """``set``, ``details``, ``song_notes``, ``show_notes`` or ``other``."""
    return (
        F.when(F.left(text, F.lit(2)).isin(*SET_PREFIXES), F.lit("set"))
        .when(text.startswith("??") | text.rlike(r"^\d{2}/"), F.lit("details"))
        .when(text.startswith("*"), F.lit("song_notes"))
        .when(text.startswith("["), F.lit("show_notes"))
        .otherwise(F.lit("other"))
    )


def set_label(text: Column) -> Column:
    """Label of a set line without its colon: 0-4, E, E1-E4."""
    return F.regexp_replace(F.left(text, F.lit(3)), r"[:\s]+$", "")


def short_set_name(label: Column) -> Column:
    """``Set 1`` to 1, ``Encore`` to e, others unchanged."""
    chain = F
    for part, short in SET_NAMES:
        chain = chain.when(label.contains(part), F.lit(short))
    return chain.otherwise(label)


def _bare(piece: Column) -> Column:
    """A piece of a set line without segue marks and leading blanks."""
    return F.regexp_replace(F.replace(piece, F.lit(">"), F.lit("")), r"^\s+", "")


def _whole_titles(pieces: Column, fragments: Sequence[str], heads: Sequence[str]) -> Column:
    """Drop the pieces that go on with a title whose first piece is one of ``heads``."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit("").alias("last"))

    def step(s: Column, piece: Column) -> Column:
        fragment = reduce(or_, [F.contains(piece, F.lit(f)) for f in fragments])
        goes = fragment & s["last"].isin(*heads)
        return F.struct(F.when(goes, s["kept"]).otherwise(F.concat(s["kept"], F.array(piece))).alias("kept"),
                        F.when(goes, s["last"]).otherwise(_bare(piece)).alias("last"))

    return F.aggregate(pieces, start, step, lambda s: s["kept"])


def parse_setlist(
    lines: DataFrame, *, fragments: Sequence[str] = (), titles: Mapping[str, str] | None = None,
    repairs: Mapping[str, str] | None = None,
) -> DataFrame:
    """Plays out of set lines ``(occasion_id, line_no, text)``.

    A line looks like ``1: A > B, C*``. Commas part the items; ``>`` leads on to the next one: the item before
    it has ``segue_out``, the one after it ``segue_in``. Stars point to a footnote.

    Titles that hold commas are listed by their first piece in ``titles``, which completes it; pieces after it that contain
    one of ``fragments`` belong to the title and are dropped. Elsewhere such a piece is an item. The lists of the one
    known source are ``COMMA_TITLES``, ``COMMA_FRAGMENTS`` and ``ITEM_REPAIRS``.

    Lines with items are shuffled once, by occasion and 65,536 lines of it, however long a text is.
    """
    titles, repairs = titles or {}, repairs or {}
    text = F.col("text")
    for old, new in TEXT_REPAIRS.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    body = F.replace(F.substring(F.col("__text"), 4, 2**31 - 1), F.lit(">"), F.lit(",>"))
    pieces = F.split(body, ",")
    if fragments and titles:
        pieces = _whole_titles(pieces, fragments, list(titles))
    sets = (
        lines.select("occasion_id", "line_no", text.alias("__text"))
        .where(line_class(F.col("__text")) == "set")
        .select("occasion_id", "line_no", set_label(F.col("__text")).alias("set_label"), pieces.alias("__pieces"))
        .withColumn("__n", F.size("__pieces"))
    )
    # each text is split once, and its occasion's lines are dealt out once
    counted = running_sums(
        sets, ["occasion_id"], "set_label", ["line_no"], "__n", "__upto", "__set_upto", seq_bucket("line_no"))

    following = F.try_element_at(F.col("__pieces"), F.col("__pos") + 2)
    raw = _bare(F.col("__piece"))
    name = strip(capitalize_first(map_or_self(F.col("__raw"), titles)))
    stars = count_of(F.col("__name"), "*")
    return (
        counted.select("*", F.posexplode("__pieces").alias("__pos", "__piece"))
        .withColumns({
            "segue_in": F.col("__piece").contains(">").cast("int"),
            "segue_out": F.coalesce(following.contains(">"), F.lit(False)).cast("int"),
            "position": (F.col("__upto") - F.col("__n") + F.col("__pos") + 1).cast("int"),
            "position_in_set": (F.col("__set_upto") - F.col("__n") + F.col("__pos") + 1).cast("int"),
            "__raw": raw,
        })
        .withColumn("__name", name)
        .withColumn("note_key", F.repeat(F.lit("*"), stars))
        .withColumn("item", map_or_self(F.upper(F.replace(F.col("__name"), F.lit("*"), F.lit(""))), repairs))
        .select(
            "occasion_id", "line_no", "set_label", "position", "position_in_set", "item",
            "segue_in", "segue_out", "note_key",
        )
    )


def star_notes(notes: DataFrame, text: str = "text") -> DataFrame:
    """``* with guest ** second [show note]`` to one row per key, with its pieces in order.

    The text is cut at runs of stars and at ``[``. Pieces that start with a blank or a star count; they
    alternate between key and detail. A last key without a detail is left out.
    """
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"(\*+|\[|[^*\[]+)"), F.lit(1))
    kept = F.filter(tokens, lambda t: t.startswith(" ") | t.startswith("*"))
    pairs = F.arrays_zip(even_elements(kept).alias("note_key"), odd_elements(kept).alias("detail"))
    keys = [c for c in notes.columns if c != text]
    return (
        notes.select(*keys, F.posexplode(pairs).alias("note_no", "__p"))
        .select(*keys, "note_no", F.col("__p.note_key").alias("note_key"), F.col("__p.detail").alias("detail"))
        .where(F.col("detail").isNotNull())
    )


def numbered_notes(notes: DataFrame, text: str = "text") -> DataFrame:
    """``[1] x [2] y`` to rows of reference and detail."""
    pattern = r"(?s)\[(\d+)\](.*?)(?=\[\d+\]|$)"
    refs = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    details = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2))
    keys = [c for c in notes.columns if c != text]
    return notes.select(
        *keys, F.posexplode(F.arrays_zip(refs.alias("ref"), details.alias("detail"))).alias("note_no", "__p")
    ).select(*keys, "note_no", F.col("__p.ref").alias("ref"), strip(F.col("__p.detail")).alias("detail"))


def parse_schedule(schedules: DataFrame, text: str = "text") -> DataFrame:
    """Dates and places of a running text, zipped in order.

    ``MM/dd/yy place MM/dd/yy place ...``, unknown parts written ``??`` come out as ``00``.
    """
    blob = F.replace(F.col(text), F.lit("??"), F.lit("00"))
    days = F.regexp_extract_all(blob, F.lit(f"({DAY_PATTERN})"), F.lit(1))
    places = F.filter(F.transform(F.split(blob, DAY_PATTERN), strip), lambda p: p != "")
    keys = [c for c in schedules.columns if c != text]
    zipped = F.arrays_zip(days.alias("day_text"), places.alias("venue_full"))
    return schedules.select(*keys, F.posexplode(zipped).alias("entry_no", "__e")).select(
        *keys, "entry_no", F.col("__e.day_text").alias("day_text"), F.col("__e.venue_full").alias("venue_full")
    )


def schedule_occasions(
    entries: DataFrame, order: Sequence[str], bucket: Column, link_prefix: str = "", link_suffix: str = ""
) -> DataFrame:
    """Occasion columns of parsed schedule entries: link, date parts, labels and place.

    Several occasions of one day get the letters a, b, ... in ``order``; ``bucket`` rises with its first column.
    """
    keyed = entries.withColumn("day_key", date_key(F.col("day_text")))
    lettered = row_ordinal(keyed, ["day_key"], list(order), "__n", bucket, share=True)
    venue, city, state = split_place(F.col("venue_full"))
    dated = lettered.withColumns({
        "occasion_id": F.concat(
            F.lit(link_prefix), F.col("day_key"), ordinal_letter(F.col("__n")), F.lit(link_suffix)
        ),
        "occ_date": parse_mdy2(F.col("day_text")),
        "year": F.regexp_extract("day_key", r"(\d{4})(\d{2})(\d{2})", 1),
        "month": F.regexp_extract("day_key", r"(\d{4})(\d{2})(\d{2})", 2),
        "day": F.regexp_extract("day_key", r"(\d{4})(\d{2})(\d{2})", 3),
        "venue": F.upper(venue), "city": F.upper(city), "state": state,
        "venue_full": F.upper("venue_full"),
    })
    return dated.withColumns({
        "weekday": weekday_name(F.col("occ_date")),
        "day_label": partial_date_label(F.col("occ_date"), F.col("year"), F.col("month"), F.col("day")),
    }).drop("__n", "day_key")


def item_text(text: Column) -> Column:
    """Item name as printed in a set list, without a trailing comma or segue mark."""
    return strip(F.regexp_replace(strip(text), "[,>]$", ""))


def venue_key_text(venue: Column) -> Column:
    """Venue name as used in page addresses."""
    fronted = front_article(venue)
    for old, new in VENUE_ADDRESS_MARKS:
        fronted = F.replace(fronted, F.lit(old), F.lit(new))
    return fronted


def repair_venue_text(venue: Column) -> Column:
    """Venue name back from its address form, with known repairs."""
    text = F.replace(F.regexp_replace(venue, r"\bamp\b", "&"), F.lit("039"), F.lit("'"))
    return trim_trailing_the(map_or_self(text, VENUE_TEXT_REPAIRS))


def page_plays(boxes: DataFrame, notes: DataFrame) -> DataFrame:
    """Plays out of the item boxes of set-list pages.

    boxes  occasion_id, paragraph_no, box_no, label, item, refs; the label is there where a set begins
    notes  occasion_id, ref, detail

    The set label holds until the next one. Neighbours are those of the same paragraph, ``***`` at its ends.
    """
    place = F.struct("paragraph_no", "box_no")
    bucket = F.col("paragraph_no")
    labelled = carry_forward(
        boxes.withColumn("__place", place), ["occasion_id"], ["__place"], "label", "set_label", bucket, share=True
    ).drop("__place")
    named = labelled.withColumn("item", item_text(F.col("item")))
    keys, by_box = ["occasion_id", "paragraph_no"], seq_bucket("box_no")
    chained = neighbour_values(named, keys, ["box_no"], "item", "item_before", "item_after", by_box, NO_NEIGHBOUR)
    noted = resolve_references(chained, "refs", notes, ["occasion_id"], "ref", "detail", "footnote")
    return noted.select(
        "occasion_id", "paragraph_no", "box_no", short_set_name(strip(F.coalesce("set_label", F.lit("")))).alias("set_label"),
        "item", "item_before", "item_after", "footnote",
    )
