"""Rows, links and titles out of landed pages ``(page_id, url, html)``.

Plain pattern matching on markup without nested tables; entities of the text are decoded. ``table_grid`` lays tables out as a
browser does: end tags may be missing, and cells may span columns and rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gapkit.functions import strip

# Entities decoded in cell texts, the ampersand last. Fixed values.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def cell_text(markup: Column) -> Column:
    """Text of a fragment: tags removed, entities decoded, trimmed."""
    text = F.regexp_replace(markup, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(text)


def blocks(markup: Column, tag: str) -> Column:
    """Inner markup of every element of a tag name, such as ``tr`` or ``t[dh]``."""
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})>"), F.lit(1))


def page_rows(
    pages: DataFrame, table_no: int | None = None, row_tag: str = "tr", cell_tag: str = "t[dh]"
) -> DataFrame:
    """One row per table row: ``page_id, row_no, cells``. ``table_no`` picks the n-th table of the page."""
    scope = F.col("html")
    if table_no is not None:
        scope = F.try_element_at(blocks(scope, "table"), F.lit(table_no + 1))
    found = pages.select("page_id", F.posexplode(blocks(scope, row_tag)).alias("row_no", "__row"))
    return found.select("page_id", "row_no", F.transform(blocks(F.col("__row"), cell_tag), cell_text).alias("cells"))


def with_header(
    pages: DataFrame, columns: Sequence[str], table_no: int | None = None, row_tag: str = "tr",
    cell_tag: str = "t[dh]",
) -> DataFrame:
    """Table rows below the first, which names the columns; a column the page lacks is null."""
    scope = F.col("html")
    if table_no is not None:
        scope = F.try_element_at(blocks(scope, "table"), F.lit(table_no + 1))
    rows = pages.select("page_id", blocks(scope, row_tag).alias("__rows"))
    header = F.transform(blocks(F.try_element_at("__rows", F.lit(1)), cell_tag), cell_text)
    body = rows.withColumn("__head", header).select("page_id", "__head", F.posexplode("__rows").alias("row_no", "__row"))
    cells = F.transform(blocks(F.col("__row"), cell_tag), cell_text)
    body = body.where("row_no > 0").withColumn("__cells", cells)
    picked = [
        F.try_element_at("__cells", F.nullif(F.array_position("__head", F.lit(c)), F.lit(0)).cast("int")).alias(c)
        for c in columns
    ]
    return body.select("page_id", "row_no", *picked)


# A row ends where the next one, a group of rows or the table does; a cell where the next one or its row does. Fixed values.
_ROW = r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr\s*>|</?t(?:able|head|body|foot)\b|\z)"
_CELL = r"(?is)<(t[dh]\b[^>]*>.*?)(?=<t[dh]\b|</t[dh]\s*>|\z)"
_TABLE = r"(?is)<table\b[^>]*>(.*?)(?=<table\b|</table\s*>|\z)"
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # what a span may say at most


_SPANNED = r"(?i)(?:col|row)span"  # tables without these words have no spans


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: functions over arrays are not compiled, so a repeated expression is evaluated
    each time it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _span(tag: Column, name: str, most: int) -> Column:
    """The number of an attribute, 1 if it says nothing sensible."""

    def number(said: Column) -> Column:
        return F.when(said.rlike("[1-9]"), F.least(said.cast("int"), F.lit(most))).otherwise(1)

    return _bound(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?\s*(\d{{1,9}})", 1), number)


def _text(cell: Column) -> Column:
    return cell_text(F.regexp_extract(cell, r"(?s)^[^>]*>(.*)$", 1))


def _cells(row: Column) -> Column:
    """Text, columns and rows of each cell of a row's markup."""

    def cell(x: Column) -> Column:
        return _bound(F.regexp_extract(x, r"(?s)^([^>]*)>", 1), lambda tag: F.struct(
            _text(x).alias("text"), _span(tag, "colspan", MOST_COLUMNS).alias("columns"), _span(tag, "rowspan", MOST_ROWS).alias("rows")))

    return F.transform(F.regexp_extract_all(row, F.lit(_CELL), F.lit(1)), cell)


def lay_out(rows: list[list[dict]]) -> list[list[str | None]]:
    """The grid of one table's cells: each cell in the first place that is free, its text in all places it covers. ``held`` are the
    columns that cells from above reach into, with the rows they still cover."""
    held: dict[int, tuple[str, int]] = {}
    grid = []
    for cells in rows:
        out: dict[int, str] = {at: text for at, (text, _) in held.items()}
        held = {at: (text, more - 1) for at, (text, more) in held.items() if more > 1}
        at = 0
        for cell in cells:
            while at in out:
                at += 1
            for place in range(at, at + cell["columns"]):
                out[place] = cell["text"]
                if cell["rows"] > 1:
                    held[place] = (cell["text"], cell["rows"] - 1)
            at += cell["columns"]
        grid.append([out.get(i) for i in range(max(out, default=-1) + 1)])
    return grid


def table_grid(pages: DataFrame, table_no: int | None = None) -> DataFrame:
    """``page_id, table_no, row_no, cells``: the rows of every table of a page, or of the n-th one, with a text in each place a cell
    covers.

    Rows without a cell are left out. A span that reaches beyond the last row ends there; places between a row's cells and
    what reaches into it from above are null. A null page has no tables. A table inside a cell is one of its own, and ends its
    row: markup in such tables is laid out, the outer row is not taken up again.
    """
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_TABLE), F.lit(1))).alias("table_no", "__table"))
    if table_no is not None:
        tables = tables.where(F.col("table_no") == table_no)

    def rows(cells: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform(F.regexp_extract_all("__table", F.lit(_ROW), F.lit(1)), cells), lambda c: F.size(c) > 0)

    # the markup tells which tables may have spans, so each is parsed once, and that is not moved below a filter on what it gives
    spans = F.col("__table").rlike(_SPANNED)
    texts = rows(lambda row: F.transform(F.regexp_extract_all(row, F.lit(_CELL), F.lit(1)), _text))
    easy = tables.where(~spans).select("page_id", "table_no", F.posexplode(texts).alias("row_no", "cells"))
    found = tables.where(spans).select("page_id", "table_no", rows(_cells).alias("rows"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = pa.array([lay_out(rows) for rows in batch.column(2).to_pylist()], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), grids], names=["page_id", "table_no", "grid"])

    # only tables with spans leave the JVM
    spanned = found.mapInArrow(place, tables.select("page_id", "table_no", F.lit(None).cast("array<array<string>>").alias("grid")).schema)
    return easy.unionByName(spanned.select("page_id", "table_no", F.posexplode("grid").alias("row_no", "cells")))


def links(pages: DataFrame, pattern: str = r'href="([^"]+)"') -> DataFrame:
    """Every link target of a page that fits the pattern, in page order."""
    return pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("link_no", "target")
    )


def quoted_title(pages: DataFrame, default: str = "Unknown Title") -> DataFrame:
    """The quoted part of the page title, or the default."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    quoted = F.regexp_extract(title, r'"(.*?)"', 1)
    return pages.select("page_id", F.when(quoted == "", F.lit(default)).otherwise(quoted).alias("title"))
