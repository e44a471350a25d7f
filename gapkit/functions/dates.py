"""Date parsing, labels and keys."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F


def parse_iso(text: Column) -> Column:
    """ISO text to date, null when it is no valid day."""
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_mdy2(text: Column) -> Column:
    """``MM/dd/yy`` to date: years 69-99 are 19xx, 00-68 are 20xx; unknown parts give null."""
    year = F.regexp_extract(text, r"^(\d{2})/(\d{2})/(\d{2})$", 3)
    century = F.when(year >= "69", F.lit("19")).otherwise(F.lit("20"))
    full = F.concat(F.left(text, F.lit(6)), century, year)
    return F.when(year != "", F.try_to_date(full, "MM/dd/yyyy"))


def date_key(text: Column) -> Column:
    """``MM/dd/yy`` to ``yyyyMMdd`` text, keeping ``00`` for unknown parts.

    The century follows the first digit of the year: 8 and 9 are 19xx, 0 to 2 are 20xx, and any other
    digit gets no century.
    """
    short = F.concat(F.substring(text, 7, 2), F.substring(text, 1, 2), F.substring(text, 4, 2))
    lead = F.left(short, F.lit(1))
    return (
        F.when(lead.isin("8", "9"), F.concat(F.lit("19"), short))
        .when(lead.isin("0", "1", "2"), F.concat(F.lit("20"), short))
        .otherwise(short)
    )


def partial_date_label(day: Column, year_text: Column, month_text: Column, day_text: Column) -> Column:
    """ISO date, or ``MM/dd/yy`` with ``??`` in place of an unknown month or day."""
    yy = F.right(year_text, F.lit(2))
    no_month, no_day = month_text == "00", day_text == "00"
    month = F.when(no_month, F.lit("??")).otherwise(month_text)
    dom = F.when(no_day, F.lit("??")).otherwise(day_text)
    return F.when(no_month | no_day, F.concat_ws("/", month, dom, yy)).otherwise(
        F.date_format(day, "yyyy-MM-dd")
    )


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def format_day(day: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(day, pattern)


def format_slug_day(day: Column) -> Column:
    """``march-7-2025``."""
    return F.lower(F.date_format(day, "MMMM-d-yyyy"))


def days_before(as_of: date | Column, days: int | Column) -> Column:
    """The day ``days`` before ``as_of``."""
    anchor = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.date_sub(anchor, days)
