"""String and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WORD_OR_REST = r"(\p{L}+|[^\p{L}]+)"
_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace at both ends."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def py_title(text: Column) -> Column:
    """Capitalise each run of letters, also after an apostrophe or a digit."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(_WORD_OR_REST), F.lit(1))
    # texts of plain letters and blanks need no splitting
    return F.when(text.rlike("^[A-Za-z ]*$"), F.initcap(text)).otherwise(
        F.array_join(F.transform(runs, F.initcap), "")
    )


def capitalize_first(text: Column) -> Column:
    """First character upper, all others lower."""
    rest = F.right(text, F.greatest(F.length(text) - 1, F.lit(0)))
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(rest))


def count_of(text: Column, char: str) -> Column:
    """Number of occurrences of one character, or the characters in all occurrences of a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def front_article(text: Column) -> Column:
    """``X, The`` becomes ``The X``."""
    return F.regexp_replace(text, r"(?s)^(.*), The$", "The $1")


def trim_trailing_the(text: Column) -> Column:
    """Drop the last four characters when the trimmed text ends with ``the`` in any case."""
    ends = F.lower(strip(text)).endswith("the")
    return F.when(ends, F.left(text, F.greatest(F.length(text) - 4, F.lit(0)))).otherwise(text)


def slug(*parts: Column) -> Column:
    """Lower-case parts joined by dashes, spaces also turned to dashes; empty and null parts skipped."""
    cleaned = [F.lower(F.replace(F.nullif(p, F.lit("")), F.lit(" "), F.lit("-"))) for p in parts]
    return F.concat_ws("-", *cleaned)


def ordinal_letter(n: Column) -> Column:
    """1 -> a, 2 -> b, ...; past z the code points go on, so that letters stay distinct."""
    code = F.lpad(F.hex(n + F.lit(96)), 8, "0")
    return F.decode(F.unhex(code), "UTF-32")


def split_place(text: Column) -> tuple[Column, Column, Column]:
    """Split ``venue, city, state`` from the right; a venue may hold commas itself.

    With fewer separators the pieces fill from the left and the rest is null.
    """
    parts = count_of(text, ", ")  # two characters each
    last_two = F.substring_index(text, ", ", -2)
    venue = F.when(parts >= 4, F.left(text, F.length(text) - F.length(last_two) - 2)).otherwise(F.substring_index(text, ", ", 1))
    city = F.when(parts >= 4, F.substring_index(last_two, ", ", 1)).when(parts == 2, F.substring_index(text, ", ", -1))
    state = F.when(parts >= 4, F.substring_index(text, ", ", -1))
    return venue, city, state


def even_elements(values: Column) -> Column:
    """Elements at 0-based positions 0, 2, 4, ..."""
    return F.filter(values, lambda _, i: i % 2 == 0)


def odd_elements(values: Column) -> Column:
    """Elements at 0-based positions 1, 3, 5, ..."""
    return F.filter(values, lambda _, i: i % 2 == 1)
