"""Column-expression helpers; all stay on the JVM side."""

from gapkit.functions.dates import (
    date_key,
    days_before,
    format_day,
    format_slug_day,
    parse_iso,
    parse_mdy2,
    partial_date_label,
    weekday_name,
)
from gapkit.functions.numeric import gap_zscore, round2, sample_std
from gapkit.functions.text import (
    capitalize_first,
    count_of,
    even_elements,
    front_article,
    odd_elements,
    ordinal_letter,
    py_title,
    slug,
    split_place,
    strip,
    trim_trailing_the,
)

__all__ = [
    "capitalize_first", "count_of", "date_key", "days_before", "even_elements", "format_day",
    "format_slug_day", "front_article", "gap_zscore", "odd_elements", "ordinal_letter", "parse_iso",
    "parse_mdy2", "partial_date_label", "py_title", "round2", "sample_std", "slug", "split_place",
    "strip", "trim_trailing_the", "weekday_name",
]
