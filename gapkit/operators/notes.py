"""Footnotes: joining, resolving references and concatenating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def attach_notes(
    plays: DataFrame, notes: DataFrame, keys: Sequence[str], detail: str = "detail"
) -> DataFrame:
    """Left join on the composite note key; a repeated key repeats the play."""
    return plays.join(notes.select(*keys, detail), list(keys), "left")


def resolve_references(
    df: DataFrame, refs: str, notes: DataFrame, note_keys: Sequence[str], ref: str, detail: str, out: str,
) -> DataFrame:
    """Replace an array of references by their texts, in array order, joined with blanks.

    The notes of a key, a page say, are one array, joined once and searched by each row. A reference without a note counts as
    empty text, one with several gives all in their order; the result is trimmed. A row without references has an empty text.
    """
    keys = list(note_keys)
    pages = notes.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct(F.col(ref).alias("ref"), F.coalesce(detail, F.lit("")).alias("text")))).alias("__notes"))

    def texts(r: Column) -> Column:
        found = F.transform(F.filter(F.col("__notes"), lambda n: n["ref"] == r), lambda n: n["text"])
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))

    joined = F.trim(F.array_join(F.flatten(F.transform(refs, texts)), " "))
    return df.join(pages, keys, "left").withColumn(out, F.coalesce(joined, F.lit(""))).select(*df.columns, out)


def concat_notes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, out: str, sep: str = " "
) -> DataFrame:
    """All notes of a key in one text. The result cell holds the whole group, so it bounds the group."""
    return df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__text")))).alias("__l")
    ).select(*keys, F.array_join(F.col("__l.__text"), sep).alias(out))
