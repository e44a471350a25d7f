"""A training corpus in five stages, each an operator of ``gapkit.llm`` over all that its predecessor kept.

``STAGES`` are pairs of a name and a function of (spark, docs, sf_dir). ``run`` applies them to the documents; each stage's
rows are written as Parquet into the shared checkpoint folder and read again as the next one's documents. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapkit.llm.language_id import UNDETERMINED, fit_languages, fold, identify_languages
from gapkit.llm.mixing import MixParams, mixed, mixed_texts
from gapkit.llm.near_dedup import near_duplicates
from gapkit.llm.packing import packed
from gapkit.llm.pseudonyms import pseudonymized
from gapkit.llm.queries import KEY, SCHEMAS, table
from gapkit.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` in their types, whatever else there is."""
    types = dict(x.split() for x in SCHEMAS["documents"].split(", "))
    return docs.select(*[F.col(c).cast(types[c]).alias(c) for c in COLUMNS])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text in a language go; ``lang`` becomes the predicted one. Fold 1 takes no part in the fit. If no
    row has a language, nothing is learned: documents with a letter stay as they are."""
    docs = _documents(docs)
    number = fold(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    model = fit_languages(docs.where(number != 1))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = identify_languages(docs, model, COLUMNS)
    return rows.where(F.col("lang_pred") != UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, 0.8 or more. Of rows that repeat a ``doc_id`` the
    one with the smallest text stays; rows without an id and documents without words stay."""
    docs = _documents(docs)
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return named.select("doc_id", *[F.col(f"row.{c}").alias(c) for c in COLUMNS[1:]]).unionByName(docs.where("doc_id is null"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers, dates and addresses become pseudonyms of the same format; ``n_chars`` is that of the new text."""
    rows = pseudonymized(_documents(docs), KEY)
    changed = F.when(F.col("n_values") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", changed).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mixture takes them, in its order; one of a source may be cut to meet its target."""
    docs = _documents(docs)
    rows = mixed_texts(docs, mixed(docs, MixParams(block_words=None)))
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens."""
    return packed(_documents(docs)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pseudonyms", pseudonyms),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# Language models, signatures and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
