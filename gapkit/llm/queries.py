"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from gapkit.llm.alignment import aligned
from gapkit.llm.chat_format import formatted, loss_text, read_turns
from gapkit.llm.fingerprint import as_text, fingerprinted, likeness
from gapkit.llm.html_text import extracted
from gapkit.llm.language_id import languages_of
from gapkit.llm.license_scan import scanned
from gapkit.llm.mixing import mixed
from gapkit.llm.near_dedup import NearParams, near_duplicates
from gapkit.llm.packing import packed
from gapkit.llm.periodic_runs import periodic_runs
from gapkit.llm.pseudonyms import pseudonymized
from gapkit.llm.substring_dedup import RepeatParams, without_repeats
from gapkit.llm.topk import scaled, top_k

KEY = "key of the registered queries"  # a real run passes its own secret
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


@query
def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprinted(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"))


@query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


SQL["op4_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5"""


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, linked from 85 of 100 on."""
    return near_duplicates(table(spark, sf_dir, "documents"), NearParams(k=3, percent=85))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words."""
    return without_repeats(table(spark, sf_dir, "documents"), RepeatParams(window=20), digest=True).withColumnRenamed(
        "kept", "kept_sha256")


# Words by their place, windows as text, the first start of each, and the words under the others.
SQL["op6_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k FROM s),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM l),
a AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
r AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN a ON w.doc_id = a.doc_id),
p AS (SELECT doc_id, len(ws) AS n_words, len(gone) AS n_removed, ws, list_sort(gone) AS gone FROM r),
u AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
t AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.i = g.i
      WHERE g.i IS NULL GROUP BY u.doc_id)
SELECT p.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM p LEFT JOIN t ON p.doc_id = t.doc_id"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of(table(spark, sf_dir, "documents"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(table(spark, sf_dir, "documents"), KEY).select("doc_id", "text", "n_values")


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(table(spark, sf_dir, "documents"))
    taken = mix.blocks.groupBy("doc_id", "copy").agg(
        F.sum("n").alias("taken"), F.min(F.struct("shard", "position")).alias("first"))
    rows = mix.documents.alias("d").join(
        taken.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.copy") == F.col("t.copy")), "left")
    sources = mix.sources.alias("s")
    return rows.join(sources, F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.col("first.shard").alias("first_shard"), F.col("first.position").alias("first_position"))


SQL["op5_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE
    WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS ss FROM w),
x AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, min(a.n) AS na, min(b.n) AS nb, count(*) AS c
      FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN c ON doc_id = node"""


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), digest=True).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@query
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but ``conv_id`` and ``valid`` are read back from the formatted segments."""
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    chats = formatted(table(spark, sf_dir, "conversations").unionByName(hard))
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select("conv_id", "valid", "formatted", loss_text(F.col("segments")).alias("loss"), F.size(turns).cast("long").alias("n_turns"),
                        F.sha2(said, 256).alias("turns_sha256"))
    return read.select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")


# Lengths of escaped texts are those of the texts and one more for each backslash and each control string.
SQL["op12_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role) ELSE 1 + 2 * strlen(role) END
    + length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + length('### : </turn>') + 1 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'tool') THEN
      (before = 'system' AND role = 'user') OR (before = 'tool' AND role IN ('assistant', 'tool'))
    WHEN before = 'user' THEN role = 'assistant' ELSE before = 'assistant' AND role IN ('user', 'tool') END
    AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM s GROUP BY conv_id"""


def _stretched(part, bounds: np.ndarray) -> np.ndarray:
    """For a tenth of the documents, words from some word on repeat the words before them in a period; all from the id's CRC."""
    take = np.arange(bounds[-1])
    for d, doc_id in enumerate(part.column(0).to_pylist()):
        h, lo, n = zlib.crc32(str(doc_id).encode()), int(bounds[d]), int(bounds[d + 1] - bounds[d])
        if h % 10 or not n or doc_id is None:
            continue
        g = h // 10
        a = g % n
        take[lo + a:lo + n] = lo + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return take


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(table(spark, sf_dir, "documents"), digest=True, rearrange=_stretched)
    best = [F.get(c, F.col("best")) for c in ("starts", "lengths", "periods")]
    lines = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat(
        F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), best[0].alias("start"), best[1].alias("length"), best[2].alias("period"),
        F.floor(best[1] * 1000 / best[2]).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"))
