"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in built-in functions only.

1. Sources share a total of words by weight; a source's share stops at ``repeats`` times its size, and what it leaves is shared
   by the others (``targets``).
2. Documents are cut into blocks. A source's blocks are permuted by a hash; its target is taken in full passes over them and
   a part of one more, whose last block is cut to meet the target.
3. A binary tree splits the sources' exact block quotas among 2**levels output shards: a node draws, without putting back,
   the blocks of its left half from its own quotas, source by source. So all shards hold equally many blocks, a shard's
   mixture is that of a uniform shuffle of all blocks, and no row moves for it.
4. A block goes down the tree by its rank in its source. Shards then draw disjoint runs of permuted blocks, and each
   shuffles its own.

Everything that is random is a hash of ``seed`` and keys, so reruns agree. Running sums of a source go over buckets of its
permutation, as many as its size asks for, so a source with most of the rows is spread like all others.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapkit.llm.fingerprint import let, words
from gapkit.llm.shared import stored

_EXACT = 24  # quotas up to this are drawn block by block, larger ones by the normal law of their mean and variance


@dataclass(frozen=True)
class MixParams:
    """``weights`` by source; sources it lacks take the values of ``cycle`` in turn, by code point, null last.

    ``block_words`` of None makes each document one block.
    """

    total: float = 1.5
    repeats: int = 2
    cycle: tuple[int, ...] = (5, 2, 1)
    weights: Mapping[str, int] | None = None
    block_words: int | None = 256
    shard_words: int = 1 << 18
    levels: int = 12
    bucket_rows: int = 512
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, p: MixParams) -> DataFrame:
    """Add ``place`` (0 for the first), ``weight`` and ``target`` to a table of ``source, source_size``, one row a source.

    The windows go over the sources, a table of aggregates, and not over documents.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.get(F.array(*map(F.lit, p.cycle)), (F.col("place") % len(p.cycle)).cast("int"))
    if p.weights:
        named = F.create_map(*[F.lit(x) for pair in p.weights.items() for x in pair])
        weight = F.coalesce(named[F.col("source")], weight)
    rows = rows.withColumns({"weight": weight.cast("double"), "limit": F.col("source_size") * float(p.repeats)})
    by_limit = everything.orderBy(F.col("limit") / F.col("weight"), "place")
    before, rest = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(p.total)
    # the level at which this source and all with a higher limit would stand, if those with a lower limit stop at theirs
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "place"))).over(everything)
    return rows.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * level)).select(
        "source", "source_size", "place", "weight", "target")


def _uniform(p: MixParams, *keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(p.seed), *keys), 11) / F.lit(float(1 << 53))


def hypergeometric(all_: Column, marked: Column, drawn: Column, node: Column, place: Column, p: MixParams) -> Column:
    """How many of ``marked`` items are among ``drawn`` ones out of ``all_``."""
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (all_ - marked)), F.least(marked, drawn)

    def one(s: Column, i: Column) -> Column:
        # marked items in turn: each is drawn with the chance of the places left among the items left
        return s + F.when(_uniform(p, node, place, i) * (all_ - i) < drawn - s, 1).otherwise(0)

    exact = F.aggregate(F.sequence(F.lit(1).cast("long"), marked), F.lit(0).cast("long"), lambda s, i: one(s, i - 1).cast("long"))
    share = marked / all_
    spread = F.sqrt(F.greatest(F.lit(0.0), drawn * share * (1 - share) * (all_ - drawn) / F.greatest(F.lit(1).cast("long"), all_ - 1)))
    normal = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(-6.0), lambda s, i: s + _uniform(p, node, place, i))
    wide = F.round(drawn * share + spread * normal).cast("long")
    return F.when((marked == 0) | (drawn == 0), F.lit(0).cast("long")).otherwise(
        F.least(high, F.greatest(low, F.when(marked <= _EXACT, exact).otherwise(wide))))


def splitting_tree(quotas: DataFrame, levels: int, p: MixParams) -> DataFrame:
    """``place, lefts`` for each row of ``place, quota``: what goes to the left half of nodes 1, 2, 3 ... of the tree."""
    root = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("q")).select(
        F.lit(1).alias("node"), F.transform("q", lambda x: x["place"]).alias("places"), F.transform("q", lambda x: x["quota"]).alias("q"))

    def split(q: Column, node: Column, places: Column) -> Column:
        total = F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x)
        start = F.struct(total.alias("all"), F.ceil(total / 2).alias("drawn"), F.array().cast("array<bigint>").alias("left"))

        def take(s: Column, i: Column) -> Column:
            return let(hypergeometric(s["all"], F.get(q, i), s["drawn"], node, F.get(places, i), p), lambda x: F.struct(
                (s["all"] - F.get(q, i)).alias("all"), (s["drawn"] - x).alias("drawn"), F.concat(s["left"], F.array(x)).alias("left")))

        return F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), start, take, lambda s: s["left"])

    level, done = root, None
    for _ in range(levels):
        level = level.withColumn("left", F.when(F.size("q") > 0, split(F.col("q"), F.col("node"), F.col("places"))).otherwise(F.col("q")))
        level = stored(level, "tree") if level is not root else level
        done = level if done is None else done.unionByName(level)
        half = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
                       F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")))
        level = level.select("places", F.explode(half).alias("h")).select(F.col("h.node").alias("node"), "places", F.col("h.q").alias("q"))
    if done is None:
        return quotas.select("place", F.array().cast("array<bigint>").alias("lefts"))
    each = done.select("node", F.explode(F.arrays_zip("places", "left")).alias("x"))
    return each.groupBy(F.col("x.places").alias("place")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("node", F.col("x.left").alias("left")))), lambda x: x["left"]).alias("lefts"))


def shard_of(rank: Column, lefts: Column, levels: int) -> Column:
    """The leaf, from 0, that a source's block of this rank falls to."""

    def down(s: Column, _: Column) -> Column:
        left = F.get(lefts, s["node"] - 1)
        right = s["rank"] >= left
        return F.struct((s["node"] * 2 + right.cast("int")).alias("node"), (s["rank"] - F.when(right, left).otherwise(0)).alias("rank"))

    if not levels:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.struct(F.lit(1).alias("node"), rank.cast("long").alias("rank")), down,
                       lambda s: s["node"] - (1 << levels))


@dataclass(frozen=True)
class Mix:
    """``documents``: ``doc_id, copy, source, size``, copies of an id being numbered. ``sources``: their sizes and targets.
    ``blocks``: ``shard, position, source, doc_id, copy, pass, start, n``, the mixture."""

    documents: DataFrame
    sources: DataFrame
    blocks: DataFrame


def mixed(docs: DataFrame, params: MixParams = MixParams()) -> Mix:
    """Mix all rows of ``docs`` (``doc_id, text, source``; other columns are left alone).

    Null texts and texts without words have no blocks. Null is a source like others. Rows that share a ``doc_id`` are told
    apart by ``copy``, in the order of source and size. An empty table gives empty tables.
    """
    p = params
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("body"))
    copies = Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_last(), "size", "body")
    documents = stored(sized.withColumn("copy", F.row_number().over(copies)), "sizes")
    sizes = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(sizes, p), "sources")

    whole_pass = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = sources.withColumn("passes", whole_pass.cast("long")).withColumn(
        "rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    most = F.lit(p.block_words).cast("long") if p.block_words else F.col("size")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / most) - 1))
    # documents without words have no block
    blocks = documents.where("size > 0").select("source", "doc_id", "copy", "size", "body", number.alias("block"))
    blocks = blocks.withColumn("start", F.col("block") * most).withColumn("n", F.least(most, F.col("size") - F.col("start")))
    key = F.xxhash64(F.lit(p.seed), "doc_id", "copy", "body", "block")
    counts = documents.where("size > 0").groupBy("source").agg(F.sum(F.ceil(F.col("size") / most)).alias("n_blocks"))
    bits = F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("n_blocks") / F.lit(float(p.bucket_rows))))).cast("int")
    plan = plan.join(counts, plan["source"].eqNullSafe(counts["source"])).select(
        plan["source"], "place", "passes", "rest", "n_blocks", bits.alias("bits"))
    plan = stored(plan, "plan")
    # the upper bits of the key; they order buckets as keys order rows once the sign bit is read as a digit
    bucket = F.call_function("shiftrightunsigned", F.shiftrightunsigned("key", 1), F.lit(63) - F.col("bits"))
    blocks = blocks.withColumn("key", key).join(plan, blocks["source"].eqNullSafe(plan["source"])).select(
        "place", "passes", "rest", "n_blocks", "doc_id", "copy", "start", "n", "key",
        F.when(F.col("bits") > 0, bucket).otherwise(0).alias("bucket"))
    sums = blocks.groupBy("place", "bucket").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("place", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"),
                          F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("place", "bucket").orderBy("key", "doc_id", "copy", "start")
    ranked = blocks.join(offsets, ["place", "bucket"]).withColumns({
        "rank": F.col("rows_before") + F.row_number().over(inside) - 1,
        "at": F.col("words_before") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"),
    })
    part = F.least("n", F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("at")))
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))
    taken = ranked.select("*", passes.alias("pass")).withColumn(
        "n", F.when(F.col("pass") < F.col("passes"), F.col("n")).otherwise(part)).where("n > 0").select(
        "place", "doc_id", "copy", "pass", "start", "n", (F.col("pass") * F.col("n_blocks") + F.col("rank")).alias("rank"))
    taken = stored(taken, "taken")

    quotas = stored(taken.groupBy("place").agg(F.count(F.lit(1)).alias("quota"), F.sum("n").alias("words")), "quotas")
    words_taken = quotas.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    levels = 0
    while levels < p.levels and words_taken > p.shard_words << levels:
        levels += 1
    tree = splitting_tree(quotas.select("place", "quota"), levels, p)
    there = taken.join(stored(tree, "lefts"), "place").select(
        shard_of(F.col("rank"), F.col("lefts"), levels).alias("shard"), "place", "doc_id", "copy", "pass", "start", "n")
    local = Window.partitionBy("shard").orderBy(
        F.xxhash64(F.lit(p.seed), "shard", "place", "doc_id", "copy", "pass", "start"), "place", "doc_id", "copy", "pass", "start")
    placed = there.withColumn("position", F.row_number().over(local) - 1)
    named = placed.join(sources.select("place", "source"), "place").select(
        "shard", "position", "source", "doc_id", "copy", "pass", "start", "n")
    return Mix(documents, sources, named)


def mixed_texts(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, ``text`` cut to the block, in the order of the mixture."""
    body = F.xxhash64("text")
    size = word_count(F.col("text"))
    copies = Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_last(), size, body)
    own = [f"__mix_{c}" for c in ("number", "shard", "position", "doc_id", "copy", "start", "n")]
    rows = docs.withColumn(own[0], F.row_number().over(copies))
    blocks = mix.blocks.select(*[F.col(c.removeprefix("__mix_")).alias(c) for c in own[1:]])
    found = rows.join(blocks, rows["doc_id"].eqNullSafe(F.col("__mix_doc_id")) & (F.col("__mix_number") == F.col("__mix_copy")))
    start, n = F.col("__mix_start"), F.col("__mix_n")
    cut = F.when((start == 0) & (n == size), F.col("text")).otherwise(
        F.array_join(F.slice(words(F.col("text")), start.cast("int") + 1, n.cast("int")), " "))
    order = ["__mix_shard", "__mix_position"]
    return found.withColumn("text", cut).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
