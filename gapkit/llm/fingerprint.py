"""Document fingerprints by one-permutation MinHash, in built-in functions only.

Every shingle is hashed once. The top 8 bits of the hash choose one of 256 bins, and a bin keeps its smallest hash. An empty
bin is filled by optimal densification: it probes bins in a pseudo-random order of its own until one is filled; after a few
probes the first filled bin of a second order is taken directly, so sparse texts cost no more. Of each bin the lowest 4
bits are stored, 16 bins to a long. Agreement of two fingerprints is corrected for chance matches of 4 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS = 256
BITS = 4
_PROBES = 6
_FREE = (1 << 56) - 1  # the lower 56 bits of a bin that no hash fell into
_SPACE = " \t\n\x0b\x0c\r"
_NIBBLES = 0x1111111111111111


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often and wherever the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, split at ``[\\x20\\x09-\\x0D]+``; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def shingle_hashes(text: Column, k: int) -> Column:
    """Hashes of all runs of k words of the lower-cased text; a shorter text is one shingle, one without words has none."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        many = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(
            F.slice(h, F.lit(1), n - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])))
        one = F.array(F.xxhash64(F.concat_ws(" ", w), F.lit(k)))
        return F.when(n >= k, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))

    return let(words(F.lower(text)), runs)


def fingerprint(text: Column, k: int = 5) -> Column:
    """16 longs of 16 bins each; null for a text without words."""
    ends = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)),
                       lambda j: F.shiftleft(j.cast("long"), 56).bitwiseOR(F.lit(_FREE)))

    def minima(ordered: Column) -> Column:
        # the first of each bin, its low bits if a hash fell into it
        firsts = F.filter(ordered, lambda x, i: F.coalesce(
            F.shiftright(x, 56) != F.shiftright(F.get(ordered, i - 1), 56), F.lit(True)))
        return F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(_FREE)) != _FREE, x.bitwiseAND(F.lit((1 << BITS) - 1))))

    def dense(bins: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(bins, i).isNotNull())

        def filler(j: Column, there: Column) -> Column:
            probes = [F.get(bins, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(_PROBES)]
            order = F.transform(there, lambda i: F.xxhash64(j, i, F.lit(_PROBES)).bitwiseAND(F.lit(-BINS)).bitwiseOR(i.cast("long")))
            return F.coalesce(*probes, F.get(bins, F.array_min(order).bitwiseAND(F.lit(BINS - 1)).cast("int")))

        return let(filled, lambda there: F.transform(bins, lambda x, j: F.coalesce(x, filler(j, there))))

    def packed(digits: Column) -> Column:
        per = 64 // BITS
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), lambda i: F.aggregate(
            F.slice(digits, i * per + 1, F.lit(per)), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x)))

    return let(shingle_hashes(text, k), lambda h: F.when(F.size(h) > 0, let(
        let(let(F.sort_array(F.concat(h, ends)), minima), dense), packed)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1. Two texts without words are alike, one and another are not."""

    def same(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        folded = z
        for j in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(z, j))
        return F.lit(64 // BITS) - F.bit_count(folded.bitwiseAND(F.lit(_NIBBLES)))

    agree = F.aggregate(F.zip_with(a, b, same), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 2.0 ** -BITS
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), (agree - chance) / (1 - chance)))


def as_text(packed: Column) -> Column:
    """256 hexadecimal digits; an empty string for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def _ranges(docs: DataFrame, rows: int, most: int) -> list[int]:
    """Lower bounds of ranges of ids, about ``rows`` in each, ``most`` ranges at most. No range is empty."""
    n, low = docs.agg(F.count("doc_id"), F.min("doc_id")).first()
    parts = max(1, min(most, n // rows))
    if parts == 1:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * parts)).first()[0]
    return sorted({x for x in found if x > low})


def with_next(docs: DataFrame, k: int = 5, rows: int = 250, most: int = 2000) -> DataFrame:
    """``doc_id, text, own`` of each row and, as ``next``, text and fingerprint of the row of the next smaller ``doc_id``; after
    the last comes the first. Rows of one id follow each other by text, rows without id come last; a null text is empty.

    Rows are dealt out by ranges of ids, and each range looks ahead within itself; its last row reads the head of the next
    range, of which there are ``most`` at most.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = _ranges(docs, rows, most)
    array = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(array, lambda b: b <= F.col("doc_id"))))
    docs = docs.withColumn("range", place)
    heads = docs.groupBy("range").agg(F.max("doc_id").alias("head"))
    there = sorted((r["range"] for r in heads.select("range").collect()), reverse=True)  # one number a range
    pairs = docs.sparkSession.createDataFrame(list(zip(there[1:] + there[:1], there)), "range int, before int")
    # each range also gets the head of the next one, behind its own rows
    edges = (
        docs.join(F.broadcast(heads), "range").where(F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("range").agg(F.min("text").alias("text")).join(F.broadcast(pairs), "range")
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("range"), F.lit(1).alias("edge"))
    )
    dealt = docs.withColumn("edge", F.lit(0)).unionByName(edges).repartitionByRange("range")
    order = Window.partitionBy("range").orderBy("edge", F.col("doc_id").desc_nulls_last(), "text")
    ahead = dealt.withColumn("own", fingerprint(F.col("text"), k)).withColumn("next", F.lead(F.struct("text", "own")).over(order))
    return ahead.where("edge = 0").select("doc_id", "text", "own", "next")


def edited(text: Column, next_text: Column) -> Column:
    """The last third of the code points replaced by as many from the start of the next text, or all it has."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(next_text, F.lit(1), third))


def fingerprinted(docs: DataFrame, k: int = 5) -> DataFrame:
    """``doc_id, text, edited`` and the packed fingerprints ``own, changed, following`` of the text, its edited text and the
    next text, for each row of ``docs`` (``doc_id, text``; other columns are left alone). An empty table gives no rows."""
    rows = with_next(docs, k).withColumn("edited", edited(F.col("text"), F.col("next.text")))
    return rows.select("doc_id", "text", "edited", "own", fingerprint(F.col("edited"), k).alias("changed"),
                       F.col("next.own").alias("following"))
