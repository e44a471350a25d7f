"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find.

1. One pass over the texts gives each document its set size, a 128-bit digest of its shingle set and a SuperMinHash
   signature. Documents with equal sets form a class at once; only the class's smallest document goes on, so groups of
   copies of any size cost one row each.
2. Bands of signature values are shuffled as (band value, document). Documents of a bucket are compared with its smallest
   document (a star), in groups of bounded size, on full shingle sets.
3. A bucket whose documents are now in one component needs nothing more. In the others all pairs across components are
   compared, in blocks of bounded size: first by signature and set size, then on full sets. So no pair that shares a
   band is lost, and a tight group of near copies costs its size, not its square.

The number of bands follows from the threshold, so that a pair at it shares no band with a chance of 2.5e-7 at most: 26 bands
of 5 values at 0.85, 39 at 0.80. A group of texts that one task compares is bounded by rows and by shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gapkit.llm.components import components
from gapkit.llm.shared import stored
from gapkit.llm.words import mix, seeds, signed, slices, whole, windows, words_of

_GOLD = 0x9E3779B97F4A7C15
_FULL = np.uint32(0xFFFFFFFF)


MISSED = 2.5e-7  # the chance that a pair at the threshold shares no band


def _prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, math.isqrt(n) + 1))


@dataclass(frozen=True)
class NearParams:
    """k words a shingle; a link holds from ``percent`` of 100 on. The signature has a prime number of values.

    ``rows`` and ``bands`` are found from ``percent`` where not given: the longest bands, of 5 values at most, of which
    enough for ``MISSED`` fit into a signature.
    """

    k: int = 5
    percent: int = 80
    values: int | None = None
    bands: int | None = None
    rows: int | None = None
    slack: float = 0.17  # below the threshold by this much, a signature's estimate rules a pair out: 5 deviations
    block: int = 512
    block_shingles: int = 1 << 21

    def __post_init__(self):
        for rows in (self.rows,) if self.rows else (5, 4, 3, 2, 1):
            bands = self.bands or math.ceil(math.log(MISSED) / math.log1p(-min(self.percent / 100, 1 - 1e-9) ** rows))
            if bands * rows <= 251:
                break
        values = self.values or next(n for n in range(max(131, bands * rows), 400) if _prime(n))
        for name, value in (("rows", rows), ("bands", bands), ("values", values)):
            object.__setattr__(self, name, value)
        if bands * rows > values or values > 251 or not _prime(values):
            raise ValueError("values must be a prime up to 251 that holds all bands")

    @property
    def floor(self) -> float:
        return self.percent / 100 - self.slack


def superminhash(h: np.ndarray, text: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures of n sets; element i, a hash, belongs to set ``text[i]``.

    An element's rank at value p is the place of p in the element's own permutation of the m values, plus a fraction; a
    signature holds each value's smallest rank. Permutations are affine modulo the prime m, so a rank at one value and
    a rank at another are distributed as in a random permutation, which is what lowers the variance. Step j hands all
    elements' rank j out; a set stops as soon as all its values are below the next rank.
    """
    out = np.full(n * m, _FULL, np.uint32)
    at = (mix(h ^ np.uint64(77)) % np.uint64(m)).astype(np.int64)
    by = (1 + mix(h ^ np.uint64(991)) % np.uint64(m - 1)).astype(np.int64)
    where = text * m
    for j in range(m):
        fraction = mix(h + np.uint64((j + 1) * _GOLD & (1 << 64) - 1)) >> np.uint64(40)
        np.minimum.at(out, where + at, fraction.astype(np.uint32) | np.uint32(j << 24))
        open_ = out.reshape(n, m).max(axis=1) >= np.uint32(j + 1 << 24)
        go = open_[where // m]
        if not go.any():
            break
        h, where, by, at = h[go], where[go], by[go], (at[go] + by[go]) % m
    return out.reshape(n, m)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: k words, or all words of a text that has fewer."""
    words = words_of(column)
    hashes = words.hashes(lower=True)
    shingles, at = windows(hashes, words.bounds, k)
    cut, short = np.searchsorted(at, words.bounds), whole(hashes, words.bounds)
    return [
        np.unique(shingles[cut[i]:cut[i + 1]]) if cut[i + 1] > cut[i] else short[i:i + 1] if n else shingles[:0]
        for i, n in enumerate(words.counts)
    ]


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bits binary, bands array<long>"


def sketches(docs: DataFrame, p: NearParams) -> DataFrame:
    """Set size, set digest, the signature's low bytes and the band values of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = seeds(p.rows, 5)
        for part in slices(batches):
            sets = shingle_sets(part.column(1), p.k)
            sizes = np.array([len(s) for s in sets], np.int64)
            elements, text = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            digest = []
            for salt in (11, 12):
                sums = np.zeros(len(elements) + 1, np.uint64)
                np.cumsum(mix(elements ^ np.uint64(salt * _GOLD & (1 << 64) - 1)), out=sums[1:])
                ends = np.cumsum(sizes)
                digest.append(signed(mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64))))
            signature = superminhash(elements, text, len(sets), p.values)
            used = signature[:, :p.bands * p.rows].reshape(len(sets), p.bands, p.rows).astype(np.uint64)
            bands = mix((used * factors).sum(axis=2, dtype=np.uint64) + np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(_GOLD))
            width = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * p.bands)
            low = (signature & np.uint32(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), *map(pa.array, digest), pa.array([row.tobytes() for row in low], pa.binary()),
                 pa.ListArray.from_arrays(width, pa.array(signed(bands.ravel())))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bits", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that follow each other with the same keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        turn = np.zeros(batch.num_rows, bool)
        for c in columns:
            turn[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def forest(labels: np.ndarray, pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of the pairs of places that join two labels not yet joined, by union-find."""
    root = {x: x for x in labels.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    names = labels.tolist()
    for i, j in pairs:
        x, y = find(names[i]), find(names[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            yield i, j


def linked_pairs(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Places of sets of different labels with 100 * intersection >= percent * union, from one product of incidence rows."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros((len(sets), len(sets)), np.float32)
    shared = count[element] > 1  # an element of one set adds nothing to an intersection
    number = np.cumsum(count > 1) - 1
    element, row = number[element[shared]], row[shared]
    order = np.argsort(element, kind="stable")
    element, row = element[order], row[order]
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 8192):
        a, b = np.searchsorted(element, [lo, lo + 8192])
        part = np.zeros((len(sets), 8192), np.float32)
        part[row[a:b], element[a:b] - lo] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    linked &= (labels[:, None] != labels[None, :]) & (sizes > 0)[:, None]
    return zip(*np.nonzero(np.triu(linked, 1)))


def _verified(groups: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """Links ``a, b`` found among the documents of each group (``g, i, j``), a spanning forest for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["g", "i", "j"]):
            ids, labels = table["doc_id"].to_numpy(), table["label"].to_numpy()
            sets = [s for part in slices(iter(table.select(["text"]).to_batches())) for s in shingle_sets(part.column(0), p.k)]
            found = list(forest(labels, linked_pairs(sets, labels, p.percent)))
            if found:
                x, y = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], names=["a", "b"])

    rows = groups.join(texts, "doc_id").select("g", "i", "j", "doc_id", "label", "text")
    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "doc_id").mapInArrow(run, "a long, b long")


def _close(bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, earlier: np.ndarray, p: NearParams) -> np.ndarray:
    """Places of rows that form a pair across labels whose sizes and signatures allow a link and that agrees in none of the
    ``earlier`` band values: a pair that does has met in that band's bucket. Those are the values buckets are keyed by; the
    low bytes of a band may agree where its values do not."""
    out = np.zeros(len(sizes), bool)
    for i in range(len(sizes) - 1):
        rest = np.flatnonzero((labels[i + 1:] != labels[i])
                              & (100 * np.minimum(sizes[i + 1:], sizes[i]) >= p.percent * np.maximum(sizes[i + 1:], sizes[i]))) + i + 1
        if not len(rest):
            continue
        rest = rest[(bits[rest] == bits[i]).mean(axis=1) >= p.floor]
        if len(rest):
            rest = rest[~(earlier[rest] == earlier[i]).any(axis=1)]
            out[rest] = True
            out[i] |= len(rest) > 0
    return out


def _open_rows(rows: DataFrame, p: NearParams) -> DataFrame:
    """Of each block of a bucket (``g, i, j``), the documents whose texts must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["g", "i", "j"]):
            bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(table.num_rows, p.values)
            lists = table["earlier"].combine_chunks()
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)  # one band, so one length, but for clashes
            at = np.cumsum(counts) - counts
            earlier = lists.flatten().to_numpy(zero_copy_only=False)[at[:, None] + np.arange(counts.min())]
            keep = _close(bits, table["n_shingles"].to_numpy(), table["label"].to_numpy(), earlier, p)
            if keep.any():
                yield from table.select(["g", "i", "j", "doc_id", "label"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "doc_id").mapInArrow(
        run, "g long, i int, j int, doc_id long, label long")


def _blocks(p: NearParams) -> Column:
    """How many blocks a group of ``size`` rows and ``load`` shingles makes."""
    return F.ceil(F.greatest(F.col("size") / F.lit(p.block), F.col("load") / F.lit(p.block_shingles))).cast("int")


def _spread(rows: DataFrame, count: Column) -> DataFrame:
    """Copy each row of a group to all pairs (i, j) of blocks its own block belongs to; a small group is one pair."""
    own = F.pmod(F.xxhash64("doc_id"), count).cast("int")
    return (
        rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other")
    )


def near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (``doc_id, text``; other columns are left alone).

    Texts that are null or have no words have no shingles and are linked with nothing. Rows without ``doc_id`` are linked
    with nothing, and kept with a null component. Rows that share a ``doc_id`` are one node. An empty table gives no rows.
    """
    p = params
    base = stored(sketches(docs, p), "sketches")
    nodes = base.where("n_shingles > 0 and doc_id is not null")
    classes = stored(nodes.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    singles = nodes.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_a", "set_b"], "left_semi").dropDuplicates(
        ["doc_id", "set_a", "set_b"])
    members = singles.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "g"))
    size, load = F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("load")
    buckets = members.groupBy("g").agg(F.min("doc_id").alias("leader"), size, load).where("size > 1")
    members = stored(members.join(buckets, "g"), "members")  # of buckets of two and more only
    texts = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(members.select("doc_id").distinct(), "doc_id"), "texts")
    marks = singles.select("doc_id", "bits", "bands").join(members.select("doc_id").distinct(), "doc_id", "left_semi")

    stars = members.where("doc_id <> leader").select("leader", "doc_id", "n_shingles").distinct()
    sizes = stars.groupBy("leader").agg(size, load)
    salted = stars.join(sizes, "leader").select(
        F.col("leader").alias("g"), "doc_id", F.pmod(F.xxhash64("doc_id"), _blocks(p)).cast("int").alias("i"))
    heads = salted.select("g", "i").distinct().select("g", F.col("g").alias("doc_id"), "i")
    groups = salted.unionByName(heads).select("g", "i", F.lit(0).alias("j"), "doc_id", F.col("doc_id").alias("label"))
    links = stored(_verified(groups, texts, p), "star-links")
    labels = stored(components(links), "labels")

    labelled = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "label", F.coalesce("component", "doc_id")).drop("component")
    torn = labelled.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("g")
    open_ = labelled.join(torn, "g", "left_semi").join(marks, "doc_id").withColumn("earlier", F.slice("bands", F.lit(1), F.col("band")))
    rest = _open_rows(_spread(open_, _blocks(p)).select("g", "i", "j", "doc_id", "label", "n_shingles", "bits", "earlier"), p)
    more = stored(_verified(rest, texts, p), "block-links")
    if not more.isEmpty():
        labels = stored(components(links.union(more)), "labels")

    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    keyed = base.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.least("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return keyed.select("doc_id", "n_shingles", component.alias("component_id"),
                        component.eqNullSafe(F.col("doc_id")).alias("kept"))
