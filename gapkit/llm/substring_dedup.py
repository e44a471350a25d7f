"""Removal of repeated passages, by anchors at difference-cover positions.

A word goes if it lies in a window of ``window`` consecutive words whose word sequence also starts earlier: in a document
of smaller id, or earlier in the same document. Windows are judged on the input.

1. Hash ``anchor = window - period + 1`` words, but only where the word's place modulo ``period`` is in the cover. The
   cover's differences give all residues, so two equal windows, wherever they start, hold an equal anchor at the same
   distance from their start. (13 with {0, 1, 3, 9}: 4 anchors for 13 words.)
2. Anchors that occur once are done with. Those that occur again go back to their documents.
3. A document extends its repeated anchors to the full windows that hold them and hashes those; everywhere else
   nothing can match. The first place of each window's hash is kept, each later one removes its words.

Anchors only say where to look, so 64 bits will do for them. Windows are equal if 96 bits of their hashes are, which are
made of BLAKE2b digests of the words: among 10**13 windows some two clash with a chance below one in a thousand.

Very frequent anchors never enter the shuffle: an anchor above one in 10,000 of all is that frequent in some slice of the
input as well, so the sums over slices find it, and there are 10,000 of them at most. They are sent to all tasks. Of
windows, a slice passes on the first of each hash only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gapkit.llm.shared import release, stored
from gapkit.llm.words import signed, slices, windows, words_of

HEAVY = 10_000  # an anchor is heavy above this fraction of all; so there are no more heavy ones than that


@dataclass(frozen=True)
class RepeatParams:
    window: int = 50
    period: int = 13
    cover: tuple[int, ...] = (0, 1, 3, 9)

    def __post_init__(self):
        found = {(a - b) % self.period for a in self.cover for b in self.cover}
        if len(found) != self.period or self.window < self.period:
            raise ValueError("the cover's differences must give every residue, and a period fit in the window")

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


def _anchors(part: pa.RecordBatch, p: RepeatParams):
    """Hash, text and place in the text of each anchor, for texts that hold a full window."""
    words = words_of(part.column(1))
    hashes, at = windows(words.hashes(), words.bounds, p.anchor)
    text = np.searchsorted(words.bounds, at, "right") - 1
    place = at - words.bounds[text]
    named = ~np.asarray(part.column(0).is_null()) & (words.counts >= p.window)
    chosen = np.isin(place % p.period, p.cover) & named[text]
    return hashes[chosen], text[chosen], place[chosen]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def heavy_anchors(docs: DataFrame, p: RepeatParams) -> np.ndarray:
    """The sorted hashes above one in HEAVY of all anchors, some lighter ones of two and more among them; HEAVY at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, _, _ = _anchors(part, p)
            values, count = np.unique(hashes, return_counts=True)
            often = count >= max(2, len(hashes) / HEAVY)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *signed(values[often]).tolist()], pa.int64()), pa.array([len(hashes), *count[often].tolist()], pa.int64())],
                names=["h", "n"])

    sums = stored(_keyed(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "anchor-sums")
    total = sums.where("h is null").select(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rows = sums.where(F.col("h").isNotNull() & (F.col("n") * HEAVY >= total)).select("h").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64))


def _is_in(hashes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(ordered, signed(hashes)), len(ordered) - 1)
    return ordered[at] == signed(hashes)


def _ranges(starts: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Places from start - before to start + after, of n."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(starts - before, 0, n), 1)
    np.add.at(edge, np.clip(starts + after + 1, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(text: bytes, gone: np.ndarray | None, digest: bool) -> str:
    words = text.split()
    if gone is not None:
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode()


def without_repeats(docs: DataFrame, params: RepeatParams = RepeatParams(), digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row of ``docs`` (``doc_id, text``; other columns are left alone).

    ``kept`` is the text of the words that stay, joined by one space; with ``digest``, its SHA-256 in hexadecimal instead,
    which spares carrying texts nothing is removed from. Null texts have no words. Rows without ``doc_id`` take no part
    and lose nothing. Rows that share a ``doc_id`` and a text are one document, given once for each row. An empty
    table gives no rows.
    """
    p = params
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_anchors(docs, p))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, text, place = _anchors(part, p)
            light = ~_is_in(hashes, heavy.value)
            ids = part.column(0).to_numpy(zero_copy_only=False)[text[light]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(hashes[light])), pa.array(ids.astype(np.int64)), pa.array(place[light].astype(np.int32))],
                names=["h", "doc_id", "place"])

    rows = _keyed(docs).mapInArrow(anchors, "h long, doc_id long, place int")
    again = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("n > 1")
    marks = again.groupBy("doc_id").agg(F.collect_list("place").alias("places"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(part.column(1))
            hashes, more = words.wide_hashes()
            full, at = windows(hashes, words.bounds, p.window)
            rest = (windows(more, words.bounds, p.window)[0] >> np.uint64(32)).astype(np.uint32)
            frequent, text, place = _anchors(part, p)
            frequent = _is_in(frequent, heavy.value)
            start = words.bounds[text[frequent]] + place[frequent]
            lists = part.column(2)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            marked = lists.flatten().to_numpy() + np.repeat(words.bounds[:-1], sizes)
            hit = _ranges(np.concatenate([start, marked]).astype(np.int64), p.period - 1, 0, len(hashes) + 1)
            hit = hit[at]
            full, rest, at = full[hit], rest[hit], at[hit]
            text = np.searchsorted(words.bounds, at, "right") - 1
            named = ~np.asarray(part.column(0).is_null())[text]
            full, rest, at, text = full[named], rest[named], at[named], text[named]
            ids = part.column(0).fill_null(0).to_numpy()
            order = np.lexsort((at - words.bounds[text], ids[text], rest, full))
            full, rest, at, text = full[order], rest[order], at[order], text[order]
            place = at - words.bounds[text]
            first = np.ones(len(full), bool)
            first[1:] = (full[1:] != full[:-1]) | (rest[1:] != rest[:-1])
            group = np.cumsum(first) - 1
            head = np.flatnonzero(first)[group] if len(full) else group
            known = (ids[text] != ids[text[head]]) | (place != place[head])  # equal rows share their first place
            touched = np.zeros(part.num_rows, bool)
            touched[text] = True

            def lists_of(chosen, values, kind):
                by = np.argsort(text[chosen], kind="stable")
                bounds = np.searchsorted(text[chosen][by], np.arange(part.num_rows + 1)).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[chosen][by].astype(kind)))

            texts = part.column(1).fill_null("").to_pylist()
            kept = [None if t else _kept(x.encode(), None, digest) for x, t in zip(texts, touched.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.counts.astype(np.int64)), pa.array(kept, pa.string()),
                 pa.array([x if t else None for x, t in zip(texts, touched.tolist())], pa.string()),
                 lists_of(known, place, np.int32), lists_of(~known, place, np.int32), lists_of(~known, signed(full), np.int64),
                 lists_of(~known, rest.view(np.int32), np.int32)],
                names=["doc_id", "n_words", "kept", "text", "known", "starts", "hashes", "more"])

    extended = stored(
        _keyed(docs).join(marks, "doc_id", "left").select("doc_id", "text", "places").mapInArrow(
            extend, "doc_id long, n_words long, kept string, text string, known array<int>, starts array<int>, hashes array<long>, more array<int>"),
        "windows", "zstd")
    release(docs.sparkSession)
    touched = extended.where("text is not null")
    places = touched.select("doc_id", F.explode(F.arrays_zip("hashes", "more", "starts")).alias("w")).select(
        F.col("w.hashes").alias("h"), F.col("w.more").alias("h2"), "doc_id", F.col("w.starts").alias("start"))
    # rank, as equal rows tie
    later = places.withColumn("n", F.rank().over(Window.partitionBy("h", "h2").orderBy("doc_id", "start"))).where("n > 1")
    gone = later.groupBy("doc_id").agg(F.collect_list("start").alias("later"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            removed, kept = [], []
            for n, text, known, later_ in zip(*(part.column(i).to_pylist() for i in (2, 1, 3, 4))):
                out = _ranges(np.array([*(known or ()), *(later_ or ())], np.int64), 0, p.window - 1, n)
                removed.append(int(out.sum()))
                kept.append(_kept(text.encode(), out, digest))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    changed = touched.join(gone, "doc_id", "left").select("doc_id", "text", "n_words", "known", "later").mapInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept string")
    same = extended.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return changed.unionByName(same)
