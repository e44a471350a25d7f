"""Periodic runs of words, by a sparse diagonal dynamic program.

A cell (i, d) says that word i equals word i - d; its match length is one more than that of cell (i - 1, d). Cells are
visited in the order of i, and as soon as a diagonal d does not go on, its match is a stretch of period d and, if that is long
enough, emitted as a run.

All earlier occurrences of each word would be too many cells where words are frequent. A run of smallest period q holds
``times`` periods, so its words recur at distance q with their context: the K words from i on, K being the power of two with
K / 2 < q <= K. In a run no nearer occurrence of that context exists, or q would not be its smallest period. So each word
has one cell at most for each K, that of the nearest earlier occurrence of its context, and only if it lies at a distance
of that class; words whose context occurs once leave, with all longer contexts. A text of n words costs n log n at worst,
and about n where little repeats.

Contexts are compared exactly: words are numbered by their bytes, and a context of 2 K words by the numbers of its halves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gapkit.llm.words import slices, words_of


@dataclass(frozen=True)
class RunParams:
    """A run has ``least`` words and ``times`` periods at least."""

    least: int = 6
    times: int = 4

    def __post_init__(self):
        if self.times < 3:
            raise ValueError("a run is found by its context, which needs three periods at least")


def runs_in(words: np.ndarray, bounds: np.ndarray, p: RunParams = RunParams()) -> tuple[np.ndarray, ...]:
    """Text, start in the text, length and period of all runs, by text, start and period.

    ``words`` are numbers below 2**31, equal for equal words; text t has words ``bounds[t]`` to ``bounds[t + 1]``.
    """
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end, size = bounds[1:][text], sizes[text]
    at, key, k = np.arange(len(words)), text << 32 | words.astype(np.int64), 1
    number = np.full(len(words) + 1, -1, np.int64)
    found = []
    while len(at):
        order = np.argsort(key, kind="stable")
        again = key[order[1:]] == key[order[:-1]]
        here, there = order[1:][again], order[:-1][again]
        lag = np.zeros(len(at), np.int64)
        lag[here] = at[here] - at[there]
        cell = np.flatnonzero((lag > k // 2) & (lag <= k))
        if len(cell):
            i, d = at[cell], lag[cell]
            new = np.ones(len(cell), bool)
            new[1:] = (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1])
            head = np.flatnonzero(new)
            match = np.diff(np.append(head, len(cell))) + k - 1
            i, d = i[head], d[head]
            long = match + d >= np.maximum(p.least, p.times * d)
            found.append(np.stack([i[long] - d[long], (match + d)[long], d[long]]))
        # contexts of twice the length: both halves occur again, and the text has room for runs of a longer period
        new = np.ones(len(at), bool)
        new[1:] = ~again
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new) - 1
        keep = np.zeros(len(at), bool)
        keep[here] = keep[there] = True
        keep &= size[at] >= p.times * (k + 1)
        number[at[keep]] = rank[keep]
        left = at[keep]
        left = left[left + 2 * k <= end[left]]
        left = left[number[left + k] >= 0]
        key = number[left] * (len(words) + 1) + number[left + k]
        number[at[keep]] = -1
        at, k = left, 2 * k
    start, length, period = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    of = text[start] if len(start) else start
    return of, start - bounds[of], length, period


def _marked(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


Rearrange = Callable[[pa.RecordBatch, np.ndarray], np.ndarray]


def periodic_runs(
    docs: DataFrame, params: RunParams = RunParams(), digest: bool = False, rearrange: Rearrange | None = None,
) -> DataFrame:
    """``doc_id, n_words, starts, lengths, periods, best, collapsed`` for each row of ``docs`` (``doc_id, text``; other columns are
    left alone).

    ``starts, lengths, periods`` list the runs of the text by start, then period, in words. ``best`` is the place in these lists
    of the run with the greatest length / period, the smallest start and period among equals; null without runs.
    ``collapsed`` is the text without the words that a run holds after its first period, joined by one space; with ``digest``,
    its SHA-256 in hexadecimal. ``rearrange`` may give, for a batch of ``doc_id, text`` and the bounds of its texts' words, the
    places of the words to take instead.

    Null texts, empty ones and those of white space have no words and no runs. Rows are judged one by one, so rows that
    repeat, or share a ``doc_id`` or have none, are all given. Texts of any length are read whole. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(part.column(1))
            column = words.column()
            ids = words.numbered(column).indices.to_numpy().astype(np.int64)
            take = None if rearrange is None else rearrange(part, words.bounds)
            ids = ids if take is None else ids[take]
            of, start, length, period = runs_in(ids, words.bounds, params)
            gone = _marked(len(ids), words.bounds[of] + start, length, period)
            kept = np.flatnonzero(~gone)
            cut = np.searchsorted(kept, words.bounds)
            texts = pa.LargeListArray.from_arrays(pa.array(cut), column.take(pa.array(kept if take is None else take[kept])))
            texts = pc.binary_join(texts, pa.scalar(b" ", pa.large_binary()))
            if digest:
                texts = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts], pa.string())
            at = np.searchsorted(of, np.arange(part.num_rows + 1))
            best = [max(range(a, b), key=lambda r: (Fraction(int(length[r]), int(period[r])), -start[r], -period[r])) - a
                    if a < b else None for a, b in zip(at.tolist(), at[1:].tolist())]
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (start, length, period)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.counts.astype(np.int64)), *lists, pa.array(best, pa.int32()), texts.cast(pa.string())],
                names=["doc_id", "n_words", "starts", "lengths", "periods", "best", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, best int, collapsed string")
