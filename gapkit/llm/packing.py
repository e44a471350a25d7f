"""Mixture-controlled packing of token streams into sequences, by deficit round-robin over source queues.

Each source has a queue of its documents' tokens, cut into quanta of ``quantum`` tokens. Quantum j of a queue of weight w is
due at virtual time (j + 1/2) / w, and quanta are dealt out in the order of these times: the queue furthest behind its share
is served next, so a window of ``window`` tokens holds each source within a quantum of its share, and what a source is
short of is made up in the following windows. The rank of a quantum has a closed form in integers, so the deficits
carry across windows, tasks and partitions without a pass over the windows. A queue that runs dry leaves the rest to the others.
What is left of each queue below one quantum comes last. The last window is cut into powers of two, so nothing is padded.

Texts are tokenized once. Each task counts its tokens by source, which with the sums of the tasks before gives every
document's place in its queue.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gapkit.llm.shared import stored
from gapkit.llm.words import Words, digests, slices, values_of, words_of

_SCALE = 1 << 20


@dataclass(frozen=True)
class PackParams:
    """The ``queues`` largest sources have a queue each, all others share one. ``weights`` of sources are integers up to
    2**20; without them a source's weight is its share of the tokens."""

    window: int = 2048
    quantum: int = 64
    end: int = 1
    queues: int = 255
    tokenizer: str = "word_bpe_49k.json"
    weights: Mapping[str | None, int] | None = None

    def __post_init__(self):
        if self.window & (self.window - 1) or self.window % self.quantum:
            raise ValueError("the window is a power of two and a multiple of the quantum")


class WordTokens:
    """Token ids by word. The tokenizer drops white space and no token crosses it, so ids of a text are those of its words.
    Words met before are kept, up to a bounded number of them."""

    def __init__(self, path: str, keep: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self._reset()

    def _reset(self) -> None:
        self.known, self.rest, self.order = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.starts, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of words known by their 128-bit digests, -1 for others."""
        if not len(self.known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.known, keys[:, 0]), len(self.known) - 1)
        return np.where((self.known[at] == keys[:, 0]) & (self.rest[at] == keys[:, 1]), self.order[at], -1)

    def _encoded(self, words: list[str], block: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words in order, and the number of ids of each. The tokenizer gets texts of ``block`` words, as a call costs
        more than a word; a token belongs to the word it starts in."""
        found = self.tokenizer.encode_batch([" ".join(words[i:i + block]) for i in range(0, len(words), block)], add_special_tokens=False)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32, int(sizes.sum()))
        starts = np.fromiter((at for x in found for at, _ in x.offsets), np.int64, len(ids))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begins = np.cumsum(lengths) - lengths
        word = np.searchsorted(begins, starts + np.repeat(begins[::block], sizes), "right") - 1
        return ids, np.bincount(word, minlength=len(words))

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each word."""
        coded = words.numbered(words.column())
        keys = digests(coded.dictionary)
        slot = self._find(keys)
        if (missing := slot < 0).any():
            if len(self.known) + missing.sum() > self.keep:
                self._reset()
                missing[:] = True
            new, sizes, ids = coded.dictionary.filter(pa.array(missing)), [], []
            for lo in range(0, len(new), 8192):  # what the tokenizer returns takes far more memory than the ids
                some, counts = self._encoded([x.decode() for x in values_of(new.slice(lo, 8192))])
                sizes.append(counts)
                ids.append(some)
            slot[missing] = len(self.starts) - 1 + np.arange(len(new))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
            self.ids = np.concatenate([self.ids, *ids])
            by = np.flatnonzero(missing)[np.argsort(keys[missing, 0])]
            at = np.searchsorted(self.known, keys[by, 0])
            self.known, self.rest = np.insert(self.known, at, keys[by, 0]), np.insert(self.rest, at, keys[by, 1])
            self.order = np.insert(self.order, at, slot[by])
        slot = slot[coded.indices.to_numpy()]
        counts = self.starts[slot + 1] - self.starts[slot]
        before = np.cumsum(counts) - counts
        return self.ids[np.repeat(self.starts[slot] - before, counts) + np.arange(int(counts.sum()))], counts


_tokenizers: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


def tokenized(docs: DataFrame, p: PackParams) -> DataFrame:
    """``doc_id, source, part, before, n, ids``: the tokens of each row with the end id, the task that made them, and the tokens
    of the same source before it in that task."""
    path = public_tokenizers.path(p.tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part_id, so_far = word_tokens(path), TaskContext.get().partitionId(), {}
        for part in slices(batches, limit=3 << 20):
            words = words_of(part.column(1))
            ids, counts = encode(words)
            ends = np.concatenate([[0], np.cumsum(counts)])[words.bounds]
            n = np.diff(ends) + 1
            before = []
            for source, size in zip(part.column(2).to_pylist(), n.tolist()):
                before.append(so_far.get(source, 0))
                so_far[source] = before[-1] + size
            full = np.insert(ids, ends[1:], p.end).astype(np.uint16 if encode.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
            bounds = np.concatenate([[0], np.cumsum(n)]) * full.itemsize
            blob = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(full)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.full(len(n), part_id, np.int64)), pa.array(before, pa.int64()),
                 pa.array(n.astype(np.int64)), blob.cast(pa.binary())],
                names=["doc_id", "source", "part", "before", "n", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")).mapInArrow(
        run, "doc_id long, source string, part long, before long, n long, ids binary")


@dataclass(frozen=True)
class Deal:
    """How the quanta of all queues are dealt out. Arrays have one entry for each queue."""

    tokens: np.ndarray
    weights: np.ndarray
    p: PackParams

    @property
    def quanta(self) -> np.ndarray:
        return self.tokens // self.p.quantum

    def rank(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Quanta of all queues due before quantum j of a queue; ties go to the earlier queue."""
        own, out, quanta = self.weights[queue], np.zeros(len(j), np.int64), self.quanta
        for r, (w, m) in enumerate(zip(self.weights.tolist(), quanta.tolist())):
            # quanta i of queue r with (2 i + 1) / w below, or at, (2 j + 1) / own
            due = (2 * j + 1) * w
            before = -((own - due) // (2 * own))
            at_most = (due - own) // (2 * own) + 1
            out += np.clip(np.where(r < queue, at_most, before), 0, m)
        return out

    def places(self, queue: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The place of a queue's token in the stream of all tokens."""
        q, quanta = self.p.quantum, self.quanta
        tail = self.tokens - quanta * q
        tails = quanta.sum() * q + np.cumsum(tail) - tail
        j = start // q
        last = j >= quanta[queue]
        out = tails[queue] + start - quanta[queue] * q
        if not last.all():
            out[~last] = self.rank(queue[~last], j[~last]) * q + start[~last] % q
        return out

    def sequences(self) -> np.ndarray:
        """Where the sequences after the last full window start, and the end: powers of two."""
        total = int(self.tokens.sum())
        rest, at, out = total % self.p.window, total - total % self.p.window, []
        for bit in reversed(range(self.p.window.bit_length())):
            if rest >> bit & 1:
                out.append(at)
                at += 1 << bit
        return np.array([*out, at], np.int64)


def _pieces(queue: np.ndarray, start: np.ndarray, n: np.ndarray, deal: Deal):
    """Document, token of the document, length and place in the stream of each piece, pieces as long as they can be."""
    q, window = deal.p.quantum, deal.p.window
    first, last = start // q, (start + n - 1) // q
    count = last - first + 1
    doc = np.repeat(np.arange(len(n)), count)
    j = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    lo, hi = np.maximum(j * q, start[doc]), np.minimum((j + 1) * q, start[doc] + n[doc])
    at = deal.places(queue[doc], lo)
    rest = deal.sequences()

    def cut(doc, lo, hi, at, where):
        """Split the pieces that go over ``where``."""
        over = (at < where) & (at + hi - lo > where)
        if not over.any():
            return doc, lo, hi, at
        mid = (lo + where - at)[over]
        return (np.concatenate([doc, doc[over]]), np.concatenate([lo, mid]),
                np.concatenate([np.where(over, lo + where - at, hi), hi[over]]), np.concatenate([at, where[over]]))

    doc, lo, hi, at = cut(doc, lo, hi, at, (at // window + 1) * window)
    for where in rest[:-1]:
        doc, lo, hi, at = cut(doc, lo, hi, at, np.full(len(at), where))
    by = np.lexsort((lo, doc))
    doc, lo, hi, at = doc[by], lo[by], hi[by], at[by]
    full = int(rest[0]) // window
    sequence = np.where(at < rest[0], at // window, full + np.searchsorted(rest, at, "right") - 1)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sequence[1:] != sequence[:-1]) | (at[1:] != (at + hi - lo)[:-1])
    head = np.flatnonzero(new)
    end = np.append(head[1:], len(doc)) - 1
    offset = at[head] - np.where(at[head] < rest[0], sequence[head] * window, rest[np.clip(sequence[head] - full, 0, len(rest) - 1)])
    return doc[head], lo[head] - start[doc[head]], hi[end] - lo[head], sequence[head], offset


def packed(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` for each piece of a row of ``docs`` (``doc_id, text,
    source``; other columns are left alone). ``ids`` holds little-endian unsigned 32-bit numbers.

    A null text is empty and has the end id only; rows without source have a queue of their own; rows that share a
    ``doc_id`` are packed one by one. An empty table gives no rows.
    """
    p = params
    rows = stored(tokenized(docs, p), "tokens", "zstd")
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    top = sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), F.col("source").asc_nulls_last()).limit(
        p.queues).collect()
    # queue 0 holds all other sources
    queue_of = docs.sparkSession.createDataFrame([(r["source"], i + 1) for i, r in enumerate(top)], "source string, queue int")
    sums = stored(
        sums.join(F.broadcast(queue_of), sums["source"].eqNullSafe(queue_of["source"]), "left")
        .select(sums["source"], "part", "tokens", F.coalesce("queue", F.lit(0)).alias("queue")), "source-sums")
    before = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("queued", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    tokens = np.zeros(len(top) + 1, np.int64)
    for r in sums.groupBy("queue").agg(F.sum("tokens").alias("n")).collect():
        tokens[r["queue"]] = r["n"]
    if p.weights is None:
        weights = np.array([max(1, t * _SCALE // max(1, int(tokens.sum()))) for t in tokens.tolist()], np.int64)
    else:
        weights = np.array([1, *(p.weights.get(r["source"], 1) for r in top)], np.int64)
    deal = docs.sparkSession.sparkContext.broadcast(Deal(tokens, weights, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                queue, start, n = (part.column(i).to_numpy() for i in (1, 2, 3))
                doc, first, length, sequence, offset = _pieces(queue, start, n, deal.value)
                blobs = part.column(4).to_pylist()
                kind = [np.uint16 if len(b) == 2 * m else np.uint32 for b, m in zip(blobs, n.tolist())]
                ids = [np.frombuffer(b, k).astype("<u4").tobytes() for b, k in zip(blobs, kind)]
                pieces = [ids[d][4 * f:4 * (f + l)] for d, f, l in zip(doc.tolist(), first.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), *map(pa.array, (first, length)), pa.array(pieces, pa.binary()),
                     pa.array(n[doc]), *map(pa.array, (sequence, offset))],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    keyed = rows.join(starts.select("source", "part", "queue", "queued"),
                      rows["source"].eqNullSafe(starts["source"]) & (rows["part"] == starts["part"]))
    return keyed.select(rows["doc_id"], "queue", (F.col("queued") + F.col("before")).alias("at"), "n", "ids").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
