"""Alignment of two tokenizers' tokens over the same bytes, with a fast path for tokens that both have.

Byte offsets at which a token of A and a token of B both end cut a text into groups; the two tokens that end there are linked.
An array gives for each id of A the id of B with the same bytes. A group of one token each, which that array pairs, is *exact*:
it is one id of A, stored and counted by it, in vectors as long as the vocabulary. Only the links of all other groups become
pairs that are shuffled.

1. Texts are cut before a space that follows no white space. No token of either tokenizer crosses such a place, nor
   does a token depend on what is beyond, so a text's tokens are those of its segments, and segments met before are looked
   up, by their bytes. Each document keeps its exact ids and its irregular pairs.
2. Exact ids are summed into vectors in each task, pairs by Spark; both give the counts of links in the corpus.
3. Documents look their links up: exact ones and the ``hot`` most frequent pairs in arrays of bounded size, which all tasks
   hold; all rarer pairs by a join, whose keys are rare by construction.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gapkit.llm.shared import stored
from gapkit.llm.words import raw, slices

_SPACE = 0x20
# bytes after which a space is no cut: white space, and last bytes of Unicode's other white space
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[*range(0x21), 0x7F, *range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


@dataclass(frozen=True)
class AlignParams:
    """A is a byte-level tokenizer, B a piece model with byte fallback. ``hot`` pairs are held by all tasks, 16 bytes each."""

    a: str = "byte_bpe_50k.json"
    b: str = "piece_bpe_32k.model"
    hot: int = 1 << 17


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones of Latin-1 are themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Aligned:
    """Segments: tokens of A, of B and groups of each (``numbers``), the groups as text, exact ids and irregular pairs behind each other
    with the place where each segment's end, and which segments have tokens of other bytes than their own (``bad``, all empty)."""

    numbers: np.ndarray
    groups: pa.Array
    exact: np.ndarray
    exact_ends: np.ndarray
    pairs: np.ndarray
    pair_ends: np.ndarray
    bad: np.ndarray

    def __add__(self, other: Aligned) -> Aligned:
        return Aligned(
            np.concatenate([self.numbers, other.numbers]), pa.concat_arrays([self.groups, other.groups]),
            np.concatenate([self.exact, other.exact]), np.concatenate([self.exact_ends, other.exact_ends + len(self.exact)]),
            np.concatenate([self.pairs, other.pairs]), np.concatenate([self.pair_ends, other.pair_ends + len(self.pairs)]),
            np.concatenate([self.bad, other.bad]))


def _joined(texts: pa.Array, ends: np.ndarray, mark: str) -> pa.Array:
    """The texts of each of some lists, which follow each other, with a mark between."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int64)), texts), pa.scalar(mark, pa.large_string()))


class Aligner:
    """Tokens and groups of segments."""

    def __init__(self, p: AlignParams):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(p.a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(p.b))
        alphabet = byte_alphabet()
        # an id without bytes of its own, such as a special token, never fits a text
        self.bytes_a = [b"\xff\xff"] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            if all(c in alphabet for c in token):
                self.bytes_a[i] = bytes(alphabet[c] for c in token)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        plain = {x: i for i, x in enumerate(self.bytes_b) if self.b.is_byte(i)}
        plain |= {x: i for i, x in enumerate(self.bytes_b) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        self.same = np.array([plain.get(x, -1) for x in self.bytes_a], np.int64)
        self.tokens = [pa.array(x, pa.large_binary()) for x in (self.bytes_a, self.bytes_b)]
        self.sizes = [np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b)]
        self.width = len(self.bytes_b)
        self.cut = not any(" " in x.decode(errors="replace").lstrip(" ") for x in self.bytes_b)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _ids(self, segments: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: all ids, and the number of each segment's."""
        out = [([], []), ([], [])]
        for lo in range(0, len(segments), 4096):  # what the tokenizers return takes far more memory than the ids
            texts = [s.decode() for s in segments[lo:lo + 4096]]
            found = ([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1))
            for (ids, counts), lists in zip(out, found):
                counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
                ids.append(np.fromiter(chain.from_iterable(lists), np.int64, int(counts[-1].sum())))
        return [tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in side) for side in out]

    def _spells(self, side: int, ids: np.ndarray, segments: pa.Array) -> bool:
        """Whether the tokens' bytes, behind each other, are those of the segments."""
        def data(column):
            _, offsets, buffer = column.buffers()
            at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
            return np.frombuffer(buffer, np.uint8)[at[0]:at[-1]] if buffer is not None and len(column) else np.empty(0, np.uint8)

        return np.array_equal(data(self.tokens[side].take(pa.array(ids))), data(segments))

    def __call__(self, segments: pa.Array) -> Aligned:
        """Align segments, which begin with a space."""
        values = segments.to_pylist()
        sides = self._ids(values)
        length = np.fromiter(map(len, values), np.int64, len(values))
        of = [np.repeat(np.arange(len(values)), counts) for _, counts in sides]
        bad = np.zeros(len(values), bool)
        for (ids, _), seg, sizes in zip(sides, of, self.sizes):
            bad |= np.bincount(seg, sizes[ids], len(values)).astype(np.int64) != length
        chosen = segments.filter(pa.array(~bad)) if bad.any() else segments
        for side, ((ids, _), seg) in enumerate(zip(sides, of)):
            if not self._spells(side, ids[~bad[seg]], chosen):  # right in length only: look at each
                starts = np.searchsorted(seg, np.arange(len(values) + 1))
                table = (self.bytes_a, self.bytes_b)[side]
                bad |= [b"".join(table[i] for i in ids[a:b].tolist()) != s for s, a, b in zip(values, starts.tolist(), starts[1:].tolist())]
        if bad.any():
            length = np.where(bad, 0, length)
            keep = [~bad[seg] for seg in of]
            sides, of = [(ids[k], None) for (ids, _), k in zip(sides, keep)], [seg[k] for seg, k in zip(of, keep)]
        (a, b), ends = (ids for ids, _ in sides), [np.cumsum(sizes[ids]) for (ids, _), sizes in zip(sides, self.sizes)]
        last_b = np.minimum(np.searchsorted(ends[1], ends[0]), max(0, len(b) - 1))
        meets = ends[1][last_b] == ends[0] if len(b) else np.zeros(len(a), bool)
        # the places of the tokens that end each group
        i, j = np.flatnonzero(meets), last_b[meets]
        single = (np.diff(i, prepend=-1) == 1) & (np.diff(j, prepend=-1) == 1)
        exact = single & (self.same[a[i]] == b[j])
        seg = of[0][i]
        text = pc.binary_join_element_wise(*(
            _joined(pa.array(ids).cast(pa.large_string()), at + 1, ",") for ids, at in ((a, i), (b, j))), pa.scalar("|", pa.large_string()))
        bounds = np.searchsorted(seg, np.arange(1, len(values) + 1))
        numbers = np.stack([np.bincount(x, minlength=len(values)) for x in (*of, seg)], axis=1).astype(np.int64)
        return Aligned(numbers, _joined(text, bounds, ";"), a[i][exact], np.append(0, np.cumsum(exact))[bounds],
                       (a[i] * self.width + b[j])[~exact], np.append(0, np.cumsum(~exact))[bounds], bad)


_aligners: dict[AlignParams, Aligner] = {}


def aligner(p: AlignParams) -> Aligner:
    if p not in _aligners:
        _aligners[p] = Aligner(p)
    return _aligners[p]


def segments_of(column: pa.Array, cut: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The segments of all texts, each text with a space in front, and the bounds of each text's segments."""
    data, at = raw(column)
    full = np.diff(at) > 0
    data = np.insert(data, at[:-1][full], _SPACE)
    at = at + np.concatenate([[0], np.cumsum(full)])
    first = np.zeros(len(data) + 1, bool)
    if cut and len(data):
        first[1:-1] = (data[1:] == _SPACE) & ~_NO_CUT[data[:-1]]
        first[at[1:][full] - 1] = False  # a space alone has no token of B
    first[at] = True
    first[-1] = False
    starts = np.flatnonzero(first)
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(starts, at)


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _picked(flat: np.ndarray, ends: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at ``pick`` behind each other, and where each ends; lists follow each other in ``flat``."""
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    n = (ends - starts)[pick]
    out = np.cumsum(n)
    return flat[np.repeat(starts[pick] - (out - n), n) + np.arange(int(n.sum()))], out


ROWS = "key long, doc_id long, n_a long, n_b long, n_groups long, groups string, exact binary, pairs binary"


def tokenized(docs: DataFrame, p: AlignParams, digest: bool) -> DataFrame:
    """One row for each of ``docs``: its numbers, its groups, its exact ids as 32-bit and its irregular pairs as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, row = aligner(p), TaskContext.get().partitionId() << 40
        for part in slices(batches):
            column, bounds = segments_of(part.column(1), of.cut)
            coded = column.dictionary_encode()
            found, pick = of(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
            if found.bad.any():  # a text with such a segment is judged as a whole, as its own segment
                counts = np.diff(bounds)
                wrong = np.flatnonzero(np.diff(np.append(0, np.cumsum(found.bad[pick]))[bounds]))
                whole = of(pa.array([b" " + part.column(1)[int(d)].as_py().encode() for d in wrong], pa.large_binary()))
                place = {int(d): len(found.bad) + i for i, d in enumerate(wrong)}
                found += whole
                pick = np.concatenate([np.empty(0, np.int64), *(
                    [place[d]] if d in place else pick[bounds[d]:bounds[d + 1]] for d in range(part.num_rows))]).astype(np.int64)
                counts[wrong] = 1
                bounds = np.append(0, np.cumsum(counts))
            n = np.diff(np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(found.numbers[pick], axis=0)])[bounds], axis=0)
            texts = found.groups.take(pa.array(pick))
            texts = _joined(texts, bounds[1:], ";")
            if digest:
                texts = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() if x.as_buffer().size else "" for x in texts], pa.string())
            blobs = []
            for flat, ends, kind in ((found.exact, found.exact_ends, np.uint32), (found.pairs, found.pair_ends, np.int64)):
                values, ends = _picked(flat, ends, pick)
                blobs.append(_blobs(values.astype(kind), np.append(0, ends)[bounds]))
            keys = row + np.arange(part.num_rows)
            row += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), part.column(0), *(pa.array(n[:, i]) for i in range(3)), texts.cast(pa.string()), *blobs],
                names=["key", "doc_id", "n_a", "n_b", "n_groups", "groups", "exact", "pairs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROWS)


def _values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of blobs behind each other, and the bounds of each row's."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.empty(0, kind) if data is None else np.frombuffer(data.to_pybytes()[at[0]:at[-1]], kind)
    return data, (at - at[0]) // np.dtype(kind).itemsize


def pair_counts(rows: DataFrame, p: AlignParams) -> DataFrame:
    """``a, pair, n``: how many exact links hold an id of A (``pair`` is null), how many irregular links a pair (``a`` is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.zeros(0, np.int64)
        for batch in batches:
            ids, _ = _values(batch.column(0), np.uint32)
            here = np.bincount(ids, minlength=len(exact))
            here[:len(exact)] += exact
            exact = here
            pairs, n = np.unique(_values(batch.column(1), np.int64)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(pairs), pa.array(n)], names=["a", "pair", "n"])
        ids = np.flatnonzero(exact)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(exact[ids])], names=["a", "pair", "n"])

    return rows.select("exact", "pairs").mapInArrow(run, "a long, pair long, n long").groupBy("a", "pair").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, params: AlignParams = AlignParams(), digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each row of ``docs`` (``doc_id, text``; other columns
    are left alone).

    ``n_best`` are the links whose pair is the most frequent one of its id of B in the corpus, ties included; ``count_sum`` is the
    sum of the pairs' counts over the links. ``groups`` lists the ids, ``a1,a2|b1;a3|b2,b3``, or is, with ``digest``, the SHA-256 of
    that in hexadecimal. Texts that are null or empty, or whose tokens' bytes are not a space and the text, have no tokens: all
    numbers are zero and ``groups`` is empty. Rows are judged one by one and all count, so rows that repeat count again.
    Texts of any length are read whole. An empty table gives no rows.
    """
    p = params
    of = aligner(p)
    width = of.width
    rows = stored(tokenized(docs, p, digest), "aligned", "zstd")
    counts = stored(pair_counts(rows, p), "pair-counts")
    # vectors as long as a vocabulary, and the hot pairs, whose number is a parameter
    exact = np.zeros(len(of.bytes_a), np.int64)
    for a, n in counts.where("a is not null").select("a", "n").collect():
        exact[a] = n
    best = np.zeros(width, np.int64)
    same = of.same
    np.maximum.at(best, same[same >= 0], exact[same >= 0])
    pairs = counts.where("pair is not null").select("pair", "n")
    for b, n in pairs.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("n")).collect():
        best[b] = max(best[b], n)
    top = pairs.orderBy(F.desc("n"), "pair").limit(p.hot).toArrow()
    hot, hot_n = top.column("pair").to_numpy(), top.column("n").to_numpy()
    rare = pairs
    if len(hot):
        n, pair = int(hot_n[-1]), int(hot[-1])
        rare = pairs.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("pair") > pair)))
    order = np.argsort(hot)
    held = docs.sparkSession.sparkContext.broadcast((exact, best, same, hot[order], hot_n[order]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, best, same, hot, hot_n = held.value
        for batch in batches:
            ids, at = _values(batch.column(1), np.uint32)
            n = exact[ids]
            sums, hits = (np.append(0, np.cumsum(x)) for x in (n, n == best[same[ids]]))
            total, good = np.diff(sums[at]), np.diff(hits[at])
            codes, at = _values(batch.column(2), np.int64)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, codes), len(hot) - 1)
                n = np.where(hot[place] == codes, hot_n[place], 0)
            else:
                n = np.zeros(len(codes), np.int64)
            sums, hits, cold = (np.append(0, np.cumsum(x)) for x in (n, (n > 0) & (n == best[codes % width]), n == 0))
            rest = pa.ListArray.from_arrays(pa.array(cold[at].astype(np.int32)), pa.array(codes[n == 0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total + np.diff(sums[at])), pa.array(good + np.diff(hits[at])), rest],
                names=["key", "count_sum", "n_best", "cold"])

    found = rows.select("key", "exact", "pairs").mapInArrow(look, "key long, count_sum long, n_best long, cold array<long>")
    cold = found.select("key", F.explode("cold").alias("pair")).groupBy("key", "pair").agg(F.count(F.lit(1)).alias("times"))
    bests = docs.sparkSession.createDataFrame(list(enumerate(best.tolist())), "b long, most long")  # one row an id of B
    rare = rare.join(F.broadcast(bests), F.col("pair") % width == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    late = cold.join(rare, "pair").groupBy("key").agg(
        F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"))
    plain = rows.drop("exact", "pairs").join(found.drop("cold"), "key").join(late, "key", "left")
    zero = F.lit(0).cast("long")
    return plain.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups")
