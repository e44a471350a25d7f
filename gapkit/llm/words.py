"""Words, word hashes and word windows of whole text columns, as numpy arrays over Arrow buffers.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``. UTF-8 never uses these bytes inside another code point, so
words of bytes are words of text. A word's hash is the first 64 bits, or all 128, of its BLAKE2b digest, taken once for each
different word of a batch: no texts can be made whose words clash, and equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n odd constants."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * _GOLD) | np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


@dataclass
class Words:
    """The words of some texts. Word i covers ``data[starts[i]:ends[i]]``; text d has words ``bounds[d]`` to ``bounds[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def column(self, lower: bool = False) -> pa.Array:
        """The words as a column of bytes; with ``lower``, A-Z as a-z."""
        ends = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        data = self.data[~_SPACE[self.data]] if len(self.data) else self.data
        data = _LOWER[data] if lower else data
        return pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])

    @staticmethod
    def numbered(column: pa.Array) -> pa.DictionaryArray:
        """A column of words as its different words and each word's number among them, by their bytes."""
        return column.dictionary_encode()

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One hash of 64 bits for each word; with ``lower``, A-Z count as a-z."""
        coded = self.numbered(self.column(lower))
        return digests(coded.dictionary)[:, 0][coded.indices.to_numpy()]

    def wide_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of a hash of 128 bits for each word; the first is that of ``hashes``."""
        coded = self.numbered(self.column())
        both = digests(coded.dictionary)[coded.indices.to_numpy()]
        return both[:, 0], both[:, 1]


def values_of(column: pa.Array) -> list[bytes]:
    """The values of a large binary column without nulls, cut out of its bytes at once."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1].tolist() if len(column) else [0]
    start = at[0]
    joined = data.slice(start, at[-1] - start).to_pybytes() if data is not None else b""
    return [joined[a - start:b - start] for a, b in zip(at, at[1:])]


def digests(column: pa.Array) -> np.ndarray:
    """Two columns of 64 bits, for values of bytes."""
    found = b"".join([blake2b(x, digest_size=16).digest() for x in values_of(column)])
    return np.frombuffer(found, "<u8").astype(np.uint64).reshape(-1, 2)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's offsets in them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def words_of(column: pa.Array) -> Words:
    return words_in(*raw(column))


def words_in(data: np.ndarray, at: np.ndarray) -> Words:
    """The words of the texts ``data[at[d]:at[d + 1]]``, which follow each other."""
    if not len(data):
        return Words(data, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64))
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a text or the data begins here
    edge[at] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of about ``limit`` bytes of text, and of one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(int(np.searchsorted(at, at[lo] + limit, "right")) - 1, lo + 1)
            hi = min(hi, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()  # the worker stays, for other tasks


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive words of one text, and the word at which each starts."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n - k + 1, np.uint64)
    for j, c in enumerate(seeds(k, 2)):
        out += hashes[j:n - k + 1 + j] * c
    left = np.repeat(bounds[1:], np.diff(bounds))[:n - k + 1] - np.arange(n - k + 1)
    at = np.flatnonzero(left >= k)
    return mix(out[at]), at


def whole(hashes: np.ndarray, bounds: np.ndarray, salt: int = 3) -> np.ndarray:
    """One hash for each text's word sequence; texts without words give the same value."""
    counts = np.diff(bounds)
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(bounds[:-1], counts).astype(np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ mix((place + np.uint64(salt)) * _GOLD)), out=sums[1:])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + counts.astype(np.uint64) * _GOLD)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's bigint holds them."""
    return x.view(np.int64)
