"""Words, n-grams and their 64-bit hashes over whole Arrow batches, without a Python object per word.

A string column is one byte buffer with offsets. Words are the maximal runs of bytes other than the
six ASCII white-space characters; a word's hash is a polynomial over its bytes modulo 2^64, taken from
one running sum over the buffer and brought to the word's start with the inverse of the base. A buffer is
gone through in chunks of whole words, so the arrays beside a very long text stay small.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import mix64, sliced

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: A random-looking 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(256, dtype=np.uint64), 77) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Odd factors of the words of a window, by their place in it.
STEPS = mix64(np.arange(64, dtype=np.uint64), 78) | np.uint64(1)

#: Text bytes of a batch (one text at least), and bytes of it gone through at once; the arrays beside such a
#: chunk take some sixty times as much.
SLICE_BYTES, CHUNK_BYTES = 600_000, 1 << 20


def base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2)) + 1
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null is empty) and the bounds of its texts in them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Texts:
    """A batch of texts as bytes, with the words of all of them.

    ``first[i]:first[i + 1]`` are document i's words in ``hashes`` (64-bit), ``starts`` and ``ends``
    (byte positions in ``data``); ``begins[i]:begins[i + 1]`` are its bytes.
    """

    def __init__(self, column: pa.Array, lower: bool = False, chunk: int = CHUNK_BYTES):
        data, self.begins = text_buffer(column)
        self.data, self.chunk = LOWER[data] if lower else data, chunk
        found = [self._words(a, b) for a, b in self._chunks()] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        self.starts, self.ends, self.hashes = (np.concatenate(x) if len(found) > 1 else x[0] for x in zip(*found, strict=True))
        self.first = np.searchsorted(self.starts, self.begins)

    def _chunks(self) -> Iterator[tuple[int, int]]:
        """Bounds of about ``chunk`` bytes that cut no word."""
        at, n = 0, len(self.data)
        while at < n:
            stop = at + self.chunk
            while stop < n:  # on to the next white space or text
                begin = self.begins[min(np.searchsorted(self.begins, stop), len(self.begins) - 1)]
                free = np.flatnonzero(SPACES[self.data[stop : stop + self.chunk]])
                stop = min(int(begin), stop + int(free[0])) if len(free) else min(int(begin), stop + self.chunk)
                if len(free) or stop == begin:
                    break
            stop = min(stop, n)
            yield at, stop
            at = stop

    def _words(self, at: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of the words between two bounds."""
        data, n = self.data[at:stop], stop - at
        inside = ~SPACES[data]
        cut = np.zeros(n + 1, bool)
        cut[self.begins[slice(*np.searchsorted(self.begins, [at, stop + 1]))] - at] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        powers, inverse = base_powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers, out=sums[1:])
        return starts + at, ends + at, mix64((sums[ends] - sums[starts]) * inverse[starts])

    def __len__(self) -> int:
        return len(self.begins) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each run of k words inside a document, index of its first word)."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        room = np.repeat(self.first[1:], self.n_words) - np.arange(n) >= k
        out = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            out += self.hashes[j : n - k + 1 + j] * STEPS[j]
        return mix64(out[room[: n - k + 1]], 3), np.flatnonzero(room)

    def byte_windows(self, k: int, start: int = 0, stop: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hash of each run of k bytes inside a document, its document), chunk by chunk, of documents start..stop."""
        low, high = int(self.begins[start]), int(self.begins[-1 if stop is None else stop])
        for at in range(low, high, self.chunk):
            data = self.data[at : min(at + self.chunk + k - 1, high)]
            n = len(data) - k + 1
            if n <= 0:
                continue
            out = np.zeros(n, np.uint32)
            for j in range(k):
                out = out * np.uint32(0x01000193) + BYTE_VALUES[data[j : n + j]].astype(np.uint32)
            out ^= out >> np.uint32(15)
            out = out * np.uint32(0x2C1B3C6D)
            out ^= out >> np.uint32(12)
            place = np.arange(at, at + n)
            doc = np.searchsorted(self.begins, place, side="right") - 1
            room = self.begins[doc + 1] - place >= k
            yield out[room], doc[room]


def _give_back() -> None:
    """Return freed memory to the system: workers are kept for later stages and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: glibc's malloc_trim; other C libraries have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def text_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices small enough for ``Texts``; at a task's end, freed memory is given back."""
    yield from sliced(batches, text, most, 4096)
    _give_back()


def sums_by_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring bounds."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
