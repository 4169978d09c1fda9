"""Exact, cached tokenization of whole texts.

Both vocabularies cut a text into pieces before they merge, and some cuts depend on nothing around
them: before a space that follows a visible character, and between a letter and a mark. A text's ids
are those of the chunks between such cuts, one after another. Chunks are told apart by a 64-bit hash
and their length; a worker encodes a chunk that it does not know with the tokenizers library and keeps
its ids in one flat array, from which whole batches are put together. Texts that hold a special
token's string are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tessera.llm.common import mix64
from tessera.llm.words import BYTE_VALUES, SPACES, base_powers, text_buffer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A worker forgets its chunks when it holds this many, or this many ids of chunks; results do not change.
MOST_CHUNKS, MOST_IDS = 3_000_000, 24_000_000
#: New chunks are sorted in among the known ones when there are this many.
MERGE_AT = 150_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b'.,;:!?|$%&*#"()[]{}')] = True
_VISIBLE = ~SPACES
_VISIBLE[128:] = False
# Bytes that begin a character which is no white space: visible ASCII, and two-byte characters beyond the first 64.
_BEGINS_VISIBLE = _VISIBLE.copy()
_BEGINS_VISIBLE[0xC3:0xE0] = True

_open: dict[tuple[str, str], ChunkEncoder] = {}


class _Known:
    """Sorted chunk hashes with byte length, place in the id pool and number of ids."""

    def __init__(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, 3), np.int64)

    def add(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.rows = np.insert(self.hash, at, hashes), np.insert(self.rows, at, rows, axis=0)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row number of each hash, -1 if it is unknown."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)


class ChunkEncoder:
    """Encodes columns of texts to ids with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known, self.recent, self.pool, self.used = _Known(), _Known(), np.zeros(1 << 16, self.dtype), 0

    def _starts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where chunks start: at documents, and at the cuts that depend on nothing around them."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 1:
            space, before, after = data[1:] == 0x20, data[:-1], np.append(data[2:], np.uint8(ord("x")))
            cut[1:n] = space & (_VISIBLE[before] | ((before != 0x20) & _BEGINS_VISIBLE[after]))
            cut[1:n] |= _MARK[data[1:]] & _LETTER[before]
        raw = data.tobytes() if self.specials else b""
        for special in self.specials:
            at = raw.find(special)
            while at >= 0:
                doc = int(np.searchsorted(begins, at, side="right")) - 1
                cut[begins[doc] : begins[doc + 1]] = False
                at = raw.find(special, int(begins[doc + 1]))
        cut[begins] = True
        return np.flatnonzero(cut[:n])

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        if len(self.known.hash) + len(self.recent.hash) + len(chunks) > MOST_CHUNKS or self.used > MOST_IDS:
            self._forget()
        rows = np.zeros((len(chunks), 3), np.int64)
        for i in range(0, len(chunks), 4096):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks[i : i + 4096]], add_special_tokens=False)]
            sizes = np.array([len(x) for x in found], np.int64)
            total = int(sizes.sum())
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + total] = np.fromiter((t for x in found for t in x), self.dtype, total)
            rows[i : i + len(found), 1], rows[i : i + len(found), 2] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += total
        rows[:, 0] = [len(c) for c in chunks]
        self.recent.add(hashes, rows)
        if len(self.recent.hash) > MERGE_AT:
            self.known.add(self.recent.hash, self.recent.rows)
            self.recent = _Known()

    def _rows(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, place, ids) of each chunk, and which ones are known."""
        out, has = np.zeros((len(hashes), 3), np.int64), np.zeros(len(hashes), bool)
        for part in (self.known, self.recent):
            at = part.find(hashes)
            hit = at >= 0
            out[hit] = part.rows[at[hit]]
            has |= hit
        return out, has & (out[:, 0] == lengths)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds of the documents in them); null is the empty text."""
        data, begins = text_buffer(column)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(begins), np.int64)
        starts = self._starts(data, begins)
        ends = np.append(starts[1:], len(data))
        powers, inverse = base_powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers, out=sums[1:])
        hashes, first, chunk = np.unique(mix64((sums[ends] - sums[starts]) * inverse[starts]), return_index=True, return_inverse=True)
        lengths = (ends - starts)[first]
        rows, has = self._rows(hashes, lengths)
        if not has.all():
            new, raw = np.flatnonzero(~has), data.tobytes()
            if len(self.known.hash) + len(self.recent.hash) + len(new) > MOST_CHUNKS or self.used > MOST_IDS:
                self._forget()
                new = np.arange(len(hashes))
            self._learn(hashes[new], [raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            rows, has = self._rows(hashes, lengths)
            if not has.all():
                raise ValueError("two chunks have one 64-bit hash")
        sizes = rows[chunk, 2]
        stop = np.cumsum(sizes)
        ids = self.pool[np.repeat(rows[chunk, 1] - (stop - sizes), sizes) + np.arange(stop[-1])]
        return ids, np.append(0, stop)[np.searchsorted(starts, begins)]


def encoder(path: str, dtype: str = "<u4") -> ChunkEncoder:
    """The worker's encoder for a vocabulary file, opened once."""
    if (path, dtype) not in _open:
        _open[path, dtype] = ChunkEncoder(path, dtype)
    return _open[path, dtype]
