"""Packing documents into sequences by best-fit decreasing.

A document's ids are cut into full windows; what is left over is placed, longest first, into the open
window with the least room that still takes it. A segment tree over the remaining capacity finds that
window in logarithmic time. Blocks of a bounded number of ids are packed where their rows lie, so
nothing is shuffled and no task holds more than a block.

Defined cases: a null text is the empty text (one piece with the end id); rows that repeat a key are
packed each for itself; a null key is kept; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import encoder
from tessera.llm.words import text_batches

#: Ids of a block that is packed by itself.
BLOCK_IDS = 4_000_000

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class CapacityTree:
    """Counts of open windows by remaining capacity, with the least capacity of at least n on request."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that an open window has, -1 if there is none."""
        at, count = self.leaves + need, self.count
        if count[at]:
            return need
        while at > 1:  # up to the first right sibling that holds a window, then down to its leftmost
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) for each piece of at most ``window`` ids, and the number of sequences."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, open_by_room, n = CapacityTree(window), [[] for _ in range(window + 1)], 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if length == window:
            sequence[i], n = n, n + 1
            continue
        room = tree.least(length)
        if room < 0:
            at, room, n = n, window, n + 1
        else:
            at = open_by_room[room].pop()
            tree.add(room, -1)
        sequence[i], offset[i] = at, window - room
        if room > length:
            open_by_room[room - length].append(at)
            tree.add(room - length, 1)
    return sequence, offset, n


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = 4096, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Pieces of all documents with their places in sequences; ``ids`` are little-endian uint32.

    ``sequence_id`` is the task's number times 2^40 plus the sequence's number in it.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([*[(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, base = encoder(vocabulary).encode, TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, base
            n_ids = np.array([len(x) // 4 for _, x in held], np.int64)
            cuts = -(-n_ids // window)
            doc = np.repeat(np.arange(len(held)), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * window
            length = np.minimum(window, n_ids[doc] - start)
            sequence, offset, n = best_fit(length, window)
            keys = pa.array([k for k, _ in held], pa.int64())
            for i in range(0, len(doc), 2048):
                s = slice(i, i + 2048)
                ids = [held[d][1][4 * a : 4 * (a + k)] for d, a, k in zip(doc[s].tolist(), start[s].tolist(), length[s].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc[s])), pa.array(start[s]), pa.array(length[s]), pa.array(n_ids[doc[s]]), pa.array(sequence[s] + base), pa.array(offset[s]), pa.array(ids, pa.binary())], schema=schema)
            held, size, base = [], 0, base + n

        for batch in text_batches(batches):
            ids, bounds = encode(batch.column("text"))
            raw, at = ids.tobytes(), (4 * bounds).tolist()
            held += [(key, raw[a:b] + end) for key, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True)]
            size += len(ids) + batch.num_rows
            if size >= block_ids:
                yield from close()
        if held:
            yield from close()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(pieces, PIECE)
