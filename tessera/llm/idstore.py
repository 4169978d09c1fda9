"""Token ids in binary shards with a minimal perfect hash index from document keys to offsets.

``write_store`` encodes documents in ascending key order and writes shards; ``read_documents`` reads
every document back through the index and ``lookup`` fetches given keys.

A shard is one row of the store: the raw id payload (little-endian, 16 bits wide where the vocabulary
fits), the documents' keys in order, and the index: a level-by-level minimal perfect hash (each level
keeps the keys that alone fall on a slot, the rest go to the next level; a key's place is the rank of
its bit, from counts kept for each 512 bits), and per place a 32-bit fingerprint, the start and the length
in the payload. A probe reads a constant number of words on average, on the packed bytes as they lie, and
never searches the keys.

Shards are rows of an uncompressed Parquet table because Spark's committed writers are the only ones
that both survive lost executors and reach every file store the session reaches.

Defined cases: a null text is the empty text (only the end id); rows with a null key come first and are
kept; rows that repeat a key are all kept, told apart by their number among the key's rows (in text
order); an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import mix64
from tessera.llm.tokens import encoder
from tessera.llm.words import text_batches

#: Slots of a level for each key that reaches it.
GAMMA = 1.5
#: Keys of one row of a request to a shard, by their distance.
BLOCK_KEYS = 4096
#: A shard is closed when its payload reaches this many bytes.
SHARD_BYTES = 8 << 20

SHARD = "part int, shard int, first_key long, last_key long, n_docs long, start_in_part long, n_tokens long, keys binary, valid binary, levels binary, places binary, payload binary"


def key_hashes(keys: np.ndarray, valid: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    """64-bit hashes of (key or null, number among the key's rows)."""
    plain = mix64(np.where(valid, keys, 0).astype(np.int64).view(np.uint64))
    return mix64(plain ^ mix64(ordinal.astype(np.uint64) * np.uint64(2) + (~valid).astype(np.uint64), 5), 1)


#: Slots of a level whose set bits are counted ahead: eight 64-bit words and their running count.
RANK_SLOTS = 512


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit hashes, made of bit levels.

    All levels are one array of 64-bit words, each level from a multiple of ``RANK_SLOTS`` bits on, beside
    the number of set bits before each block of eight words. A probe reads one word a level, and for the
    place of its bit at most one block; nothing is unpacked.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        blocks = -(-sizes // RANK_SLOTS)
        self.starts = (np.cumsum(blocks) - blocks) * RANK_SLOTS

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes: list[int] = []
        levels: list[np.ndarray] = []
        left = hashes
        while len(left):
            if len(levels) == 64:
                raise ValueError("two keys have one 64-bit hash")
            size = max(8, int(GAMMA * len(left)))
            slot = (mix64(left, 10 + len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            levels.append(np.pad(bits, (0, -size % RANK_SLOTS)))
            left = left[~bits[slot]]
        flat = np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool), bitorder="little")
        words = flat.view("<u8")
        total = np.cumsum(np.bitwise_count(words).reshape(-1, RANK_SLOTS // 64).sum(1, dtype=np.int64))
        return cls(np.array(sizes, np.int64), words, np.append(0, total[:-1]).astype("<u4") if len(total) else np.zeros(0, "<u4"))

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's place, -1 where no level holds it."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for n, (size, start) in enumerate(zip(self.sizes.tolist(), self.starts.tolist(), strict=True)):
            bit = start + (mix64(hashes[todo], 10 + n) % np.uint64(size)).astype(np.int64)
            hit = (self.words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[todo[hit]] = self._rank(bit[hit])
            todo = todo[~hit]
            if not len(todo):
                break
        return out

    def _rank(self, bit: np.ndarray) -> np.ndarray:
        """Set bits before each place: those before its block, in the block's words before its own, and in its word."""
        word, block = bit >> 6, bit // RANK_SLOTS
        rank = self.ranks[block].astype(np.int64)
        for k in range(RANK_SLOTS // 64 - 1):
            before = block * (RANK_SLOTS // 64) + k
            inside = before < word
            rank[inside] += np.bitwise_count(self.words[before[inside]])
        below = (np.uint64(1) << (bit & 63).astype(np.uint64)) - np.uint64(1)
        return rank + np.bitwise_count(self.words[word] & below)

    def pack(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], "<u4").tobytes() + self.ranks.tobytes() + self.words.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> PerfectHash:
        """The hash over the packed bytes as they are."""
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes = np.frombuffer(raw, "<u4", n, 4).astype(np.int64)
        blocks = int((-(-sizes // RANK_SLOTS)).sum())
        at = 4 + 4 * n
        return cls(sizes, np.frombuffer(raw, "<u8", blocks * (RANK_SLOTS // 64), at + 4 * blocks), np.frombuffer(raw, "<u4", blocks, at))


#: What the index holds for each place.
PLACE = np.dtype([("fingerprint", "<u4"), ("length", "<u4"), ("start", "<u8")])


class ShardIndex:
    """A shard's index: hash of a key to (start, length) in its payload, checked by fingerprint."""

    def __init__(self, levels: bytes, places: bytes):
        self.hash, self.places = PerfectHash.unpack(levels), np.frombuffer(places, PLACE) if len(places) else np.zeros(0, PLACE)

    @staticmethod
    def build(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
        found = PerfectHash.build(hashes)
        places = np.zeros(len(hashes), PLACE)
        at = found.place(hashes)
        for name, values in (("fingerprint", hashes >> np.uint64(32)), ("length", lengths), ("start", starts)):
            places[name][at] = values
        return found.pack(), places.tobytes()

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, start, length) for each hash."""
        if not len(self.places):
            none = np.zeros(len(hashes), np.int64)
            return none.astype(bool), none, none
        at = self.hash.place(hashes)
        row = self.places[np.maximum(at, 0)]
        return (at >= 0) & (row["fingerprint"] == (hashes >> np.uint64(32)).astype(np.uint32)), row["start"].astype(np.int64), row["length"].astype(np.int64)


def _ordinals(keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Each row's number among the neighbours with its key; the rows are sorted."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (valid[1:] != valid[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return np.arange(len(keys)) - first


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: int = 16, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``docs(doc_id, text)`` in ascending key order and write shards under ``path``."""
    dtype = f"<u{width // 8}"
    end = np.array([end_id], dtype).tobytes()
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), *[(n, pa.int64()) for n in ("first_key", "last_key", "n_docs", "start_in_part", "n_tokens")], *[(n, pa.binary()) for n in ("keys", "valid", "levels", "places", "payload")]])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, number, done = TaskContext.get().partitionId(), encoder(vocabulary, dtype).encode, itertools.count(), 0
        held: list[tuple[int | None, int]] = []
        payload: list[bytes] = []
        size = 0
        last: tuple[int | None, int] | None = None  # the last key and its rows so far, as a key's rows may fill shards

        def close() -> pa.RecordBatch:
            nonlocal held, payload, size, done
            keys = np.array([k or 0 for k, _ in held], "<i8")
            valid = np.array([k is not None for k, _ in held], bool)
            lengths = np.array([len(x) // (width // 8) for x in payload], np.int64)
            starts = np.cumsum(lengths) - lengths
            levels, places = ShardIndex.build(key_hashes(keys, valid, np.array([n for _, n in held])), starts, lengths)
            total, known = int(lengths.sum()), [k for k, _ in held if k is not None]
            row = [part, next(number), known[0] if known else None, known[-1] if known else None, len(held), done, total, keys.tobytes(), np.array([n if k is not None else -1 - n for k, n in held], "<i8").tobytes(), levels, places, b"".join(payload)]
            held, payload, size, done = [], [], 0, done + total
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in text_batches(batches):
            found, bounds = encode(batch.column("text"))
            raw, at = found.tobytes(), (bounds * (width // 8)).tolist()
            for key, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                last = (key, last[1] + 1) if last and last[0] == key else (key, 0)
                held.append(last)
                payload.append(raw[a:b] + end)
                size += b - a + len(end)
                if size >= shard_bytes:
                    yield close()
        if held:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, SHARD).write.option("compression", "none").parquet(path)


def _bases(shards: DataFrame) -> DataFrame:
    """(part, base): ids in all earlier parts. One row for each writing task, so it fits the driver."""
    rows = sorted((r.part, r.total) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("total")).collect())
    bases = np.cumsum([0, *[t for _, t in rows]])
    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("base", T.LongType())])
    return shards.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(rows, bases, strict=False)], kind)


def read_documents(spark: SparkSession, path: str, width: int = 16) -> DataFrame:
    """Every document of the store, fetched key by key through its shard's index.

    Returns doc_id, start (ids of all documents before it), n_tokens and ids (little-endian uint32).
    """
    shards = spark.read.schema(SHARD).parquet(path)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, number = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["valid"], "<i8")
                valid = number >= 0
                ordinal = np.where(valid, number, -1 - number)
                found, starts, lengths = ShardIndex(row["levels"], row["places"]).find(key_hashes(keys, valid, ordinal))
                if not found.all():
                    raise ValueError(f"the index of part {row['part']}, shard {row['shard']} misses a key")
                payload, base = np.frombuffer(row["payload"], f"<u{width // 8}"), row["base"] + row["start_in_part"]
                for i in range(0, len(keys), 2048):
                    ids = [payload[s : s + n].astype("<u4").tobytes() for s, n in zip(starts[i : i + 2048].tolist(), lengths[i : i + 2048].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2048], pa.int64(), mask=~valid[i : i + 2048]), pa.array(starts[i : i + 2048] + base), pa.array(lengths[i : i + 2048]), pa.array(ids, pa.binary())], schema=schema)

    joined = shards.join(F.broadcast(_bases(shards)), "part").select("part", "shard", "base", "start_in_part", "keys", "valid", "levels", "places", "payload")
    return joined.mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids binary")


def lookup(store: DataFrame, wanted: DataFrame, width: int = 16) -> DataFrame:
    """(doc_id, ids) for each wanted key that the store holds; its first row where the key repeats.

    ``store`` is the shard table, ``wanted`` has doc_id. Key ranges are cut into steps of the shards'
    mean span, so a shard lies in two steps on average and keys find their shards by an equi-join. Shards
    and the keys asked of them meet once in one group each, so a shard's payload is handed over once; a key
    takes one probe of the index and one slice of the payload. More than ``BLOCK_KEYS`` keys of a shard are
    asked in several rows of that group.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    itemsize = width // 8

    def probe(key: tuple, shards: pa.Table, asked: pa.Table) -> pa.Table:
        if not (shards.num_rows and asked.num_rows):
            return schema.empty_table()
        index = ShardIndex(shards.column("levels")[0].as_buffer(), shards.column("places")[0].as_buffer())
        payload = shards.column("payload")[0].as_buffer()
        keys = np.concatenate([np.array(w, np.int64) for w in asked.column("wanted").to_pylist()])
        found, starts, lengths = index.find(key_hashes(keys, np.ones(len(keys), bool), np.zeros(len(keys), np.int64)))
        ids = [np.frombuffer(payload, f"<u{itemsize}", n, s * itemsize).astype("<u4").tobytes() for s, n in zip(starts[found].tolist(), lengths[found].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(keys[found]), pa.array(ids, pa.binary())], schema=schema)

    bounds = store.where("first_key is not null").select("part", "shard", "first_key", "last_key")
    step = max(1, int(bounds.agg(F.avg(F.col("last_key") - F.col("first_key") + 1)).first()[0] or 1))
    on = lambda c: F.floor(F.col(c) / step).cast("long")
    spread = bounds.withColumn("step", F.explode(F.sequence(on("first_key"), on("last_key"))))
    keys = wanted.select(F.col("doc_id").cast("long").alias("key")).where("key is not null").distinct().withColumn("step", on("key"))
    routed = keys.join(spread, "step").where(F.col("key").between(F.col("first_key"), F.col("last_key")))
    asked = routed.withColumn("block", F.floor(F.col("key") / BLOCK_KEYS)).groupBy("part", "shard", "block").agg(F.collect_list("key").alias("wanted"))
    # both sides of the groups come from the store: new names tell their columns apart
    asked = asked.select(F.col("part").alias("of_part"), F.col("shard").alias("of_shard"), "wanted")
    visited = store.join(asked, (store["part"] == F.col("of_part")) & (store["shard"] == F.col("of_shard")), "left_semi").select("part", "shard", "levels", "places", "payload")
    return visited.groupBy("part", "shard").cogroup(asked.groupBy("of_part", "of_shard")).applyInArrow(probe, "doc_id long, ids binary")


def crc32(data: bytes) -> int:
    """The unsigned crc32, as in the digest columns."""
    return zlib.crc32(data)
