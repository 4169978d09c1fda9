import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import idstore, packing
from tessera.llm.common import Scratch, mix64
from tessera.llm.tokens import ChunkEncoder

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = [
    "", " ", "a b", "a  b", "a\n b", " a", "a ", "\n \n x", "x \ny  z", "it's 'tis a<|endoftext|> b", "a <|startoftext|>", "é́ x", "12 34, 5.6  \t a",
    "a  　b \x1c c", "Σας ΣΑΣ", None, "é è", "  x   y ", "\n  bar foo\n \tbar", "don't. 'll we'll.", "a.b,c|d ||x $$$ x$$$", "…. x…. y", "\n 　x",
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_ids_of_whole_texts(path):
    rnd = random.Random(5)
    signs = [" ", " ", "\n", "\t", " ", "　", "a", "B", "é", ".", "'", "s", "|", "1", "…", "́", "<", "e"]
    texts = ODD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    encoder, whole = ChunkEncoder(path, "<u4"), Tokenizer.from_file(path)
    for _ in range(2):  # the second time all chunks are known
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_forgetting_does_not_change_ids(monkeypatch):
    monkeypatch.setattr("tessera.llm.tokens.MOST_CHUNKS", 20)
    encoder, whole = ChunkEncoder(BYTE, "<u2"), Tokenizer.from_file(BYTE)
    for k in range(20):
        text = " ".join(f"word{k * 7 + j} and" for j in range(9))
        assert encoder.encode(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_perfect_hash_is_minimal_and_survives_packing(n):
    hashes = mix64(np.arange(n, dtype=np.uint64))
    found = idstore.PerfectHash.unpack(idstore.PerfectHash.build(hashes).pack())
    assert sorted(found.place(hashes).tolist()) == list(range(n))


def test_unknown_keys_fail_the_fingerprint():
    hashes = mix64(np.arange(500, dtype=np.uint64))
    index = idstore.ShardIndex(*idstore.ShardIndex.build(hashes, np.arange(500), np.ones(500, np.int64)))
    assert index.find(hashes)[0].all() and not index.find(mix64(np.arange(10_000, 10_400, dtype=np.uint64)))[0].any()


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def expected(rows, path):
    whole, out, start = Tokenizer.from_file(path), [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, ids))
        start += len(ids)
    return out


def test_store_returns_every_document(spark):
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD)] + [(7, "again"), (7, "again"), (7, None), (None, "no key"), (500, "long words " * 4000)]
    path = Scratch(spark, "test").path("store")
    idstore.write_store(documents(spark, rows).repartition(3), path, BYTE, 2, shard_bytes=40_000)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in idstore.read_documents(spark, path).orderBy("start").collect()]
    assert got == expected(rows, BYTE)
    wanted = spark.createDataFrame([(500,), (3,), (12345,), (None,)], "doc_id long")
    one = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in idstore.lookup(spark.read.parquet(path), wanted).collect()}
    assert one == {k: ids for k, _, ids in expected(rows, BYTE) if k in (500, 3)}


def test_store_of_nothing(spark):
    path = Scratch(spark, "test").path("empty")
    idstore.write_store(documents(spark, []), path, BYTE, 2)
    assert idstore.read_documents(spark, path).count() == 0


def test_best_fit_takes_the_tightest_window():
    sequence, offset, n = packing.best_fit(np.array([6, 5, 4, 3, 2, 10]), 10)
    assert n == 3 and sequence.tolist() == [1, 2, 1, 2, 2, 0] and offset.tolist() == [0, 0, 6, 5, 8, 0]


def test_best_fit_equals_a_plain_search():
    lengths = np.random.default_rng(1).integers(1, 65, 400)
    sequence, offset, n = packing.best_fit(lengths, 64)
    room: list[int] = []
    for length in sorted(lengths.tolist(), reverse=True):
        fits = [r for r in room if r >= length]
        if fits:
            room[room.index(min(fits))] -= length
        else:
            room.append(64 - length)
    used = np.zeros(n, int)
    for s, length in zip(sequence, lengths, strict=True):
        used[s] += length
    assert sorted(64 - used) == sorted(room)
    assert offset.min() == 0


def test_pieces_cover_all_ids_without_gaps(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "x"), (99, "many words " * 9000)]
    pieces = packing.pack(documents(spark, rows).coalesce(1), WORD, 2, block_ids=3000).collect()
    assert all(r.length == len(r.ids) // 4 <= 4096 for r in pieces)
    by_sequence: dict = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    long = sorted((r.start, r.ids) for r in pieces if r.doc_id == 99)
    ids = b"".join(x for _, x in long)
    assert np.frombuffer(ids, "<u4").tolist() == [ids for k, _, ids in expected(rows, WORD) if k == 99][0]
    assert {r.doc_tokens for r in pieces if r.doc_id == 99} == {len(ids) // 4}
    assert sum(r.length for r in pieces) == sum(len(ids) for _, _, ids in expected(rows, WORD))
    assert packing.pack(documents(spark, []), WORD, 2).count() == 0


def test_little_padding(spark):
    from tests.conftest import SF

    pieces = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), WORD, 2).toPandas()
    assert 1 - pieces.length.sum() / (4096 * pieces.sequence_id.nunique()) < 0.02


def test_digest_is_crc32():
    assert idstore.crc32(b"abc") == zlib.crc32(b"abc")
