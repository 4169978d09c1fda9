"""The registered queries that SQL cannot express, over whole small tables, against plain Python."""

import hashlib
import json
import math
import re
import struct
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import quality_knn, registry
from tessera.llm.words import Texts
from tests.conftest import SF
from tests.llm.test_texts import PATTERNS, WORD, base_brute


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def encoded(documents, name):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return {d: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for d, t in zip(documents.doc_id, documents.text, strict=True)}


def test_token_store_equals_whole_text_encoding(spark, documents):
    got = registry.queries()["op2_token_store"](spark, SF).collect()
    start, want = 0, []
    for doc_id, ids in encoded(documents, "byte_bpe_50k.json").items():
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_packing_holds_every_id_once_without_gaps(spark, documents):
    got = registry.queries()["op5_packing"](spark, SF).toPandas()
    ids = encoded(documents, "word_bpe_49k.json")
    for doc_id, pieces in got.sort_values("start").groupby("doc_id"):
        at = 0
        for r in pieces.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc_id]) and r.ids_crc32 == crc(ids[doc_id][at : at + r.length])
            at += r.length
        assert at == len(ids[doc_id])
    assert set(got.doc_id) == set(ids)
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert pieces.offset.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]] and pieces.length.sum() <= 4096


def features(text, model):
    """A text's latent unit vector, term by term."""
    counts: dict[int, int] = {}
    words = WORD.findall(text)
    for i, word in enumerate(words):
        own = Texts(pa.array([word]))
        shape = quality_knn._shapes(Texts(pa.array([f"{words[i - 1]} {word}" if i else word])))[-1]
        data = word.encode()
        assert len(own.hashes) == 1 and data
        for slot in (int(own.hashes[0]) % quality_knn.WORDS, quality_knn.WORDS + int(shape) % quality_knn.SHAPES):
            counts[slot] = counts.get(slot, 0) + 1
    raw = text.encode()
    for i in range(len(raw) - 2):
        slot = quality_knn.WORDS + quality_knn.SHAPES + trigram(raw[i : i + 3])
        counts[slot] = counts.get(slot, 0) + 1
    bounds = [0, quality_knn.WORDS, quality_knn.WORDS + quality_knn.SHAPES, quality_knn.TERMS]
    x = {}
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = {t: math.log1p(n) * float(model.idf[t]) for t, n in counts.items() if low <= t < high}
        norm = math.sqrt(sum(v * v for v in part.values())) or 1.0
        x |= {t: v / norm for t, v in part.items()}
    latent = [sum(v * float(model.axes[t, d]) for t, v in x.items()) for d in range(model.axes.shape[1])]
    norm = math.sqrt(sum(v * v for v in latent)) or 1.0
    return [v / norm for v in latent]


def trigram(gram):
    """Bucket of three bytes by the hash of ``byte_windows``."""
    from tessera.llm.words import BYTE_VALUES

    out = 0
    for b in gram:
        out = (out * 0x01000193 + (int(BYTE_VALUES[b]) & 0xFFFFFFFF)) & 0xFFFFFFFF
    out ^= out >> 15
    out = out * 0x2C1B3C6D & 0xFFFFFFFF
    return (out ^ (out >> 12)) % quality_knn.TRIGRAMS


def test_quality_scores_equal_votes_counted_one_by_one(spark, documents):
    got = {r.doc_id: r for r in registry.queries()["op6_quality_knn"](spark, SF).collect()}
    assert set(got) == set(documents.doc_id)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_knn.fit(docs, labels, where=~registry.held_out())
    quality = dict(zip(*pd.read_parquet(f"{SF}/labels.parquet", columns=["doc_id", "quality"]).to_numpy().T.tolist(), strict=True))
    right = total = 0
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and doc_id in quality:
            total, right = total + 1, right + (r.predicted == quality[doc_id])
        if text is None or not WORD.search(text):
            assert r.score == 0
        elif doc_id % 8 == 0 and len(text) < 6000:
            own = features(text, model)
            similar = [sum(a * float(b) for a, b in zip(own, v, strict=True)) for v in model.vectors]
            near = sorted(range(len(similar)), key=lambda i: -similar[i])[: quality_knn.NEIGHBOURS]
            weight = [max(similar[i], 1e-6) ** quality_knn.SHARPNESS for i in near]
            assert r.score == pytest.approx(sum(w * float(model.labels[i]) for w, i in zip(weight, near, strict=True)) / sum(weight), abs=2e-3)
    assert right >= 0.9 * total


def test_quality_rules_count_as_the_contract_says(spark, documents):
    got = {r.doc_id: r for r in registry.queries()["op7_quality_rules"](spark, SF).collect()}
    assert set(got) == set(documents.doc_id)
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        text = text or ""
        words = WORD.findall(text)
        seen: set[str] = set()
        dup_lines = 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup_lines += line in seen
                seen.add(line)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts: dict[tuple, int] = {}
        for w in windows:
            counts[w] = counts.get(w, 0) + 1
        covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        r = got[doc_id]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup_lines, len(covered), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_personal_data_has_the_base_spans_of_the_contract(spark, documents):
    got = {r.doc_id: r for r in registry.queries()["op10_pii"](spark, SF).collect()}
    assert set(got) == set(documents.doc_id)
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        base = [f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in base_brute(text or "")]
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.split(":")[0] == n for b in base) for n, _ in PATTERNS)
        spans = [s for s in r.spans.split(",") if s]
        assert set(base) <= set(spans)
        starts = [(int(s.split(":")[1]), [n for n, _ in PATTERNS].index(s.split(":")[0])) for s in spans]
        assert starts == sorted(starts) and all(int(s.split(":")[2]) <= len(text or "") for s in spans)


def test_passages_cover_every_exact_run_of_fifty_words(spark, documents):
    got: dict[int, list] = {}
    for r in registry.queries()["op1_passage_chains"](spark, SF).collect():
        assert r.with_doc_id != r.doc_id and r.end_word - r.start_word >= 50
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    words = {d: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in zip(documents.doc_id, documents.text, strict=True)}
    where: dict[tuple, list] = {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i : i + 50]), []).append((d, i))
    missed = [(d, i) for places in where.values() if len({d for d, _ in places}) > 1 for d, i in places if not any(s <= i and i + 50 <= e for s, e in got.get(d, []))]
    assert not missed


def test_digests_are_json_safe_integers(spark):
    row = registry.queries()["op2_token_store"](spark, SF).first()
    assert json.loads(json.dumps(row.asDict())) == row.asDict() and 0 <= row.ids_crc32 < 2**32 and np.iinfo(np.int64).max > row.start
