"""Quality score by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed words, words' shapes (with a mark for a word that equals the one before it) and
character (UTF-8 byte) 3-grams. A bounded sample of labelled texts gives term weights (idf) and a
truncated singular value decomposition; their latent vectors and labels are broadcast (their number is
a parameter). Every document's vector meets all of them in blocks of exact cosine products, and the
nearest ones vote with their similarity.

Defined cases: a null or empty text scores 0 (nothing speaks for it); where the sample is empty or has
one label only, every text with a word scores that label's share (0.5 if there is none); rows that
repeat a key are scored each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64
from tessera.llm.labelled import labelled_sample
from tessera.llm.words import Texts, text_batches

#: At most this many different labelled texts of each label are fitted on and vote.
PER_CLASS = 1000
#: Latent dimensions, neighbours that vote, and the power of a similarity in its vote.
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 15, 4
#: Hash buckets of the three term families.
WORDS, SHAPES, TRIGRAMS = 2048, 1024, 4096
TERMS = WORDS + SHAPES + TRIGRAMS
#: Documents whose term counts are held at once.
BLOCK = 256

# A byte's class in a word's shape: lower letters and bytes beyond ASCII, capitals, digits, each mark for itself.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


@dataclass
class Model:
    """idf and right singular vectors, and the voters' unit vectors and labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float


#: Words whose shapes are taken at once.
SHAPE_WORDS = 200_000


def _shapes(texts: Texts) -> np.ndarray:
    """A hash of each word's shape: which classes it has, its first and last class, and whether it repeats."""
    n = len(texts.hashes)
    present = np.zeros(n, np.uint64)
    for i in range(0, n, SHAPE_WORDS):
        starts, ends = texts.starts[i : i + SHAPE_WORDS], texts.ends[i : i + SHAPE_WORDS]
        bits = np.uint64(1) << (_CLASS[texts.data[starts[0] : ends[-1]]] % np.uint64(64))
        present[i : i + SHAPE_WORDS] = np.bitwise_or.reduceat(np.append(bits, np.uint64(0)), (np.stack([starts, ends], 1) - starts[0]).ravel())[::2]
    repeats = np.zeros(n, np.uint64)
    repeats[1:] = texts.hashes[1:] == texts.hashes[:-1]
    repeats[texts.first[:-1][texts.first[:-1] < n]] = 0
    first, last = _CLASS[texts.data[texts.starts]], _CLASS[texts.data[texts.ends - 1]]
    return mix64(present ^ mix64(first * np.uint64(512) + last * np.uint64(2) + repeats, 21), 22)


def term_counts(texts: Texts, start: int, stop: int) -> np.ndarray:
    """Counts of the terms of documents start..stop, a row for each."""
    n, out = stop - start, np.zeros((stop - start, TERMS), np.float32)
    words = slice(texts.first[start], texts.first[stop])
    doc = np.repeat(np.arange(n), texts.n_words[start:stop])
    at = 0
    for hashes, size in ((texts.hashes[words], WORDS), (_shapes_of(texts)[words], SHAPES)):
        bucket = (hashes % np.uint64(size)).astype(np.int64)
        out[:, at : at + size] = np.bincount(doc * size + bucket, minlength=n * size).reshape(n, size)
        at += size
    for hashes, of in texts.byte_windows(3, start, stop):
        out[:, at:] += np.bincount((of - start) * TRIGRAMS + hashes % np.uint32(TRIGRAMS), minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    return out


def _shapes_of(texts: Texts) -> np.ndarray:
    if not hasattr(texts, "shapes"):
        texts.shapes = _shapes(texts)
    return texts.shapes


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log counts times idf, each family brought to equal length first."""
    x = np.log1p(counts) * idf
    at = 0
    for size in (WORDS, SHAPES, TRIGRAMS):
        part = x[:, at : at + size]
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        at += size
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("counts", pa.binary())])
    for batch in text_batches(batches):
        texts = Texts(batch.column("text"))
        for i in range(0, len(texts), BLOCK):
            counts = term_counts(texts, i, min(i + BLOCK, len(texts))).astype(np.uint32)
            part = batch.slice(i, len(counts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([x.tobytes() for x in counts], pa.binary())], schema=schema)


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, per_class: int = PER_CLASS, seed: int = 3) -> Model:
    """Fit on the bounded sample of labelled texts (``where``: a condition on the label rows' doc_id)."""
    rows = sorted(labelled_sample(docs, labels, per_class, where).mapInArrow(_sample_counts, "doc_id long, label int, counts binary").collect(), key=lambda r: r.doc_id)
    y = np.array([r.label for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        nothing = np.zeros((0, DIMENSIONS), np.float32)
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, DIMENSIONS), np.float32), nothing, y[:0], float(y.mean()) if len(y) else 0.5)
    counts = np.stack([np.frombuffer(r.counts, np.uint32) for r in rows]).astype(np.float32)
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
    x = weighted(counts, idf)
    rng = np.random.default_rng(seed)  # randomized range finder with power steps
    q = np.linalg.qr(x @ rng.standard_normal((TERMS, DIMENSIONS + 12), dtype=np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:DIMENSIONS].T.astype(np.float32)
    return Model(idf, np.ascontiguousarray(axes), _unit(x @ axes), y, float(y.mean()))


def vote(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Similarity-weighted share of label 1 among each vector's nearest labelled vectors."""
    similarity = vectors @ model.vectors.T
    k = min(NEIGHBOURS, len(model.labels))
    near = np.argpartition(-similarity, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(similarity, near, 1), 1e-6).astype(np.float64) ** SHARPNESS
    return (weight * model.labels[near]).sum(1) / weight.sum(1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs(doc_id, text)``; 1 is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in text_batches(batches):
            texts = Texts(batch.column("text"))
            out = np.full(len(texts), known.share)
            if len(known.labels):
                for i in range(0, len(texts), BLOCK):
                    j = min(i + BLOCK, len(texts))
                    out[i:j] = vote(_unit(weighted(term_counts(texts, i, j), known.idf) @ known.axes), known)
            out[texts.n_words == 0] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")


