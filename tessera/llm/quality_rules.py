"""Quality rules: counted base rules, then a calibrated n-gram classifier for what passes them.

The classifier is a logistic regression over hashed word 1- and 2-grams and character (UTF-8 byte) 3-
and 4-grams, each family as relative frequencies. It is trained on a bounded sample of labelled rows
that pass the base rules, and its scores are turned into probabilities on a part of the sample that
training does not see (Platt scaling). Rows are scored in Arrow batches.

Defined cases: a null or empty text has no words and fails the base rules; where the sample lacks a
label, every row that passes the base rules is kept; rows that repeat a key are judged each for itself;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64
from tessera.llm.labelled import labelled_sample
from tessera.llm.words import Texts, sums_by_document, text_batches

#: Fixed thresholds of the base rules and of the verdict.
MIN_WORDS, MAX_REPEATED_PERCENT, MIN_PROBABILITY = 50, 50, 0.5
#: At most this many different labelled texts of each label are trained on.
PER_CLASS = 500
#: Hash buckets of each feature family, and the factor on their relative frequencies.
BUCKETS, SCALE = 1 << 17, 30.0
FAMILIES = 4

BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"

_WHITE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


@dataclass
class Model:
    """Weights by bucket, all families in one array; ``kept_all`` where nothing could be trained."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    kept_all: bool = False


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The base rules' counts for each document of a batch."""
    raw, n = texts.data.tobytes(), len(texts)
    chars, symbols, dup_lines = (np.zeros(n, np.int64) for _ in range(3))
    bounds = texts.begins.tolist()
    for i in range(n):
        text = raw[bounds[i] : bounds[i + 1]]
        words = text.translate(None, _WHITE)
        chars[i] = len(words.decode("utf-8", "replace"))
        symbols[i] = len(text) - len(text.translate(None, _SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines[i] = len(lines) - len(set(lines))
    return {"n_words": texts.n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated_words(texts)}


def repeated_words(texts: Texts, k: int = 3) -> np.ndarray:
    """Words in k-word windows that occur more than once in their document."""
    hashes, at = texts.windows(k)
    doc = texts.doc_of_words()[at]
    order = np.argsort(keys := mix64(hashes ^ mix64(doc.astype(np.uint64), 9), 9), kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(texts.hashes) + k, np.int64)
    starts = at[order[again]]
    covered[starts] += 1
    np.add.at(covered, starts + k, -1)
    return sums_by_document((np.cumsum(covered)[: len(texts.hashes)] > 0).astype(np.float64), texts.first).astype(np.int64)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * counts["n_words"])


def families(texts: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(feature family, bucket of each n-gram, its document), a family in one or more parts."""
    for f, k in enumerate((1, 2)):
        hashes, at = texts.windows(k)
        yield f, (hashes >> np.uint64(47)).astype(np.int64), np.searchsorted(texts.first, at, side="right") - 1
    for f, k in enumerate((3, 4), 2):
        for hashes, doc in texts.byte_windows(k):
            yield f, (hashes >> np.uint32(15)).astype(np.int64), doc


def margins(texts: Texts, model: Model) -> np.ndarray:
    """The linear score of each document."""
    n = len(texts)
    sums, grams = np.zeros((FAMILIES, n)), np.zeros((FAMILIES, n))
    for f, bucket, doc in families(texts):
        sums[f] += np.bincount(doc, model.weights[bucket + f * BUCKETS], n)
        grams[f] += np.bincount(doc, minlength=n)
    return model.bias + (SCALE * sums / np.maximum(grams, 1)).sum(0)


def frequencies(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets of all families, scaled frequencies) of each document."""
    n = len(texts)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(FAMILIES)]
    for f, bucket, doc in families(texts):
        found[f].append(np.unique(doc * BUCKETS + bucket, return_counts=True))
    columns = []
    for f, parts in enumerate(found):
        slot, of = np.unique(np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.int64), return_inverse=True)
        count = np.bincount(of, np.concatenate([c for _, c in parts]) if parts else None, len(slot))
        total = np.bincount(slot // BUCKETS, count, n)
        columns.append((slot % BUCKETS + f * BUCKETS, count * SCALE / np.maximum(total, 1)[slot // BUCKETS], np.searchsorted(slot, np.arange(n + 1) * BUCKETS)))
    for i in range(n):
        yield tuple(np.concatenate([c[k][c[2][i] : c[2][i + 1]] for c in columns]) for k in (0, 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, buckets, frequencies) of rows that pass the base rules."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("buckets", pa.binary()), ("frequencies", pa.binary())])
    for batch in text_batches(batches):
        texts = Texts(batch.column("text"))
        failed = base_failed(base_counts(texts)).tolist()
        rows = [
            {"doc_id": key, "label": label, "buckets": bucket.astype(np.int32).tobytes(), "frequencies": value.astype(np.float32).tobytes()}
            for key, label, bad, (bucket, value) in zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), failed, frequencies(texts), strict=True)
            if not bad
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def passing_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the rows that pass the base rules."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = Texts(batch.column("text"))
            passed = texts.n_words >= MIN_WORDS
            passed &= 100 * repeated_words(texts) <= MAX_REPEATED_PERCENT * texts.n_words
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash")], schema=schema).filter(pa.array(passed))

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judged, "doc_id long, text_hash long")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = 120) -> Model:
    """Train on the bounded sample of rows that pass the base rules; the driver holds its features only."""
    sample = labelled_sample(docs, labels, per_class, known_texts=passing_texts(docs)).mapInArrow(_features, "doc_id long, label int, buckets binary, frequencies binary")
    rows = sorted(sample.collect(), key=lambda r: r.doc_id)
    y = np.array([r.label for r in rows], np.float64)
    weights = np.zeros(FAMILIES * BUCKETS, np.float32)
    held = np.arange(len(y)) % 4 == 3  # for calibration
    if min((y[~held] == 0).sum(), (y[~held] == 1).sum(), (y[held] == 0).sum(), (y[held] == 1).sum()) < 2:
        return Model(weights, 0.0, 1.0, 0.0, kept_all=True)
    bucket = np.concatenate([np.frombuffer(r.buckets, np.int32) for r in rows])
    value = np.concatenate([np.frombuffer(r.frequencies, np.float32) for r in rows])
    sizes = np.array([len(r.buckets) // 4 for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    del rows[:]  # the driver holds one copy
    used, bucket = np.unique(bucket, return_inverse=True)
    bucket = bucket.astype(np.int32)
    train = ~held[row]
    tb, tv, tr = bucket[train], value[train], row[train]
    balance = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):  # Adam over the whole training part
        z = np.bincount(tr, w[tb] * tv, len(y)) + b
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(tb, error[tr] * tv, len(used)) + 1e-6 * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weights[used] = w
    z = np.bincount(row, w[bucket] * value, len(y)) + b
    slope, shift = _platt(z[held], y[held])
    return Model(weights, float(b), slope, shift)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits the held-out labels, with smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-6, float(z.std()))
    u, ab = (z - z.mean()) / scale, np.array([1.0, 0.0])

    def loss(ab: np.ndarray) -> float:
        v = ab[0] * u + ab[1]
        return float((np.logaddexp(0, v) - target * v).sum() + 0.005 * (ab**2).sum())

    for _ in range(100):  # Newton steps, halved until the loss falls
        p = 1 / (1 + np.exp(-np.clip(ab[0] * u + ab[1], -30, 30)))
        r, d = p - target, np.maximum(p * (1 - p), 1e-9)
        slope = np.array([(r * u).sum(), r.sum()]) + 0.01 * ab
        step = np.linalg.solve(np.array([[(d * u * u).sum(), (d * u).sum()], [(d * u).sum(), d.sum()]]) + 0.01 * np.eye(2), slope)
        now, size = loss(ab), 1.0
        while size > 1e-6 and loss(ab - size * step) > now:
            size /= 2
        if size <= 1e-6 or np.abs(step).sum() < 1e-9:
            break
        ab = ab - size * step
    return float(ab[0] / scale), float(ab[1] - ab[0] * z.mean() / scale)


def apply_rules(docs: DataFrame, model: Model, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Counts, probability and verdict for each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in names], ("base_failed", pa.bool_()), ("probability", pa.float64()), ("kept", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in text_batches(batches):
            texts = Texts(batch.column("text"))
            counts = base_counts(texts)
            failed = base_failed(counts)
            p = 1 / (1 + np.exp(-np.clip(known.slope * margins(texts, known) + known.shift, -500, 500)))
            kept = ~failed & ((p >= min_probability) | known.kept_all)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(counts[n], pa.int64()) for n in names], pa.array(failed), pa.array(p), pa.array(kept)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, BASE)


def keep_passing(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in text_batches(batches):
            texts = Texts(batch.column("text"))
            passed = ~base_failed(base_counts(texts))
            if not known.kept_all:
                p = 1 / (1 + np.exp(-np.clip(known.slope * margins(texts, known) + known.shift, -500, 500)))
                passed &= p >= MIN_PROBABILITY
            yield batch.filter(pa.array(passed))

    return docs.mapInArrow(keep, docs.schema)
