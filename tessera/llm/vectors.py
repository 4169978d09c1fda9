"""Nearest neighbours by randomly rotated one-bit codes with error bounds and exact reranking.

A vector, less the mean, is rotated by a random orthogonal matrix and kept as the signs of its
components in 64-bit words, its length, and the inner product of its direction with its code. A query is
rotated too and kept as four bit planes of its components. Bits that code and planes share are counted
word by word; from these counts and the scalars the inner product is estimated without bias, with an error
that shrinks with the dimension. A vector whose lower bound of the distance beats the k-th distance found so
far is compared exactly, all others are skipped. Queries go to the indexed rows in blocks of bounded size.

Defined cases: vectors that are null, empty, zero, of another length than the most frequent one, or
hold null or non-finite components take no part, nor do rows without an id; a query is not compared
with rows of its own id; an id that repeats among queries asks once, with its least vector; repeated
candidate rows count each; vectors of doubles are compared in doubles, all others as floats; ties go to the smaller id; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch

#: Width of the error bound in standard deviations of the estimate.
EPSILON = 3.0
#: Bytes of query vectors that are sent to the workers at once; more are asked in further rounds.
QUERY_BYTES = 32 << 20
#: Rows whose distances give the queries their first limits, whatever the table's size.
SAMPLE_ROWS = 1000
#: Rows and queries that meet in one estimate.
ROW_BLOCK, QUERY_BLOCK = 4096, 64
#: Share of chosen pairs from which a block's single-precision products are taken at once.
DENSE = 0.05
#: Bit planes of a query's components.
PLANES = 4

FOUND = "query_id long, vec_id long, score double"


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    kind = vectors.schema["embedding"].dataType.elementType
    kind = "float" if isinstance(kind, T.FloatType) else "double"
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    rows = rows.where("vec_id is not null and size(vector) > 0").where(sound)
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    return rows.where(F.size("vector") == (common.n if common else 0))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 0), np.float32)


def mean_vector(rows: DataFrame) -> np.ndarray:
    """The mean of all vectors; each task sends one sum."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch.column("vector"), batch.num_rows).astype(np.float64).sum(0)
                total, n = part if total is None else total + part, n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"total": [total.tolist()], "n": [n]})

    parts = rows.mapInArrow(sums, "total array<double>, n long").collect()
    return np.sum([p.total for p in parts], axis=0) / sum(p.n for p in parts) if parts else np.zeros(0)


class Rotation:
    """The mean and a random orthogonal matrix, the same for every run."""

    def __init__(self, mean: np.ndarray, seed: int = 11):
        self.mean, d = mean, len(mean)
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
        self.matrix = q * np.sign(np.diag(r))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors.astype(np.float64) - self.mean) @ self.matrix


def bit_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, filled up with zeros."""
    padded = np.pad(bits, [*[(0, 0)] * (bits.ndim - 1), (0, -bits.shape[-1] % 64)])
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


class QueryPlanes:
    """Rotated queries with ``PLANES`` bits a component: component = low + step * integer, in planes."""

    def __init__(self, turned: np.ndarray):
        self.low = turned.min(1, initial=0.0)
        self.step = (turned.max(1, initial=0.0) - self.low) / ((1 << PLANES) - 1)
        whole = np.rint((turned - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None]).astype(np.uint8)
        self.planes = np.stack([bit_words((whole >> j) & 1 == 1) for j in range(PLANES)])
        self.total = (self.low * turned.shape[1] + self.step * whole.sum(1)).astype(np.float32)
        self.low, self.step = self.low.astype(np.float32), self.step.astype(np.float32)

    def products(self, q: slice, codes: np.ndarray) -> np.ndarray:
        """Inner products of the queries with the signs that the codes stand for (bit 1 is +1, bit 0 is -1)."""
        shared = np.zeros((len(self.low[q]), len(codes)), np.float32)
        for j in range(PLANES):
            for w in range(codes.shape[1]):
                shared += np.bitwise_count(self.planes[j, q, w][:, None] & codes[:, w]) * np.float32(1 << j)
        ones = np.bitwise_count(codes).sum(1, dtype=np.float32)
        return 2 * (self.low[q, None] * ones + self.step[q, None] * shared) - self.total[q, None]


def encode(rows: DataFrame, rotation: Rotation) -> DataFrame:
    """The index: code bits and scalars of every row beside its original vector."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = rotation(_matrix(batch.column("vector"), batch.num_rows))
            length = np.linalg.norm(turned, axis=1)
            alignment = np.abs(turned).sum(1) / np.sqrt(turned.shape[1]) / np.where(length > 0, length, 1)
            codes = bit_words(turned > 0)
            columns = [batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(np.where(length > 0, alignment, 1.0)), batch.column("vector")]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "code", "length", "alignment", "vector"])

    vector = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(coded, f"vec_id long, code binary, length double, alignment double, vector {vector}")


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed in order of the components in double precision."""
    total = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        d = x.astype(np.float64) - y
        total += d * d
    return np.sqrt(total)


class Nearest:
    """The k best (distance, id) of each query so far; ``limit`` bounds each query's k-th distance from above."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: Rotation, k: int, limit: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        turned = rotation(vectors)
        self.planes, self.square = QueryPlanes(turned), (turned**2).sum(1).astype(np.float32)
        self.distance = np.full((len(ids), k), np.inf)
        self.best = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.limit = np.full(len(ids), np.inf) if limit is None else limit
        self.norm = np.einsum("ij,ij->i", vectors, vectors)

    def meet(self, ids: np.ndarray, codes: np.ndarray, length: np.ndarray, alignment: np.ndarray, vectors: np.ndarray) -> None:
        d = vectors.shape[1]
        scale = (2 / np.sqrt(d) * length / alignment).astype(np.float32)
        square, norm = (length**2).astype(np.float32), np.einsum("ij,ij->i", vectors, vectors)
        spread = (2 * EPSILON * length * np.sqrt(np.maximum(0, 1 / alignment**2 - 1) / max(1, d - 1))).astype(np.float32)
        rounding = scale * np.float32(EPSILON * np.sqrt(d / 12))  # for each unit of a query's step
        for start in range(0, len(self.ids), QUERY_BLOCK):
            q = slice(start, start + QUERY_BLOCK)
            middle = square - scale * self.planes.products(q, codes) + self.square[q, None]
            own = self.ids[q, None] == ids
            middle[own] = np.inf
            if len(ids) > self.k:  # the nearest by estimate first: they tighten the limits
                near = np.argpartition(middle, self.k - 1, axis=1)[:, : self.k]
                which = np.repeat(np.arange(len(near)), self.k)
                self._compare(which, near.ravel(), start, ids, vectors, own)
                middle[which, near.ravel()] = np.inf
            limit = np.minimum(self.limit[q], self.distance[q, -1])
            bar = (limit**2 * (1 + 1e-5) + 1e-9).astype(np.float32)
            which, row = np.nonzero(~(middle - np.sqrt(self.square[q])[:, None] * spread - self.planes.step[q, None] * rounding > bar[:, None]))
            # Single precision, with room for its rounding, leaves few pairs for the exact distance.
            if len(which) > DENSE * middle.size:
                product = (self.vectors[q] @ vectors.T)[which, row]
            else:
                product = np.einsum("ij,ij->i", self.vectors[q][which], vectors[row])
            size = self.norm[q][which] + norm[row]
            close = ~(size - 2 * product > bar[which] + 1e-5 * size)  # also what overflowed
            self._compare(which[close], row[close], start, ids, vectors, own)

    def _compare(self, which: np.ndarray, row: np.ndarray, start: int, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> None:
        other = ~own[which, row]
        which, row = which[other], row[other]
        if len(which):
            self._merge(which + start, ids[row], exact_distances(self.vectors[which + start], vectors[row]))

    def _merge(self, which: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        old = np.unique(which)
        all_q = np.concatenate([which, np.repeat(old, self.k)])
        all_d = np.concatenate([distance, self.distance[old].ravel()])
        all_i = np.concatenate([ids, self.best[old].ravel()])
        order = np.lexsort((all_i, all_d, all_q))
        first = np.searchsorted(all_q[order], old)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.distance[old], self.best[old] = all_d[take].reshape(-1, self.k), all_i[take].reshape(-1, self.k)


def first_limits(ids: np.ndarray, vectors: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th distance within a sample of the rows, an upper bound of its k-th distance overall."""
    out = np.full(len(ids), np.inf)
    if len(sample) < k:
        return out
    sample = sample.astype(np.float64)
    norm = np.einsum("ij,ij->i", sample, sample)
    for start in range(0, len(ids), QUERY_BLOCK):
        q = slice(start, start + QUERY_BLOCK)
        some = vectors[q].astype(np.float64)
        size = np.einsum("ij,ij->i", some, some)[:, None] + norm
        square = size - 2 * (some @ sample.T) + 1e-9 * size  # with room for its rounding
        square[ids[q, None] == sample_ids] = np.inf
        out[q] = np.sqrt(np.maximum(np.partition(square, k - 1, axis=1)[:, k - 1], 0)) * (1 + 1e-9)
    return out


def _ask(index: DataFrame, rotation: Rotation, ids: np.ndarray, vectors: np.ndarray, k: int, sample_ids: np.ndarray, sample: np.ndarray) -> DataFrame:
    """Each task's k nearest rows for every one of the given queries; the sample gives their first limits."""
    asked = index.sparkSession.sparkContext.broadcast((ids, vectors, sample_ids, sample))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, sample_ids, sample = asked.value
        near = Nearest(ids, vectors, rotation, k, first_limits(ids, vectors, sample_ids, sample, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), "<u8").reshape(part.num_rows, -1)
                near.meet(np.asarray(part.column("vec_id")), codes, np.asarray(part.column("length")), np.asarray(part.column("alignment")), _matrix(part.column("vector"), part.num_rows))
        some = np.isfinite(near.distance)
        who = np.nonzero(some)[0]
        yield pa.RecordBatch.from_arrays([pa.array(near.ids[who]), pa.array(near.best[some]), pa.array(near.distance[some])], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(search, FOUND)


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of each query row.

    ``is_query`` is a condition on vec_id.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = taking_part(vectors)
    rotation = Rotation(mean_vector(rows))
    index = scratch.keep(encode(rows, rotation), "index")
    queries = index.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    size = queries.count() * max(1, len(rotation.mean)) * 4
    rounds = max(1, -(-size // QUERY_BYTES))
    some = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vec_id", "vector").collect()
    kind = np.float32 if index.schema["vector"].dataType.elementType == T.FloatType() else np.float64
    sample_ids, sample = np.array([x.vec_id for x in some]), np.array([x.vector for x in some], kind)
    parts: list[DataFrame] = []
    for r in range(rounds):
        asked = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).orderBy("vec_id").collect()
        if asked:
            ids, of = np.array([x.vec_id for x in asked]), np.array([x.vector for x in asked], kind)
            parts.append(_ask(index, rotation, ids, of, k, sample_ids, sample))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same by comparing every query with every row.
SQL = """
with sound as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), rows as (
  select * from sound where len(v) = (select len(v) from sound group by len(v) order by count(*) desc, len(v) limit 1)
), pairs as (
  select q.vec_id as query_id, r.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - r.v[i]) * (q.v[i] - r.v[i])), lambda x, y: x + y)) as score
  from rows q join rows r on q.vec_id <> r.vec_id where q.vec_id % 100 = 0
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from pairs) where rank <= 10
"""
