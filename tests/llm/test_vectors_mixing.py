import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, vectors


def brute(rows, query, k=10):
    out = {}
    for q, x in rows:
        if query(q) and q not in out:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))), v) for v, y in rows if v != q)
            out[q] = near[:k]
    return out


def ask(spark, rows, query, kind="array<float>", k=10):
    found = vectors.nearest_neighbours(spark.createDataFrame(rows, f"vec_id long, embedding {kind}"), query, k)
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert len(out[r.query_id]) == r.rank
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(48).astype(np.float32).tolist()) for i in range(1500)]
    got, want = ask(spark, rows, F.col("vec_id") % 50 == 0), brute(rows, lambda q: q % 50 == 0)
    hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.98 * 10 * len(want)
    for q in want:
        for score, v in got[q]:
            assert score == pytest.approx(math.dist(rows[q][1], rows[v][1]), rel=1e-14)


def test_ties_copies_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [0.0, 1.0]), (10, [None, 1.0])]
    got = ask(spark, rows, F.col("vec_id") % 10 == 0)
    assert got == {0: [(1.0, 1), (1.0, 2), (1.0, 3)]}
    same = [(i, [1.0, 2.0]) for i in range(30)]
    assert ask(spark, same, F.col("vec_id") == 0, k=3) == {0: [(0.0, 1), (0.0, 2), (0.0, 3)]}


def test_no_rows_and_no_queries(spark):
    assert ask(spark, [], F.col("vec_id") == 0) == {}
    assert ask(spark, [(1, [1.0])], F.col("vec_id") == 0) == {}
    assert ask(spark, [(0, [1.0])], F.col("vec_id") == 0) == {}


def test_queries_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BYTES", 200)
    rows = [(i, [float(i), 1.0]) for i in range(100)]
    assert ask(spark, rows, F.col("vec_id") % 2 == 0, k=2) == brute(rows, lambda q: q % 2 == 0, 2)


def poisson(u, rate):
    k, total = 0, math.exp(-rate)
    p = total
    while total < u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_invert_the_distribution(spark):
    rows = [(i, f"t{i}", None if i % 7 == 0 else f"s{i % 3}") for i in range(400)] + [(None, "n", "s0"), (1, "t1", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s0": 1.0, "s1": 3.0}
    got = {}
    for r in mixing.replicate(docs, weights, rows=2000, seed=9).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    n = {s: sum(x[2] == s for x in rows) for s in weights}
    want = {}
    for key, _, source in rows:
        if source in weights:
            digest = hashlib.md5(f"draw 9|{'' if key is None else key}".encode()).hexdigest()
            times = poisson((int(digest[:12], 16) + 0.5) / 2**48, 2000 * weights[source] / 4 / n[source])
            if times:
                want[key, source] = want.get((key, source), 0) + times
    assert got == want


def test_expected_shares_and_order(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'x' as text", "if(id % 10 < 9, 'big', 'small') as source", "7 as copy_no")
    out = mixing.replicate(docs, {"big": 1, "small": 1}).toPandas()
    assert abs((out.source == "small").mean() - 0.5) < 0.03 and abs(len(out) - 20_000) < 600
    assert list(out.shuffle_key) == sorted(out.shuffle_key)
    assert set(out.copy_no) == {7} and out._copy_no.min() == 1


def test_many_sources_are_joined_without_broadcast(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id as doc_id", "'x' as text", "concat('s', id % 50) as source")
    want = sorted(map(tuple, mixing.replicate(docs, rows=900).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_STEPS", 10)
    assert sorted(map(tuple, mixing.replicate(docs, rows=900).collect())) == want


def test_large_rates_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert 2700 < mixing.replicate(docs, {"s": 1}, rows=3000).count() < 3300
    assert mixing.replicate(docs, {"other": 1}).count() == 0
    assert mixing.replicate(docs.limit(0)).count() == 0
