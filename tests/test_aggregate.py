import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_index long, k int, v int")


def test_nulls_form_one_group_and_are_not_counted(spark):
    t = table(spark, [(None, 1), (None, 2), (1, None), (2, 5), (2, 5)])
    out = aggregate.aggregate(t, ["k"], [("sum", "v", "s"), ("count", "v", "c"), ("count_distinct", "v", "d")], first_row="row_index").collect()
    assert {(r.k, r.s, r.c, r.d, r.first_row_index) for r in out} == {(None, 3, 2, 2, 0), (1, None, 0, 0, 2), (2, 10, 2, 1, 3)}


def test_global_aggregate_of_nothing(spark):
    row = aggregate.aggregate(table(spark, []), [], [("sum", "v", "s"), ("count", "v", "c")]).first()
    assert row.s is None and row.c == 0


def test_unknown_or_no_aggregate_is_refused(spark):
    with pytest.raises(ValueError, match="unknown aggregate"):
        aggregate.aggregate(table(spark, []), ["k"], [("product", "v", "p")])
    with pytest.raises(ValueError, match="no aggregate"):
        aggregate.aggregate(table(spark, []), ["k"], [])


def test_sparse_keys(spark):
    out = aggregate.sparse_keys(table(spark, [(None, 0), (-(2**31), 0), (2**31 - 1, 0)]), ["k"]).collect()
    assert [r.key_k for r in out] == [0, 1, 2**32]


@pytest.mark.parametrize(("top", "dense"), [(4, True), (5, True), (6, False), (7, False)])
def test_dense_keys_need_a_range_below_the_threshold(spark, top, dense):
    rows = [(0, 0), (top, 0), (None, 0), (1, 0), (2, 0)]  # 5 rows: dense below 6
    out = aggregate.dense_keys(table(spark, rows), "k").orderBy("row_index").collect()
    assert {r.is_dense for r in out} == {dense}
    assert out[2].group_key == 0
    assert out[0].group_key == (1 if dense else 2147483649)


def test_dense_keys_of_nothing_and_of_nulls(spark):
    assert aggregate.dense_keys(table(spark, []), "k").count() == 0
    row = aggregate.dense_keys(table(spark, [(None, 0)]), "k").first()
    assert (row.group_key, row.is_dense) == (0, False)


def test_registered_aggregates(spark):
    rows = spark.createDataFrame([(1, 2), (1, 3), (2, None)], "k int, v int")
    spread = lambda c: F.max(c) - F.min(c)
    aggregate.register("spread", spread)
    aggregate.register("spread", spread)
    assert sorted(map(tuple, aggregate.aggregate(rows, ["k"], [("spread", "v", "d")]).collect())) == [(1, 1), (2, None)]
    with pytest.raises(ValueError, match="there already"):
        aggregate.register("sum", spread)
    del aggregate.AGGREGATES["spread"]
