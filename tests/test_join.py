import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import join

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
keys = st.lists(st.one_of(st.none(), st.integers(-(2**21), 2**21)), max_size=30)


def table(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_index long, key long")


def ids(df):
    return sorted(r.row_index for r in df.collect())


def test_null_keys_stay_when_filtered_and_never_join(spark):
    left, right = table(spark, [1, None, 5]), table(spark, [5, None])
    assert ids(join.filter_by(left, join.filter_slots(right))) == [1, 2]
    assert join.join_inner(right.withColumnRenamed("key", "k"), left, "k", "key").count() == 1


def test_colliding_keys_pass_the_filter_but_do_not_join(spark):
    left, right = table(spark, [7]), table(spark, [7 + (1 << 20)])
    assert ids(join.filter_by(left, join.filter_slots(right))) == [0]
    assert join.join_inner(right.withColumnRenamed("key", "k"), left, "k", "key").count() == 0


def test_on_a_tie_the_probe_side_filters(spark):
    build, probe = join.materialize_sides(table(spark, [1, 2]), table(spark, [2, 3]), 2, 2)
    assert ids(build) == [1] and ids(probe) == [0, 1]


def test_the_workload_runner_counts_no_colliding_keys(spark):
    from tessera import cli

    r, s = (spark.createDataFrame(list(enumerate(k)), "row_index long, c0 int") for k in ([1, 2, 3], [2, 3, 3, 1 + (1 << 20), 4]))
    for phase, steps in (("materialize_input", 1), ("partition_by_radix", 1), ("join_hash", 2)):
        results: cli.Results = []
        cli.run_join(r, s, phase, results)
        assert [n for _, n in results] == [3] * len(results) and len(results) == 2 * steps + (phase == "join_hash")


def test_exact_sides_keep_null_keys(spark):
    build, probe = join.materialize_sides(table(spark, [1, None]), table(spark, [1, None, 1 + (1 << 20)]), 2, 3, exact=True)
    assert ids(build) == [0, 1] and ids(probe) == [0, 1]


def test_negative_keys_use_their_low_bits(spark):
    assert [r.slot for r in join.filter_slots(table(spark, [-1])).collect()] == [1048575]
    assert {r.radix for r in join.radix_partition(table(spark, [-5, -1]), 1).collect()} == {1}


def test_partitions_hold_one_radix_each(spark):
    placed = join.radix_partition(table(spark, list(range(40))), 2).selectExpr("radix", "spark_partition_id() as p").distinct().collect()
    assert len({r.p for r in placed}) == len({r.radix for r in placed}) == len(placed) == 4


def test_no_bits_is_one_radix(spark):
    assert {r.radix for r in join.radix_partition(table(spark, [3, 4]), 0).collect()} == {0}


def test_empty_sides(spark):
    none = table(spark, [])
    assert ids(join.filter_by(table(spark, [1]), join.filter_slots(none))) == []
    assert join.radix_histogram(none, 1).count() == 0


def test_other_key_types_are_refused(spark):
    with pytest.raises(TypeError):
        join.filter_slots(spark.createDataFrame([(0, "a")], "row_index long, key string"))


def test_strategy_hint_is_followed(spark):
    a, b = table(spark, [1]), table(spark, [1]).withColumnRenamed("key", "k")
    plan = join.join_inner(b, a, "k", "key", "shuffle_hash")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


@few
@given(keys, keys)
def test_filter_loses_no_match_and_histogram_counts_survivors(spark, build, probe):
    b, p = table(spark, build), table(spark, probe)
    kept = join.filter_by(p, join.filter_slots(b))
    wanted = {i for i, k in enumerate(probe) if k is None or k in set(build)}
    assert wanted <= set(ids(kept))
    counted = join.radix_histogram(kept, 1, 4).agg({"n": "sum"}).first()[0] or 0
    assert counted == kept.where("key is not null").count() == join.radix_partition(kept, 1).count()
