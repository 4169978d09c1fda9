import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import views
from tessera.operators.table import Table, WriteConflict, lock_state
from tessera.sources.parquet import dense_row_ids


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "c0 int").coalesce(1)


def some(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "row_index long")


def content(df):
    return sorted((r.row_index, r.c0) for r in df.collect())


def test_insert_appends_in_order_and_keeps_duplicates(spark):
    t = Table(frame(spark, [1, 2]))
    t.insert(frame(spark, [2, 2, None]))
    assert content(t.snapshot())[:2] == [(0, 1), (1, 2)]
    assert [(r.row_index, r.c0) for r in t.snapshot().orderBy("row_index").collect()][2:] == [(2, 2), (3, 2), (4, None)]


@pytest.mark.parametrize(("n", "ranges"), [(2, [(0, 3, 4), (1, 0, 1)]), (1, [(0, 3, 4)]), (0, []), (6, [(0, 3, 4), (1, 0, 4), (2, 0, 1)])])
def test_chunk_ranges_cross_boundaries(spark, n, ranges):
    t = Table(frame(spark, [1, 2, 3]), chunk_rows=4)
    cid = t.insert(frame(spark, list(range(n))))
    assert sorted(map(tuple, t.chunk_ranges(cid).collect())) == ranges


def test_delete_hides_rows_but_keeps_them_physically(spark):
    t = Table(frame(spark, [1, 2, 3]))
    t.delete(some(spark, [1, 1]))
    assert content(t.snapshot()) == [(0, 1), (2, 3)]
    assert t.physical_rows() == 3 and content(t.snapshot(0)) == [(0, 1), (1, 2), (2, 3)]


def test_update_is_one_commit_and_row_ids_are_not_reused(spark):
    t = Table(frame(spark, [1, 2]))
    assert t.update(frame(spark, [9]), some(spark, [0])) == 1
    assert content(t.snapshot()) == [(1, 2), (2, 9)]


def test_conflicting_deletes_are_refused_whole(spark):
    t = Table(frame(spark, [1, 2, 3]))
    first, second = t.begin(), t.begin()
    first.delete(some(spark, [1]))
    with pytest.raises(WriteConflict):
        second.delete(some(spark, [0, 1]))
    first.commit()
    second.rollback()
    assert content(t.snapshot()) == [(0, 1), (2, 3)]


def test_deleting_a_row_that_is_gone_does_nothing(spark):
    t = Table(frame(spark, [1, 2, 3]))
    assert t.delete(some(spark, [1])) == 1 and t.delete(some(spark, [1, 2])) == 2
    assert content(t.snapshot()) == [(0, 1)] and content(t.snapshot(1)) == [(0, 1), (2, 3)]
    ends = {r.row_index: r._end_cid for r in t.versions().collect()}
    assert ends[1] == 1 and ends[2] == 2


def test_a_commit_meanwhile_is_a_conflict(spark):
    t = Table(frame(spark, [1, 2, 3]))
    late = t.begin()
    t.delete(some(spark, [1]))
    late.delete(some(spark, [1]))
    with pytest.raises(WriteConflict, match="another commit"):
        late.commit()
    assert content(t.snapshot()) == [(0, 1), (2, 3)] and not late.open


def test_conflicts_name_the_holder(spark):
    t = Table(frame(spark, [1, 2, 3]))
    first, second = t.begin().delete(some(spark, [0])), t.begin().delete(some(spark, [2]))
    third = t.begin()
    assert sorted(map(tuple, third.conflicts(some(spark, [0, 1, 2])).collect())) == [(0, first.tid), (2, second.tid)]
    assert t.begin().conflicts(some(spark, [1])).collect() == [] and Table(frame(spark, [1])).begin().conflicts(some(spark, [0])).count() == 0


def test_many_deletes_are_one_anti_join(spark):
    t = Table(frame(spark, list(range(8))))
    for i in range(5):
        t.delete(some(spark, [i]))
    plan = t.snapshot()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and content(t.snapshot()) == [(5, 5), (6, 6), (7, 7)]


def test_rollback_frees_the_rows(spark):
    t = Table(frame(spark, [1]))
    t.begin().delete(some(spark, [0])).rollback()
    t.delete(some(spark, [0]))
    assert content(t.snapshot()) == []


def test_compact_keeps_rows_ids_and_count(spark, tmp_path):
    t = Table(frame(spark, [1, 2]))
    t.update(frame(spark, [5]), some(spark, [0]))
    t.compact(f"file://{tmp_path}/t")
    assert content(t.snapshot()) == [(1, 2), (2, 5)] and t.physical_rows() == 3
    t.insert(frame(spark, [7]))
    assert content(t.snapshot())[-1] == (3, 7)


def test_compact_twice_keeps_commits_and_gives_up_old_snapshots(spark, tmp_path):
    t = Table(frame(spark, [1, 2, 3]))
    t.insert(frame(spark, [4]))
    t.delete(some(spark, [0]))
    for _ in range(2):
        t.compact(f"file://{tmp_path}/t")
        assert content(t.snapshot()) == [(1, 2), (2, 3), (3, 4)]
    assert {r.row_index: r._begin_cid for r in t.versions().collect()} == {1: 0, 2: 0, 3: 1}
    with pytest.raises(ValueError, match="compacted"):
        t.snapshot(0)
    assert t.insert(frame(spark, [5])) == 3 and content(t.snapshot(2)) == [(1, 2), (2, 3), (3, 4)]
    open_one = t.begin()
    with pytest.raises(RuntimeError, match="open"):
        t.compact(f"file://{tmp_path}/t")
    open_one.rollback()


def test_lock_state_follows_listing_parity(spark):
    assert sorted(map(tuple, lock_state(some(spark, [0, 0, 1, 2, 2, 2])).collect())) == [(0, False), (1, True), (2, True)]


def test_view_is_frozen_and_may_repeat_rows(spark):
    t = Table(frame(spark, [1, 2]))
    v = views.whole_table(t.snapshot())
    t.insert(frame(spark, [3]))
    assert content(v.read()) == [(0, 1), (1, 2)]
    assert content(views.View(t.snapshot(), some(spark, [1, 1])).read()) == [(1, 2), (1, 2)]


def test_source_must_have_the_columns(spark):
    with pytest.raises(ValueError, match="lacks"):
        Table(frame(spark, [1])).insert(spark.range(1))


def test_dense_row_ids_over_partitions(spark):
    rows = dense_row_ids(spark.range(0, 100, 1, 7), 5).collect()
    assert [r.row_index for r in rows] == list(range(5, 105)) and [r.id for r in rows] == list(range(100))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), max_size=8), st.lists(st.integers(0, 9), max_size=8), st.sets(st.integers(0, 15), max_size=6))
def test_row_count_algebra(spark, base, more, gone):
    t = Table(frame(spark, base))
    t.insert(frame(spark, more))
    t.delete(some(spark, gone))
    n = len(base) + len(more)
    assert t.snapshot().count() == n - len({g for g in gone if g < n}) and t.physical_rows() == n
