"""Every query of the core engine against its SQL on the smallest fixtures."""

import duckdb
import pytest

from tessera.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    expected = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(expected, columns)


def test_lock_state_covers_every_row_of_the_table(spark, duck):
    got = catalog.queries()["delete_lock_state"](spark, SF).toPandas()
    assert len(got) == duck.execute("select count(*) from lineitem").fetchone()[0] == got.row_index.nunique()
    assert 0 < got.locked.sum() < len(got)


def test_every_query_has_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_entry_module_lists_what_it_can_run():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())
