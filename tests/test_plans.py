"""Plans: what is read, what is pushed down, what is shuffled."""

import re

from pyspark.sql import functions as F

from tessera.functions.keys import row_address
from tessera.operators import aggregate, join
from tessera.plans import catalog
from tessera.sources.parquet import read_table
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_needed_columns_and_push_filters(spark):
    text = plan(catalog.flagship(spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sorted(schemas) == ["l_partkey:bigint,l_quantity:double", "p_partkey:bigint,p_size:int"]
    assert "LessThanOrEqual(p_size,40)" in text


def test_row_ids_need_no_shuffle(spark):
    assert "Exchange" not in plan(catalog.scan_row_ids(spark, SF))


def test_grouped_sum_combines_before_its_one_shuffle(spark):
    lines = read_table(spark, SF, "lineitem")
    text = plan(aggregate.aggregate(lines, ["l_partkey"], [("sum", "l_linenumber", "s")]))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_dense_keys_do_not_gather_the_table(spark):
    text = plan(aggregate.dense_keys(read_table(spark, SF, "lineitem").select("l_partkey"), "l_partkey"))
    assert "Window" not in text and "BroadcastNestedLoopJoin" in text


def test_runtime_filter_reaches_a_shuffled_join(spark):
    settings = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        build = read_table(spark, SF, "part").where("p_size <= 40").select("p_partkey")
        text = plan(join.join_inner(build, read_table(spark, SF, "lineitem").select("l_partkey"), "p_partkey", "l_partkey"))
        assert "might_contain" in text
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_row_addresses_sort_like_row_ids(spark):
    rows = spark.range(0, 200_000, 20_000)
    got = [tuple(r.at) for r in rows.select("id", row_address(F.col("id")).alias("at")).orderBy("at").collect()]
    assert got == [divmod(i, 65536) for i in range(0, 200_000, 20_000)]
