import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import csv, generate
from tessera.sources.generate import ColumnDef
from tessera.sources.parquet import read_with_row_ids


def test_workload_sizes_are_float32_products():
    assert generate.sizes(0.01) == (1595, 60012, 2000)
    assert generate.sizes(10)[1] == 60012152


def test_values_do_not_depend_on_partitions(spark):
    columns = [ColumnDef("int", True), ColumnDef("int", False, 1, 5), ColumnDef("float", False, 2, 3), ColumnDef("string")]
    one, many = (sorted(map(tuple, generate.generate(spark, 300, columns, 4, n).collect())) for n in (1, 7))
    assert one == many
    assert [r[0] for r in one] == list(range(1, 301)) and {r[1] for r in one} == {1, 2, 3, 4, 5}
    assert all(2 <= r[2] < 3 and 5 <= len(r[3]) <= 15 and r[3].isupper() for r in one)


def test_unknown_kinds_are_refused():
    with pytest.raises(ValueError, match="unsupported"):
        ColumnDef("date")
    with pytest.raises(ValueError, match="serial"):
        ColumnDef("string", True)


def test_empty_table_has_the_schema(spark):
    t = generate.empty_table(spark, [ColumnDef("int"), ColumnDef("string")])
    assert t.dtypes == [("c0", "int"), ("c1", "string")] and t.count() == 0


def test_row_ids_run_on_over_files(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(0, 50, 1, 3).write.parquet(path)
    rows = read_with_row_ids(spark, str(tmp_path), "t").orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(50)) and [r.id for r in rows] == list(range(50))


def test_csv_has_six_decimals_and_repeated_columns(spark, tmp_path):
    t = spark.createDataFrame([(2, 1.5, "b"), (1, None, "a")], "k int, v double, s string")
    csv.write_csv(t, f"{tmp_path}/o.csv", [0, 1, 2, 2], order_by="k")
    files = sorted(f for f in os.listdir(f"{tmp_path}/o.csv") if f.startswith("part-"))
    assert "".join(open(f"{tmp_path}/o.csv/{f}").read() for f in files) == "1,,a,a\n2,1.500000,b,b\n"


def test_sorted_csv_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    csv.write_csv(spark.range(0, 20000, 1, 3).selectExpr("20000 - id as k", "repeat('x', 400) as s"), f"{tmp_path}/o.csv", [0], order_by="k")
    files = sorted(f for f in os.listdir(f"{tmp_path}/o.csv") if f.startswith("part-"))
    assert "".join(open(f"{tmp_path}/o.csv/{f}").read() for f in files).split() == [str(i) for i in range(1, 20001)]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 1


def test_command_line_runs_every_operation(spark, monkeypatch, capsys):
    from tessera import cli

    monkeypatch.setattr(cli, "local_session", lambda **_: spark)
    for operation in ("join_hash", "materialize_input", "partition_by_radix", "insert", "delete", "update", "aggregate_hash", "partition_by_groupby_keys", "aggregate_segment", "all_in_one"):
        cli.main(["-t", operation, "-s", "0.001"])
    said = capsys.readouterr().err
    assert "materialize_input time" in said and "18003 physical, 12002 visible" in said
    with pytest.raises(ValueError, match="unknown operation"):
        cli.main(["-t", "nothing"])


def test_stream_batches_are_inserted_once(spark, tmp_path):
    from tessera.operators.table import Table
    from tessera.streaming.append import append_stream

    spark.range(0, 20, 1, 2).write.parquet(f"{tmp_path}/in")
    table = Table(spark.range(3))
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    query = append_stream(stream, table, f"{tmp_path}/staging").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert table.snapshot().agg(F.sum("id")).first()[0] == 193 and table.physical_rows() == 23
