"""Named queries of the core engine, each with the SQL that it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions.keys import chunk_id, chunk_offset, row_address
from tessera.operators import aggregate, join, views
from tessera.operators.table import Table, commit_max, lock_state
from tessera.session import shared_dir
from tessera.sources import csv, generate
from tessera.sources.parquet import ROW, read_table, read_with_row_ids

#: Rows of a chunk in these queries: small, so that the fixtures have several.
CHUNK = 8192
QUANTITY = "cast(l_quantity as int)"


def _lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_with_row_ids(spark, sf_dir, "lineitem").select("row_index", *columns)


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_with_row_ids(spark, sf_dir, "part").where("p_size <= 40")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_with_row_ids(spark, sf_dir, "lineitem").selectExpr("row_index", "l_partkey", "l_suppkey", f"{QUANTITY} as quantity")


def _version_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the DML queries: (l_partkey, quantity) of lineitem."""
    return _grouped(spark, sf_dir).select("row_index", "l_partkey", "quantity")


def _new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_with_row_ids(spark, sf_dir, "part").selectExpr("row_index", "p_partkey as l_partkey", "p_size as quantity")


def _low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _version_source(spark, sf_dir).where("quantity < 10").select("row_index")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join part (p_size <= 40) with lineitem on the part key and sum quantities per key."""
    part = read_table(spark, sf_dir, "part").where("p_size <= 40").select("p_partkey")
    lines = read_table(spark, sf_dir, "lineitem").selectExpr("l_partkey", f"{QUANTITY} as quantity")
    return aggregate.aggregate(join.join_inner(part, lines, "p_partkey", "l_partkey"), ["l_partkey"], [("sum", "quantity", "sum_quantity")])


def scan_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.col("row_index")
    return _lines(spark, sf_dir, "l_partkey").select(chunk_id(row, CHUNK).alias("chunk_id"), chunk_offset(row, CHUNK).alias("chunk_offset"), "l_partkey")


def row_and_chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("row_count"), F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunk_count"))


def table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read_table(spark, sf_dir, "part").schema
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "position int, name string, type string")


def project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return csv.project(lines, [lines.columns.index("l_quantity"), lines.columns.index("l_partkey")])


def view_one_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.one_chunk(_lines(spark, sf_dir, "l_partkey"), 1, CHUNK).read()


def view_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.whole_table(_lines(spark, sf_dir, "l_partkey")).read("l_partkey")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    build = join.materialize(_build(spark, sf_dir), "p_partkey")
    probe = join.materialize(_lines(spark, sf_dir, "l_partkey"), "l_partkey")
    return join.materialize_sides(build, probe, build.count(), probe.count())


def materialize_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[0]


def materialize_larger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[1]


def filter_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.filter_slots(join.materialize(_build(spark, sf_dir), "p_partkey"))


def radix_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.radix_histogram(join.materialize(_lines(spark, sf_dir, "l_partkey"), "l_partkey"), 1, CHUNK)


def radix_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.radix_partition(join.materialize(_lines(spark, sf_dir, "l_partkey"), "l_partkey"), 1)


def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, "l_partkey")
    return join.join_inner(_build(spark, sf_dir).select("p_partkey", "p_size"), lines, "p_partkey", "l_partkey")


def join_inner_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, "l_partkey")
    return join.join_inner(_build(spark, sf_dir).select("p_partkey", "p_size"), lines, "p_partkey", "l_partkey", "shuffle_hash")


def group_keys_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.sparse_keys(_lines(spark, sf_dir, "l_partkey"), ["l_partkey"])


def group_keys_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.dense_keys(_lines(spark, sf_dir, "l_partkey"), "l_partkey")


def group_keys_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.sparse_keys(_lines(spark, sf_dir, "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


def _aggregated(group_by: list[str], *aggregates: tuple[str, str, str], first_row: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: aggregate.aggregate(_grouped(spark, sf_dir), group_by, list(aggregates), first_row)


def insert_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(_version_source(spark, sf_dir), chunk_rows=CHUNK)
    table.insert(_new_rows(spark, sf_dir))
    return table.snapshot()


def insert_chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(_version_source(spark, sf_dir), chunk_rows=512)
    return table.chunk_ranges(table.insert(_new_rows(spark, sf_dir)))


def delete_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(_version_source(spark, sf_dir), chunk_rows=CHUNK)
    table.delete(_low(spark, sf_dir))
    return table.snapshot()


def delete_lock_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the table is requested, rows of low quantity once more."""
    return lock_state(_version_source(spark, sf_dir).select("row_index").union(_low(spark, sf_dir)))


def delete_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a second open transaction cannot have, with the transaction that holds them."""
    rows = _version_source(spark, sf_dir)
    table = Table(rows, chunk_rows=CHUNK)
    table.begin().delete(_low(spark, sf_dir))
    return table.begin().conflicts(rows.where("quantity between 5 and 15").select("row_index"))


def delete_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a commit ended are not there for a later transaction: its delete takes the others."""
    rows = _version_source(spark, sf_dir)
    table = Table(rows, chunk_rows=CHUNK)
    table.delete(_low(spark, sf_dir))
    table.delete(rows.where("quantity between 5 and 15").select("row_index"))
    return table.versions().groupBy("_begin_cid", "_end_cid").agg(F.count(F.lit(1)).alias("n"))


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after an update, compacted twice, then changed again: row ids and commits go on."""
    rows = _version_source(spark, sf_dir)
    table = Table(rows, chunk_rows=CHUNK)
    table.update(_new_rows(spark, sf_dir), _low(spark, sf_dir))
    folder = f"{shared_dir(spark)}/compact-{uuid.uuid4().hex}"
    table.compact(folder)
    table.delete(rows.where("quantity = 10").select("row_index"))
    table.compact(folder)
    return table.versions().select("row_index", "quantity", "_begin_cid", "_end_cid")


def update_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(_version_source(spark, sf_dir), chunk_rows=CHUNK)
    table.update(_new_rows(spark, sf_dir), _low(spark, sf_dir))
    return table.snapshot()


def row_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(_version_source(spark, sf_dir), chunk_rows=CHUNK)
    table.update(_new_rows(spark, sf_dir), _low(spark, sf_dir))
    return table.versions().groupBy("_begin_cid", "_end_cid").agg(F.count(F.lit(1)).alias("n"))


def snapshot_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(_version_source(spark, sf_dir), chunk_rows=CHUNK)
    first = table.insert(_new_rows(spark, sf_dir))
    table.delete(_low(spark, sf_dir))
    return table.snapshot(first)


def newest_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(_version_source(spark, sf_dir), chunk_rows=CHUNK)
    table.delete(_low(spark, sf_dir))
    return commit_max(table.versions(), "_end_cid")


def all_in_one_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update every row by itself, then insert all once more: 3n physical, 2n visible rows."""
    rows = _version_source(spark, sf_dir)
    table = Table(rows, chunk_rows=CHUNK)
    table.update(rows, rows.select("row_index"))
    table.insert(rows)
    return table.snapshot().agg(F.lit(table.physical_rows()).cast("long").alias("physical_rows"), F.count(F.lit(1)).alias("visible_rows"))


def _scale(spark: SparkSession, sf_dir: str) -> float:
    """The workload's scale at which its probe side is about as large as lineitem."""
    return read_table(spark, sf_dir, "lineitem").count() / 6_000_000


def generate_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.workload(spark, _scale(spark, sf_dir))[0]


def generate_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.workload(spark, _scale(spark, sf_dir), 1)[1]


#: Columns of every kind that the generator makes.
KINDS = [generate.ColumnDef("int", True), generate.ColumnDef("int", False, 1, 100), generate.ColumnDef("float", False, 900, 9000), generate.ColumnDef("float", False, 0.01, 0.1), generate.ColumnDef("string")]


def generate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.generate(spark, read_table(spark, sf_dir, "part").count(), KINDS, 5)


def empty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.empty_table(spark, KINDS)


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[1]


def radix_histogram_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the keys that the membership filter lets through, by three bits."""
    return join.radix_histogram(_survivors(spark, sf_dir), 3, CHUNK)


def radix_partition_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.radix_partition(_survivors(spark, sf_dir), 3)


def radix_no_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without bits all keys are one partition."""
    return join.radix_partition(join.materialize(_lines(spark, sf_dir, "l_partkey"), "l_partkey"), 0)


def group_keys_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose range is too wide for the dense form, some of them NULL."""
    orders = read_with_row_ids(spark, sf_dir, "orders").selectExpr("row_index", "if(o_custkey % 10 = 0, null, o_orderkey * 1000) as wide_key")
    return aggregate.dense_keys(orders, "wide_key").selectExpr("row_index", "wide_key is null as missing", "group_key", "is_dense")


def row_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose address (chunk, offset) is at least that of a row in the second chunk, with their addresses."""
    rows = _lines(spark, sf_dir, "l_partkey").select("row_index", row_address(F.col(ROW), CHUNK).alias("address"))
    border = F.struct(F.lit(1).cast("long").alias("chunk_id"), F.lit(100).cast("long").alias("chunk_offset"))
    return rows.where(F.col("address") >= border).select("row_index", "address.chunk_id", "address.chunk_offset")


def view_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a view and their positions in its source."""
    view = views.whole_table(read_with_row_ids(spark, sf_dir, "part"))
    return spark.createDataFrame(sorted(view.column_ids("p_size", "p_partkey").items()), "name string, position int")


def agg_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate that a user adds: the sum of squares."""
    aggregate.register("sum_squares", _sum_squares)
    return aggregate.aggregate(_grouped(spark, sf_dir), ["l_partkey"], [("sum_squares", "quantity", "squares")])


def _sum_squares(column: str) -> Column:
    return F.sum(F.col(column).cast("long") * F.col(column))


def workload_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every phase of every operation of the workload runner."""
    out = []
    for operation in cli.OPERATIONS:
        results: cli.Results = []
        cli.run(spark, operation, _scale(spark, sf_dir), None, results)
        out += [(operation, i, phase, rows) for i, (phase, rows) in enumerate(results)]
    return spark.createDataFrame(out, "operation string, step int, phase string, n long")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    csv.write_csv(lines, path := f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}", [0, 1])
    return csv.read_csv(lines, path)


def _md5_number(*parts: str) -> str:
    """SQL of the generator's number below 2^48."""
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12) as bigint)"


#: SQL of the workload's rows of R and S and of the largest key of S: products in 32-bit floats, cut.
_SCALE = "cast((select count(*) from lineitem) / 6000000 as float)"
_R_ROWS, _S_ROWS, _S_KEYS = (f"cast(trunc(cast({n} as float) * {_SCALE}) as bigint)" for n in (generate.R_ROWS, generate.S_ROWS, generate.S_KEYS))
_S = f"(select r as id, cast({_md5_number('2000', 'r')} % {_S_KEYS} + 1 as int) as c0, cast({_md5_number('2001', 'r')} % 50 + 1 as int) as c1 from range(0, {_S_ROWS}) t(r)) s"
_RESULTS = f"""
with sizes as (select {_R_ROWS} as r, {_S_ROWS} as s),
found as (select sizes.*, (select count(*) from {_S}, sizes where c0 <= r) as hits, (select count(distinct c0) from {_S}) as groups from sizes),
steps as (
  select unnest([
    ('join_hash', 0, 'Generate data', r + s), ('join_hash', 1, 'materialize_input', r), ('join_hash', 2, 'partition_by_radix', r), ('join_hash', 3, 'materialize_input', hits),
    ('join_hash', 4, 'partition_by_radix', hits), ('join_hash', 5, 'join_hash', hits),
    ('materialize_input', 0, 'Generate data', r + s), ('materialize_input', 1, 'materialize_input', r), ('materialize_input', 2, 'materialize_input', hits),
    ('partition_by_radix', 0, 'Generate data', r + s), ('partition_by_radix', 1, 'partition_by_radix', r), ('partition_by_radix', 2, 'partition_by_radix', hits),
    ('insert', 0, 'Generate data', r + s), ('insert', 1, 'insert', r), ('insert', 2, 'insert', s),
    ('delete', 0, 'Generate data', r + s), ('delete', 1, 'delete', 0), ('delete', 2, 'delete', 0),
    ('update', 0, 'Generate data', r + s), ('update', 1, 'update', 2 * r), ('update', 2, 'update', 2 * s),
    ('aggregate_hash', 0, 'Generate data', r + s), ('aggregate_hash', 1, 'partition_by_groupby_keys', s), ('aggregate_hash', 2, 'aggregate_hash', groups),
    ('partition_by_groupby_keys', 0, 'Generate data', r + s), ('partition_by_groupby_keys', 1, 'partition_by_groupby_keys', s),
    ('aggregate_segment', 0, 'Generate data', r + s), ('aggregate_segment', 1, 'aggregate_segment', groups),
    ('all_in_one', 0, 'Generate data', r + s), ('all_in_one', 1, 'join_hash', hits), ('all_in_one', 2, 'partition_by_groupby_keys', s), ('all_in_one', 3, 'aggregate_hash', groups),
    ('all_in_one', 4, 'update', 2 * s), ('all_in_one', 5, 'delete', 0), ('all_in_one', 6, 'insert', 3 * s)
  ]) as x from found
)
select x[1] as operation, cast(x[2] as int) as step, x[3] as phase, cast(x[4] as bigint) as n from steps
"""
_KINDS = f"""
select cast(r + 1 as int) as c0, cast({_md5_number('5001', 'r')} % 100 + 1 as int) as c1,
  cast({_md5_number('5002', 'r')} / 281474976710656.0::double * (9000 - 900) + 900 as float) as c2,
  cast({_md5_number('5003', 'r')} / 281474976710656.0::double * (0.1::double - 0.01::double) + 0.01::double as float) as c3,
  array_to_string(list_transform(range(1, {_md5_number('5004', 'r')} % 11 + 6), lambda i: chr(cast(65 + {_md5_number('5004', 'r', 'i')} % 26 as int))), '') as c4
from range(0, (select count(*) from part)) t(r)
"""

_L = "(select *, row_number() over () - 1 as row_index from lineitem) l"
_P = "(select *, row_number() over () - 1 as row_index from part) p"
_Q = "cast(l_quantity as int)"
_BASE = f"select l_partkey, {_Q} as quantity, row_index from {_L}"
_NEW = f"select p_partkey, p_size, row_index + (select count(*) from lineitem) from {_P}"

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "join_then_sum": (flagship, f"select l_partkey, cast(sum({_Q}) as bigint) as sum_quantity from lineitem join part on l_partkey = p_partkey where p_size <= 40 group by l_partkey"),
    "scan_row_ids": (scan_row_ids, f"select row_index // {CHUNK} as chunk_id, row_index % {CHUNK} as chunk_offset, l_partkey from {_L}"),
    "row_and_chunk_count": (row_and_chunk_count, f"select count(*) as row_count, cast(ceil(count(*) / {CHUNK}.0) as bigint) as chunk_count from lineitem"),
    "table_schema": (table_schema, "select cast(row_number() over () - 1 as int) as position, column_name as name, case column_type when 'INTEGER' then 'int' when 'VARCHAR' then 'string' else lower(column_type) end as type from (describe part)"),
    "project_columns": (project_columns, "select l_quantity, l_partkey from lineitem"),
    "view_one_chunk": (view_one_chunk, f"select row_index, l_partkey from {_L} where row_index // {CHUNK} = 1"),
    "view_whole_table": (view_whole_table, f"select row_index, l_partkey from {_L}"),
    "materialize_smaller": (materialize_smaller, f"select row_index, p_partkey as key from {_P} where p_size <= 40"),
    "materialize_larger": (materialize_larger, f"select row_index, l_partkey as key from {_L} where (l_partkey & 1048575) in (select p_partkey & 1048575 from part where p_size <= 40)"),
    "filter_slots": (filter_slots, "select distinct p_partkey & 1048575 as slot from part where p_size <= 40"),
    "radix_histogram": (radix_histogram, f"select row_index // {CHUNK} as chunk_id, l_partkey & 1 as radix, count(*) as n from {_L} group by all"),
    "radix_partition": (radix_partition, f"select row_index, l_partkey as key, l_partkey & 1 as radix from {_L}"),
    "join_inner": (join_inner, f"select row_index, l_partkey, p_partkey, p_size from {_L} join part on l_partkey = p_partkey where p_size <= 40"),
    "join_inner_shuffled": (join_inner_shuffled, f"select row_index, l_partkey, p_partkey, p_size from {_L} join part on l_partkey = p_partkey where p_size <= 40"),
    "group_keys_sparse": (group_keys_sparse, f"select row_index, l_partkey, coalesce(l_partkey + 2147483649, 0) as key_l_partkey from {_L}"),
    "group_keys_dense": (group_keys_dense, f"select row_index, l_partkey, l_partkey - min(l_partkey) over () + 1 as group_key, max(l_partkey) over () - min(l_partkey) over () < 1.2 * count(*) over () as is_dense from {_L}"),
    "group_keys_multi": (group_keys_multi, f"select row_index, l_partkey, l_suppkey, l_partkey + 2147483649 as key_l_partkey, l_suppkey + 2147483649 as key_l_suppkey from {_L}"),
    "agg_sum": (_aggregated(["l_partkey"], ("sum", "quantity", "sum_quantity")), f"select l_partkey, cast(sum({_Q}) as bigint) as sum_quantity from lineitem group by l_partkey"),
    "agg_count": (_aggregated(["l_partkey"], ("count", "quantity", "n")), f"select l_partkey, count({_Q}) as n from lineitem group by l_partkey"),
    "agg_count_distinct": (_aggregated(["l_partkey"], ("count_distinct", "quantity", "n")), f"select l_partkey, count(distinct {_Q}) as n from lineitem group by l_partkey"),
    "agg_first_rowid": (_aggregated(["l_partkey"], ("count", "quantity", "n"), first_row="row_index"), f"select l_partkey, count({_Q}) as n, min(row_index) as first_row_index from {_L} group by l_partkey"),
    "agg_global": (_aggregated([], ("sum", "quantity", "sum_quantity"), ("count", "quantity", "n")), f"select cast(sum({_Q}) as bigint) as sum_quantity, count({_Q}) as n from lineitem"),
    "agg_multi_key": (_aggregated(["l_partkey", "l_suppkey"], ("sum", "quantity", "sum_quantity")), f"select l_partkey, l_suppkey, cast(sum({_Q}) as bigint) as sum_quantity from lineitem group by all"),
    "insert_append": (insert_append, f"{_BASE} union all {_NEW}"),
    "insert_chunk_ranges": (insert_chunk_ranges, f"select ri // 512 as chunk_id, min(ri % 512) as begin_offset, max(ri % 512) + 1 as end_offset from (select row_index + (select count(*) from lineitem) as ri from {_P}) group by 1"),
    "delete_visible": (delete_visible, f"{_BASE} where not ({_Q} < 10)"),
    "delete_lock_state": (delete_lock_state, f"select row_index, count(*) % 2 = 1 as locked from (select row_index from {_L} union all select row_index from {_L} where {_Q} < 10) group by row_index"),
    "delete_conflict": (delete_conflict, f"select row_index, cast(1 as bigint) as tid from {_L} where {_Q} between 5 and 9"),
    "delete_twice": (delete_twice, f"select cast(0 as bigint) as _begin_cid, case when {_Q} < 10 then 1 when {_Q} <= 15 then 2 else 4294967294 end as _end_cid, count(*) as n from lineitem group by all"),
    "compacted": (compacted, f"select row_index, {_Q} as quantity, cast(0 as bigint) as _begin_cid, 4294967294 as _end_cid from {_L} where {_Q} > 10 union all select row_index + (select count(*) from lineitem), p_size, 1, 4294967294 from {_P}"),
    "update_replace": (update_replace, f"{_BASE} where not ({_Q} < 10) union all {_NEW}"),
    "row_versions": (row_versions, f"select cast(0 as bigint) as _begin_cid, case when {_Q} < 10 then 1 else 4294967294 end as _end_cid, count(*) as n from lineitem group by all union all select 1, 4294967294, count(*) from part"),
    "snapshot_before": (snapshot_before, f"{_BASE} union all {_NEW}"),
    "newest_commit": (newest_commit, "select cast(1 as bigint) as max_cid"),
    "all_in_one_state": (all_in_one_state, "select 3 * count(*) as physical_rows, 2 * count(*) as visible_rows from lineitem"),
    "generate_r": (generate_r, f"select cast(r + 1 as int) as c0 from range(0, {_R_ROWS}) t(r)"),
    "generate_s": (generate_s, f"select c0, c1 from {_S}"),
    "generate_kinds": (generate_kinds, _KINDS),
    "empty_table": (empty_table, f"select * from ({_KINDS}) where false"),
    "radix_histogram_survivors": (radix_histogram_survivors, f"select row_index // {CHUNK} as chunk_id, l_partkey & 7 as radix, count(*) as n from {_L} where (l_partkey & 1048575) in (select p_partkey & 1048575 from part where p_size <= 40) group by all"),
    "radix_partition_survivors": (radix_partition_survivors, f"select row_index, l_partkey as key, l_partkey & 7 as radix from {_L} where (l_partkey & 1048575) in (select p_partkey & 1048575 from part where p_size <= 40)"),
    "radix_no_bits": (radix_no_bits, f"select row_index, l_partkey as key, cast(0 as bigint) as radix from {_L}"),
    "group_keys_wide": (group_keys_wide, "select row_index, k is null as missing, case when dense then coalesce(k - low + 1, 0) else coalesce(k + 2147483649, 0) end as group_key, dense as is_dense from (select *, min(k) over () as low, max(k) over () - min(k) over () < 1.2 * count(*) over () as dense from (select row_number() over () - 1 as row_index, case when o_custkey % 10 = 0 then null else o_orderkey * 1000 end as k from orders))"),
    "row_addresses": (row_addresses, f"select row_index, row_index // {CHUNK} as chunk_id, row_index % {CHUNK} as chunk_offset from {_L} where row_index >= {CHUNK + 100}"),
    "view_columns": (view_columns, "select column_name as name, cast(position as int) as position from (select column_name, row_number() over () - 1 as position from (describe part)) where column_name in ('p_size', 'p_partkey')"),
    "agg_registered": (agg_registered, f"select l_partkey, cast(sum({_Q} * {_Q}) as bigint) as squares from lineitem group by l_partkey"),
    "workload_results": (workload_results, _RESULTS),
    "csv_roundtrip": (csv_roundtrip, "select l_partkey, l_quantity from lineitem"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
