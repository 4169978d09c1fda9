"""Parquet tables read through Spark's own reader, with pushdown and pruning left to Catalyst.

Row ids are dense and follow file and row order: a Parquet row's index in its file plus the rows of
all files before it. They cost no shuffle; only one row per file reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "row_index"
#: Files or partitions whose first row ids are broadcast; more of them are joined as Spark decides.
BROADCAST_PARTS = 100_000


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` of a local table, with a hint to broadcast them while they are few."""
    return F.broadcast(rows) if n <= BROADCAST_PARTS else rows


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` (a file or a folder of files) under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_with_row_ids(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with a dense ``row_index`` (bigint, from 0)."""
    table = read_table(spark, sf_dir, name)
    in_file = F.col("_metadata.row_index").alias(ROW)
    files = sorted(table.inputFiles())
    if len(files) == 1:
        return table.select("*", in_file)
    counts = table.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n")).orderBy("path").collect()
    bases, total = [], 0
    for row in counts:
        bases.append((row.path, total))
        total += row.n
    base = spark.createDataFrame(bases, "path string, base long")
    rows = table.select("*", in_file, F.col("_metadata.file_path").alias("path"))
    return rows.join(_sent(base, len(bases)), "path").withColumn(ROW, F.col(ROW) + F.col("base")).drop("path", "base")


def numbered(df: DataFrame, start: int = 0) -> tuple[DataFrame, int]:
    """(``df`` with a dense ``row_index`` from ``start`` in its partition order, number of its rows).

    Partitions are counted first (one row per partition reaches the driver), so ``df`` must give the
    same rows in the same partitions when it is run again.
    """
    local = F.monotonically_increasing_id()
    parted = df.withColumn("_part", F.shiftright(local, 33)).withColumn("_at", local.bitwiseAND((1 << 33) - 1))
    bases, total = [], start
    for row in parted.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        bases.append((row["_part"], total))
        total += row.n
    base = df.sparkSession.createDataFrame(bases, "_part long, _base long")
    rows = parted.join(_sent(base, len(bases)), "_part").withColumn(ROW, F.col("_at") + F.col("_base")).select(*df.columns, ROW)
    return rows, total - start


def dense_row_ids(df: DataFrame, start: int = 0) -> DataFrame:
    """``df`` with a dense ``row_index`` from ``start`` in its partition order; see ``numbered``."""
    return numbered(df, start)[0]
