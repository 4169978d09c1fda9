"""Grouped aggregation and the inspectable keys that groups are formed by."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import require_integral, sparse_group_key

#: The dense form is used where the keys' range is below this multiple of the rows.
DENSE_FACTOR = 1.2

#: Aggregates by name; a sum of no non-null value is NULL, counts are of non-null values.
AGGREGATES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "count": F.count, "count_distinct": F.countDistinct, "min": F.min, "max": F.max, "avg": F.avg}


def register(name: str, function: Callable[[str], Column]) -> None:
    """Add an aggregate: ``function`` maps a column's name to an aggregate expression of Spark.

    Spark keeps its state and merges partial states; built-in names cannot be replaced by other functions.
    """
    if AGGREGATES.get(name, function) is not function:
        raise ValueError(f"the aggregate {name} is there already")
    AGGREGATES[name] = function


def aggregate(table: DataFrame, group_by: Sequence[str], aggregates: Sequence[tuple[str, str, str]], first_row: str | None = None) -> DataFrame:
    """One row per group (one in all without ``group_by``); NULLs form one group.

    ``aggregates``: (name, column, output name). ``first_row``: a row id column of which each group's
    least value is returned as ``first_row_index``.
    """
    out: list[Column] = []
    for name, column, alias in aggregates:
        if name not in AGGREGATES:
            raise ValueError(f"unknown aggregate: {name}")
        out.append(AGGREGATES[name](column).alias(alias))
    if first_row:
        out.append(F.min(first_row).alias("first_row_index"))
    if not out:
        raise ValueError("no aggregate is given")
    return table.groupBy(*group_by).agg(*out)


def sparse_keys(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table with ``key_<column>``: value + 2147483649, 0 for NULL."""
    require_integral(table, *columns)
    return table.select("*", *[sparse_group_key(F.col(c)).alias(f"key_{c}") for c in columns])


def dense_keys(table: DataFrame, column: str) -> DataFrame:
    """The table with ``group_key`` and ``is_dense``.

    Where max - min < 1.2 * rows, keys are value - min + 1, so they index an array; else they are the
    sparse keys. NULL is 0 in both. The bounds are one row, joined by broadcast: nothing is collected
    in one partition.
    """
    require_integral(table, column)
    value = F.col(column).cast("long")
    span = F.max(value) - F.min(value)
    bounds = table.agg(F.min(value).alias("_low"), F.coalesce(span < F.count(F.lit(1)) * DENSE_FACTOR, F.lit(False)).alias("is_dense"))
    dense = F.coalesce(value - F.col("_low") + 1, F.lit(0).cast("long"))
    key = F.when(F.col("is_dense"), dense).otherwise(sparse_group_key(F.col(column)))
    return table.join(F.broadcast(bounds)).withColumn("group_key", key).drop("_low")
