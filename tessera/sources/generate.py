"""Seeded workload tables: a serial key column, random int, float and string columns.

Values depend on seed, column and row id only, so they are the same for any number of partitions, and
any system with md5 can make them again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the workload: rows of R and S and the range of S's keys at scale 1, bounds of the
#: further int columns of R and S, lengths of random strings.
R_ROWS, S_ROWS, S_KEYS = 159526, 6001215, 200000
R_VALUES, S_VALUES = (1, 100), (1, 50)
STRING_LENGTHS = (5, 15)

KINDS = {"int": T.IntegerType(), "float": T.FloatType(), "string": T.StringType()}


@dataclass(frozen=True)
class ColumnDef:
    """A column's kind ('int', 'float' or 'string'), its bounds, and whether it is the serial key."""

    kind: str
    serial: bool = False
    lower: float = 0
    upper: float = 0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unsupported data type: {self.kind}")
        if self.serial and self.kind != "int":
            raise ValueError("a serial key is an int column")


def table_schema(columns: Sequence[ColumnDef]) -> T.StructType:
    """Columns c0, c1, ... of the definitions' types."""
    return T.StructType([T.StructField(f"c{i}", KINDS[c.kind]) for i, c in enumerate(columns)])


def empty_table(spark: SparkSession, columns: Sequence[ColumnDef]) -> DataFrame:
    return spark.createDataFrame([], table_schema(columns))


def _hashed(*parts: Column) -> Column:
    """A number below 2^48 from the first 12 digits of the md5 of the parts joined with '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def _random_int(low: int, high: int, *parts: Column) -> Column:
    """Uniform over low..high, both included."""
    return (F.pmod(_hashed(*parts), F.lit(high - low + 1)) + low).cast("int")


def _column(definition: ColumnDef, seed: int, number: int) -> Column:
    row, own = F.col("id"), F.lit(seed * 1000 + number)
    if definition.serial:
        return (row + 1).cast("int")
    if definition.kind == "int":
        return _random_int(int(definition.lower), int(definition.upper), own, row)
    if definition.kind == "float":
        unit = _hashed(own, row).cast("double") / float(1 << 48)
        return (unit * (definition.upper - definition.lower) + definition.lower).cast("float")
    length = _random_int(*STRING_LENGTHS, own, row)
    letters = F.transform(F.sequence(F.lit(1), length), lambda i: F.char(65 + F.pmod(_hashed(own, row, i), F.lit(26))))
    return F.concat_ws("", letters)


def generate(spark: SparkSession, rows: int, columns: Sequence[ColumnDef], seed: int = 1, partitions: int | None = None) -> DataFrame:
    """``rows`` rows of the given columns (c0, c1, ...)."""
    ids = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return ids.select(*[_column(c, seed, i).alias(f"c{i}") for i, c in enumerate(columns)])


def sizes(scale: float) -> tuple[int, int, int]:
    """(rows of R, rows of S, largest key of S); products in 32-bit floats, cut to integers."""
    s = np.float32(scale)
    return tuple(int(np.float32(n) * s) for n in (R_ROWS, S_ROWS, S_KEYS))


def workload(spark: SparkSession, scale: float, value_columns: int = 0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The tables R (serial key) and S (random key), each with further int columns."""
    r_rows, s_rows, keys = sizes(scale)
    r = [ColumnDef("int", serial=True), *[ColumnDef("int", False, *R_VALUES)] * value_columns]
    s = [ColumnDef("int", False, 1, keys), *[ColumnDef("int", False, *S_VALUES)] * value_columns]
    return generate(spark, r_rows, r, seed), generate(spark, s_rows, s, seed + 1)
