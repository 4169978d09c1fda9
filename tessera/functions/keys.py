"""Column expressions of the join and grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a chunk, bits of the membership filter, offset of sparse keys (1 - least int).
CHUNK_ROWS = 65536
FILTER_BITS = 20
SPARSE_OFFSET = 2147483649


def require_integral(df: DataFrame, *names: str) -> None:
    """Raise TypeError unless the columns are of an integral type: keys are used bit by bit."""
    for name in names:
        if not isinstance(df.schema[name].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
            raise TypeError(f"{name} is no integral column")


def low_bits(key: Column, bits: int) -> Column:
    """The key's low bits (two's complement), 0 for no bits."""
    return key.cast("long").bitwiseAND(F.lit((1 << bits) - 1))


def filter_slot(key: Column) -> Column:
    """The key's place in the membership filter."""
    return low_bits(key, FILTER_BITS)


def chunk_id(row: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(row / F.lit(chunk_rows)).cast("long")


def chunk_offset(row: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.pmod(row, F.lit(chunk_rows)).cast("long")


def row_address(row: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    """struct<chunk_id, chunk_offset>, ordered like the row index."""
    return F.struct(chunk_id(row, chunk_rows).alias("chunk_id"), chunk_offset(row, chunk_rows).alias("chunk_offset"))


def sparse_group_key(value: Column) -> Column:
    """A non-zero key for every value, 0 for null."""
    return F.coalesce(value.cast("long") + F.lit(SPARSE_OFFSET), F.lit(0).cast("long"))
