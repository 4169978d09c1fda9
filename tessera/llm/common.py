"""What several operators share: tables, shared scratch folders, Arrow helpers and 64-bit hashing."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until none of ``columns`` has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Scratch folders of each open ``scratches`` block, innermost last.
_blocks: list[list[Scratch]] = []


@contextmanager
def scratches() -> Iterator[None]:
    """Delete the scratch folders that operators made inside the block at its end: what they returned must
    have been written or collected by then."""
    _blocks.append([])
    try:
        yield
    finally:
        for made in _blocks.pop():
            made.close()


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor rereads them.

    Results of operators read them, so they stay until ``close`` or the end of a ``scratches`` block.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}", 0
        self.made: list[tuple[DataFrame, str]] = []
        if _blocks:
            _blocks[-1].append(self)

    def close(self) -> None:
        """Delete the whole folder."""
        self._delete(self.root)
        self.made = []

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again."""
        df.write.option("compression", "zstd").parquet(path := self.path(name))
        self.made.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.made[-1][0]

    def release(self) -> None:
        """Let Spark delete the shuffle files of steps whose results are kept: it does so when the
        driver's garbage collector finds their plans unused, which may be long after."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        for path in [p for f, p in self.made if f is df]:
            self._delete(path)
        self.made = [(f, p) for f, p in self.made if f is not df]

    def only(self, *kept: DataFrame) -> None:
        """Delete all kept tables but these."""
        for df in [f for f, _ in self.made if not any(f is k for k in kept)]:
            self.drop(df)


def texts(column: pa.Array) -> list[str]:
    """A string column as Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8_000_000, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text at most (one row at least)."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            ends = np.cumsum(size[at : at + rows])
            n = max(1, int(np.searchsorted(ends, most, side="right")))
            yield batch.slice(at, n)
            at += n


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer over uint64 values."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def arrow_schema(ddl_fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in ddl_fields])
