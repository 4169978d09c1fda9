"""Each micro-batch of a stream is one committed insert of a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.table import Table


def append_stream(stream: DataFrame, table: Table, staging: str) -> DataStreamWriter:
    """A writer that inserts each batch once; its rows are first written under ``staging``.

    A batch that is delivered again (after a failure) replaces its own files and is not inserted twice.
    """
    seen: set[int] = set()

    def insert(batch: DataFrame, number: int) -> None:
        path = f"{staging}/batch-{number:09d}"
        batch.write.mode("overwrite").parquet(path)
        if number not in seen:
            table.insert(batch.sparkSession.read.schema(batch.schema).parquet(path))
            seen.add(number)

    return stream.writeStream.foreachBatch(insert)
