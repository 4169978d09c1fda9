"""Views by row id: a frozen list of a table version's rows, resolved by join when read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import CHUNK_ROWS, chunk_id


@dataclass(frozen=True)
class View:
    """Row ids of ``source``; rows that the table gets later are not in it."""

    source: DataFrame
    row_ids: DataFrame

    def column_ids(self, *columns: str) -> dict[str, int]:
        """The position of each column (of all of them by default) in the source."""
        return {c: self.source.columns.index(c) for c in columns or self.source.columns}

    def read(self, *columns: str) -> DataFrame:
        """The viewed rows; a row id that is listed twice gives its row twice."""
        wanted = ["row_index", *columns] if columns else self.source.columns
        return self.row_ids.join(self.source.select(*wanted), "row_index")


def whole_table(source: DataFrame) -> View:
    """A view of all rows of ``source`` (with ``row_index``)."""
    return View(source, source.select("row_index"))


def one_chunk(source: DataFrame, chunk: int, chunk_rows: int = CHUNK_ROWS) -> View:
    """A view of the rows of one chunk."""
    return View(source, source.where(chunk_id(F.col("row_index"), chunk_rows) == chunk).select("row_index"))
