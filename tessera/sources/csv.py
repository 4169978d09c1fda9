"""CSV output: chosen columns in the given order, no header, no quotes, floats with six decimals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project(df: DataFrame, ordinals: Sequence[int]) -> DataFrame:
    """Columns by position; order is kept and a position may repeat (its name gets a suffix)."""
    names: list[str] = []
    columns: list[Column] = []
    for i in ordinals:
        name = df.columns[i]
        n = names.count(name)
        names.append(name)
        columns.append(df[name].alias(f"{name}_{n}" if n else name))
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, ordinals: Sequence[int], order_by: str | None = None) -> None:
    """Write under ``path``, replacing what is there.

    With ``order_by`` the rows are sorted over all files: files in order of their names hold ranges in
    order, so their contents put one after the other are the sorted table, and no task writes it alone.
    """
    rows = project(df.orderBy(order_by) if order_by else df, ordinals)
    fields = [F.when(F.col(f.name).isNotNull(), F.format_string("%.6f", F.col(f.name))) if isinstance(f.dataType, T.FloatType | T.DoubleType) else F.col(f.name).cast("string") for f in rows.schema]
    rows.select(F.concat_ws(",", *[F.coalesce(x, F.lit("")) for x in fields]).alias("value")).write.mode("overwrite").text(path)


def read_csv(df_like: DataFrame, path: str) -> DataFrame:
    """Rows written by ``write_csv`` with the columns of ``df_like``."""
    return df_like.sparkSession.read.schema(df_like.schema).csv(path, header=False)
