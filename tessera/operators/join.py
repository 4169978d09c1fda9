"""Inner equi-join and its inspectable stages: keys, membership filter, radix histogram, partitions.

Each stage is a DataFrame, so Catalyst plans it; the join itself is Spark's. NULL keys never match;
the materialised keys keep them, as no filter can judge them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import CHUNK_ROWS, chunk_id, filter_slot, low_bits, require_integral

#: A filter side's slots are 2^20 at most, so their set has a fixed bound and may be broadcast.


def join_inner(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, strategy: str | None = None) -> DataFrame:
    """All pairs of rows with equal keys. ``strategy``: a join hint for the build side, e.g. 'shuffle_hash'."""
    side = build.hint(strategy) if strategy else build
    return probe.join(side, probe[probe_key] == build[build_key], "inner")


def materialize(table: DataFrame, key: str, row: str = "row_index") -> DataFrame:
    """(row_index, key) of every row, in no other order than the table's; other columns are not read."""
    return table.select(F.col(row).alias("row_index"), F.col(key).alias("key"))


def filter_slots(keys: DataFrame) -> DataFrame:
    """The slots that the keys set in the membership filter: 2^20 distinct values at most."""
    require_integral(keys, "key")
    return keys.where("key is not null").select(filter_slot(F.col("key")).alias("slot")).distinct()


def filter_by(keys: DataFrame, slots: DataFrame) -> DataFrame:
    """The keys that may be among those behind ``slots``; false positives stay, NULL keys too."""
    require_integral(keys, "key")
    marked = keys.withColumn("_slot", filter_slot(F.col("key")))
    passed = marked.where("key is not null").join(F.broadcast(slots), F.col("_slot") == F.col("slot"), "left_semi")
    return passed.union(marked.where("key is null")).drop("_slot")


def matching(keys: DataFrame, others: DataFrame) -> DataFrame:
    """The keys that are among ``others``, by the filter and then exactly; NULL keys stay."""
    passed = filter_by(keys, filter_slots(others))
    found = passed.where("key is not null").join(others.select(F.col("key").alias("_other")), F.col("key") == F.col("_other"), "left_semi")
    return found.union(passed.where("key is null"))


def materialize_sides(build: DataFrame, probe: DataFrame, build_rows: int, probe_rows: int, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides' keys, the larger filtered by the smaller; on a tie the probe side is the filter.

    With ``exact`` the filter's false positives are dropped: there are some as soon as keys reach beyond 2^20.
    """
    held = matching if exact else lambda keys, others: filter_by(keys, filter_slots(others))
    if build_rows < probe_rows:
        return build, held(probe, build)
    return held(build, probe), probe


def radix_histogram(keys: DataFrame, bits: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(chunk_id, radix, n) of the non-null keys."""
    require_integral(keys, "key")
    radix = low_bits(F.col("key"), bits).alias("radix")
    return keys.where("key is not null").groupBy(chunk_id(F.col("row_index"), chunk_rows).alias("chunk_id"), radix).agg(F.count(F.lit(1)).alias("n"))


def radix_partition(keys: DataFrame, bits: int) -> DataFrame:
    """(row_index, key, radix): non-null keys, physically placed in 2^bits partitions by their low bits.

    With no bits nothing moves.
    """
    require_integral(keys, "key")
    marked = keys.where("key is not null").withColumn("radix", low_bits(F.col("key"), bits))
    if bits == 0:
        return marked
    return marked.repartitionById(1 << bits, F.col("radix").cast("int")).sortWithinPartitions("row_index")
