"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson-distributed number of times whose mean is its source's target
repetition rate: target share times target rows over the source's rows. The draw inverts the
distribution at a number in [0, 1) that a hash of seed and key fixes, so a rerun repeats it and rows
need no state. Copies are then put in the order of a hash of seed, key and copy number.

DataFrame functions only. The source table (one row a source, as long as its distribution) is broadcast
up to a checked size. The shuffle key is uniform, so its leading bits deal the copies over partitions in
order: nothing is sampled, and rows are read and drawn once.

Defined cases: a null source is a source of its own; a null key draws as the empty key; rows that
repeat a key draw the same number; sources that the weights do not name get ``other_weight``; sources
with weight 0 leave; an empty table gives no rows. Columns of the input keep their names: a name that the
operator adds gets underscores before it where the input has it already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name

#: Without given weights a source's share follows its rows to this power, so large sources weigh less.
EXPONENT = 0.5
#: Probabilities of all sources together that are broadcast at most (8 bytes each); more are joined by shuffle.
BROADCAST_STEPS = 1_000_000


def unit_hash(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 48 bits of the md5 of the parts joined with '|'."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def last_count(rate: Column) -> Column:
    """The largest number of copies that is told apart; what lies beyond is below the hash's resolution."""
    return F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """Cumulated probabilities of 0, 1, 2, ..."""
    last = last_count(rate)
    start = F.struct(F.lit(0.0).alias("log_ratio"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log_ratio = acc["log_ratio"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["total"] + F.exp(log_ratio - rate)
        return F.struct(log_ratio.alias("log_ratio"), total.alias("total"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]).otherwise(F.array(F.lit(1.0)))


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, other_weight: float = 0.0) -> DataFrame:
    """(source, rate) for each source.

    ``weights`` are target shares by source in any unit; without them the shares are rows to the power
    ``EXPONENT``. ``rows`` is the expected size of the result, the input's size if None.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(EXPONENT))
    else:
        weight = F.lit(float(other_weight))
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    weighed = counts.withColumn("weight", weight)
    all_rows, total = weighed.agg(F.sum("n"), F.sum("weight")).first()
    if not total:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    return weighed.select("source", (F.lit(float(all_rows if rows is None else rows)) * F.col("weight") / F.lit(float(total)) / F.col("n")).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, other_weight: float = 0.0, seed: int = 1) -> DataFrame:
    """All copies of all documents in shuffled order, with ``copy_no`` (from 1) and ``shuffle_key``."""
    source, cdf, u, n, part, copy_no, shuffle_key = (free_name(docs.columns, x) for x in ("_mix_source", "_mix_cdf", "_mix_u", "_mix_n", "_mix_part", "copy_no", "shuffle_key"))
    rates = target_rates(docs, weights, rows, other_weight)
    steps = rates.select(F.col("source").alias(source), poisson_cdf(F.col("rate")).alias(cdf))
    if (rates.agg(F.sum(last_count(F.col("rate")) + 1)).first()[0] or 0) <= BROADCAST_STEPS:
        steps = F.broadcast(steps)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    times = F.size(F.filter(F.col(cdf), lambda c: c < F.col(u)))
    counted = docs.join(steps, docs["source"].eqNullSafe(F.col(source))).withColumn(u, unit_hash(F.lit(f"draw {seed}"), key)).withColumn(n, times).where(F.col(n) > 0)
    copies = counted.withColumn(copy_no, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(source, cdf, u, n)
    shuffled = copies.withColumn(shuffle_key, F.md5(F.concat_ws("|", F.lit(f"order {seed}"), key, F.col(copy_no).cast("string"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring(shuffle_key, 1, 8), 16, 10).cast("double") * parts / float(1 << 32)).cast("int")
    return shuffled.withColumn(part, place).repartitionById(parts, part).sortWithinPartitions(shuffle_key, "doc_id").drop(part)


#: The draw and the order of ``replicate`` with its defaults over ``documents``.
SQL = """
with counts as (select source, count(*) as n, pow(cast(count(*) as double), 0.5) as weight from documents group by source),
rates as (select source, (select cast(count(*) as double) from documents) * weight / (select sum(weight) from counts) / n as rate from counts),
draws as (
  select documents.*, rate,
    (cast(cast('0x' || substr(md5('draw 1|' || coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) as double) + 0.5) / 281474976710656.0 as u
  from documents join rates on documents.source is not distinct from rates.source
), cdf as (
  select rates.source, k.k, sum(exp(k.k * ln(rate) - rate - lgamma(k.k + 1))) over (partition by rates.source order by k.k) as total
  from rates, lateral (select unnest(range(0, cast(ceil(rate + 10 * sqrt(rate) + 20) as bigint))) as k) k
), counted as (
  select doc_id, text, lang, source, n_chars, (select count(*) from cdf where cdf.source is not distinct from draws.source and cdf.total < draws.u) as times
  from draws
)
select doc_id, text, lang, source, n_chars, cast(copy_no as int) as copy_no,
  md5('order 1|' || coalesce(cast(doc_id as varchar), '') || '|' || cast(copy_no as varchar)) as shuffle_key
from (select *, unnest(range(1, times + 1)) as copy_no from counted where times > 0)
"""
