"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Quality rules drop what they reject; of each group of near copies the document with the least key
stays; personal data is masked; sources are repeated towards their target weights; what results is
packed into sequences. All but the last return the columns of ``documents``.

Defined cases: a null or empty text fails the quality rules; rows with a null key pass the stages as
documents of their own; rows that repeat a key are one document in the second stage: its texts stay or go
together, and of rows that repeat key and text the one with the least other columns stays; a null source is
a source of its own; further columns, whatever their names, are carried up to packing; empty tables pass
through. Scratch tables of a stage are deleted once its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, pii, quality_rules
from tessera.llm.common import Scratch, read_table, scratches

END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trained verdict keep."""
    return quality_rules.keep_passing(docs, quality_rules.fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links of 80 % or more: the one with the least key."""
    scratch = Scratch(spark, "near-duplicates")
    found = jaccard.jaccard_components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("n"))
    stay = scratch.keep(found.where("doc_id = least").select("doc_id", "n"), "stay")
    scratch.release()
    # the texts are dealt by key at every size: few keys that are broadcast say nothing of the disk that many take
    kept = docs.join(stay.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    again = stay.where("n > 1").select("doc_id")
    if again.first() is not None:
        single = kept.join(again, "doc_id", "left_anti")
        kept = single.select(*docs.columns).union(once(kept.join(again, "doc_id", "left_semi").select(*docs.columns)))
    return kept.union(docs.where("doc_id is null"))


def once(rows: DataFrame) -> DataFrame:
    """Of rows that repeat doc_id and text the one with the least other columns, in their order."""
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    if not others:
        return rows.distinct()
    least = rows.groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])).alias("least of others"))
    return least.select(*[F.col(f"`least of others`.c{others.index(c)}").alias(c) if c in others else F.col(c) for c in rows.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redact(docs, pii.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards their sources' weights, in shuffled order."""
    return mixing.replicate(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: The trained stages have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratches():
            docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.only(docs)
        scratch.release()
    return STAGES[-1][1](spark, docs, sf_dir)
