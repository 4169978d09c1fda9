"""A bounded, documented sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, where: Column | None = None, known_texts: DataFrame | None = None) -> DataFrame:
    """(text, label) of at most ``per_class`` different texts of each label.

    Equal texts count once, with their majority label (1 on a tie). Texts are taken in the order of a
    hash, so the sample is spread over the table and the same on every run. ``where`` limits the label
    rows by their doc_id; ``known_texts`` has (doc_id, text_hash) of the rows of ``docs`` that may be taken, all
    with a text by default. Rows with a null key, text or label take no part.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where("doc_id is not null and label is not null")
    if where is not None:
        known = known.where(where)
    hashed = known_texts
    if hashed is None:
        hashed = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    kinds = known.join(hashed, "doc_id").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), (F.avg("label") >= 0.5).cast("int").alias("label"))
    order = F.xxhash64("text_hash", F.lit(17))
    chosen = [kinds.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class).select("doc_id", "label") for k in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id").select("doc_id", "text", "label")
