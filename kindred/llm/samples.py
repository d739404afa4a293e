"""Bounded samples of labelled rows for training. The bound is the only thing here that doesn't grow with the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import frugal


def labelled(docs: DataFrame, labels: DataFrame, label: Column, columns: list[str], per_class: int) -> DataFrame:
    """(doc_id, text, *columns of labels) of at most per_class rows with label 0 and as many with 1, taken in order of a hash of doc_id."""
    rows = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.col(c).cast("int")).alias(c) for c in columns))
    parts = [rows.where(label == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    picked = reduce(DataFrame.unionByName, parts)
    texts = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # Two bounded lists of ids and labels: the broadcast holds at most 2 * per_class rows.
    return texts.join(F.broadcast(picked), "doc_id")
