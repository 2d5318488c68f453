"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, size: int, mod: int = 5, held: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most `size` labelled ids, the smallest by a hash, outside the held-out fold.

    Labels without an id or a target are passed over; of several labels of one id the largest holds.
    """
    told = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold(F.col("doc_id"), mod) != held))
    drawn = told.groupBy("doc_id").agg(F.max(F.col(target)).cast("int").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(size)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.join(F.broadcast(drawn), "doc_id")  # at most `size` rows of two numbers
