"""Bounded samples of labelled rows, chosen by a hash of the id: the same rows on every run and at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def sample(labels: DataFrame, label: str, most: int, wanted: Column, doc_id: str = "doc_id") -> DataFrame:
    """At most `most` labelled ids (doc_id, label, turn) in hash order; among several labels of one id the largest counts."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & wanted)
    turn = F.xxhash64(F.lit(7), F.col(doc_id))
    return (rows.groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
            .withColumn("turn", turn).orderBy("turn", doc_id).limit(most))
