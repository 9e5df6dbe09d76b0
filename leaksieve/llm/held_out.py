"""The rows that models must not learn from, and how rows of a sample are chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for a third of the ids, by the CRC-32 of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def lowest_hashes(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` rows whose doc_id hashes lowest: a sample that is the same however rows are stored."""
    return rows.withColumn("__h", F.xxhash64("doc_id")).orderBy("__h", *order).limit(n).drop("__h")
