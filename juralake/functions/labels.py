"""Resolving dirty labels by an alias table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is missing or not found.
UNKNOWN = "unknown"


def clean_label(c: Column) -> Column:
    """``c`` without white space at both ends, in lower case; NULL stays NULL."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def resolve(df: DataFrame, aliases: DataFrame, kind: str, raw: str, name: str) -> DataFrame:
    """``df`` with ``name``: the canonical label of column ``raw`` under ``kind``, or ``unknown``.

    The alias table (kind, raw, canonical) has unique (kind, raw), so rows are neither lost nor repeated; Spark broadcasts
    it only where its measured size is under the session's threshold.
    """
    known = aliases.where(F.col("kind") == kind).select(F.col("raw").alias("__raw"), F.col("canonical").alias("__canonical"))
    return (
        df.withColumn("__clean", clean_label(F.col(raw)))
        .join(known, F.col("__clean") == F.col("__raw"), "left")
        .withColumn(name, F.coalesce("__canonical", F.lit(UNKNOWN)))
        .drop("__clean", "__raw", "__canonical")
    )
