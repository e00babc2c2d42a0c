"""Ranks and running sums within groups of any size.

A window over a group puts the group into one task. Here a group is cut into buckets that follow its order; each bucket
is summed on its own, bucket totals (few) are accumulated, and both parts are added, so that no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from juralake.session import materialise


def running_sum(df: DataFrame, group: Sequence[str], bucket: Sequence[Column], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``group`` up to and with this row.

    ``bucket`` columns must be non-decreasing along ``order``; ``order`` must be unique within a group for a stable result.
    """
    b = [f"__b{i}" for i in range(len(bucket))]
    cut = df.withColumns({n: c for n, c in zip(b, bucket, strict=True)} | {"__v": value})
    keys = [*group, *b]
    before = W.partitionBy(*group).orderBy(*b).rowsBetween(W.unboundedPreceding, -1)
    totals = (
        cut.groupBy(*keys).agg(F.sum("__v").alias("__t"))
        .withColumn("__before", F.coalesce(F.sum("__t").over(before), F.lit(0)))
        .select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__before")
    )
    same = None
    for i, k in enumerate(keys):
        eq = cut[k].eqNullSafe(F.col(f"__k{i}"))
        same = eq if same is None else same & eq
    inside = F.sum("__v").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (
        cut.withColumn("__in", inside).join(totals, same, "inner")
        .withColumn(name, F.col("__in") + F.col("__before"))
        .drop("__v", "__in", "__before", *b, *(f"__k{i}" for i in range(len(keys))))
    )


def running_rank(df: DataFrame, group: Sequence[str], bucket: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place in its group along ``order``, from 1."""
    return running_sum(df, group, bucket, order, F.lit(1).cast("bigint"), name)


def rank_by_range(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place in its group along ``order``, from 1, however many rows of a group are equal in part of it.

    Rows are dealt out over the session's shuffle partitions by ranges of (group, order), as Spark samples them, and written
    to the shared folder with the number of their range; ranges are ranked on their own, and their totals, a row per group
    and range, are added up. ``order`` must be unique within a group; the sampling reads ``df`` twice.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *group, *order).withColumn("__r", F.spark_partition_id()), "ranges")
    keys = [*group, "__r"]
    before = W.partitionBy(*group).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = dealt.withColumn("__in", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return inside.join(totals, keys).withColumn(name, F.col("__in") + F.col("__before")).drop("__r", "__in", "__before")
