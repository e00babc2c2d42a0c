"""Merging ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reciprocal_rank_fusion(lists: DataFrame, group: str = "query_id", item: str = "list_no", rank: str = "rank", text: str = "document", key_chars: int = 500, limit: int = 10, constant: int = 60, pass_single: bool = True) -> DataFrame:
    """(group, key, rrf_score, first_list, first_rank, place): fused ranks of the texts of each group's lists.

    ``pass_single`` is off for rounds of one search, where a single round is fused like any number. A text is known by its first ``key_chars`` characters. Each occurrence, at 0-based ``rank``, adds 1 / (constant + rank + 1), also
    a repeated one of the same list. Ties go by where a text is first seen: list, then rank. Scores are rounded to 10 places.
    NULL texts are one key ''. A group that has a single list keeps that list's order, repeats too, and has no score. Occurrences
    are pre-aggregated before the shuffle; groups are cut at ``limit`` before theirs.
    """
    key = F.substring(F.coalesce(F.col(text), F.lit("")), 1, key_chars)
    seen = lists.select(F.col(group), key.alias("key"), F.struct(F.col(item).alias("l"), F.col(rank).alias("r")).alias("at"), (1 / (F.lit(constant + 1.0) + F.col(rank))).alias("part"))
    fused = seen.groupBy(group, "key").agg(F.round(F.sum("part"), 10).alias("rrf_score"), F.min("at").alias("at"))
    order = W.partitionBy(group).orderBy(F.col("rrf_score").desc(), "at.l", "at.r", "key")
    several = (
        fused.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
        .select(group, "key", "rrf_score", F.col("at.l").alias("first_list"), F.col("at.r").alias("first_rank"), "place")
    )
    if not pass_single:
        return several
    lone = lists.groupBy(group).agg(F.min(item).alias("__least"), F.max(item).alias("__most")).where("__least = __most").select(group)
    along = W.partitionBy(group).orderBy("first_rank", "key")
    own = lists.join(lone, group, "left_semi").select(F.col(group), key.alias("key"), F.col(item).alias("first_list"), F.col(rank).alias("first_rank"))
    own = own.withColumn("place", F.row_number().over(along)).where(F.col("place") <= limit)
    return several.join(lone, group, "left_anti").unionByName(own.select(group, "key", F.lit(None).cast("double").alias("rrf_score"), "first_list", "first_rank", "place"))


def with_sources(lists: DataFrame, fused: DataFrame, group: str, item: str, label: str, text: str, key_chars: int) -> DataFrame:
    """``fused`` with ``lists_found`` and ``labels_found``: which lists, and which labels (queries), a text was found by, as first seen."""
    key = F.substring(F.coalesce(F.col(text), F.lit("")), 1, key_chars)
    each = lists.select(F.col(group), key.alias("key"), F.col(item).alias("l"), F.col(label).alias("q")).distinct()
    sources = each.groupBy(group, "key").agg(F.array_sort(F.collect_set(F.struct("l", "q"))).alias("s"))
    joined = fused.join(sources, [group, "key"])
    text_of = lambda f: F.array_join(F.array_distinct(F.transform("s", lambda x: x[f].cast("string"))), ",")
    return joined.select(*fused.columns, text_of("l").alias("lists_found"), text_of("q").alias("labels_found"))


def keep_first_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``first``, then those of ``second`` whose ``keys`` it lacks; ``origin`` is 1 or 2. NULL keys match nothing."""
    rest = second.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.withColumn("origin", F.lit(1)).unionByName(rest.withColumn("origin", F.lit(2)))


def positional(df: DataFrame, *arrays: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and a row per place of ``arrays``, which stand side by side; shorter or NULL ones have NULL there. ``pos`` is the place, from 0.

    Rows whose arrays are all NULL or empty give nothing.
    """
    zipped = F.arrays_zip(*(F.coalesce(F.col(a), F.array().cast(df.schema[a].dataType)).alias(a) for a in arrays))
    return df.select(*keep, F.posexplode(zipped).alias("pos", "__z")).select(*keep, "pos", *(F.col(f"__z.{a}").alias(a) for a in arrays))


def result_stats(results: DataFrame, group: str, score: str, vectors: str) -> DataFrame:
    """(group, results, avg_score, with_vectors): how many results each query has, their mean score to 6 places, and how many have ``vectors``."""
    return results.groupBy(group).agg(F.count("*").alias("results"), F.round(F.avg(score), 6).alias("avg_score"), F.count_if(F.coalesce(F.size(vectors) > 0, F.lit(False))).alias("with_vectors"))
