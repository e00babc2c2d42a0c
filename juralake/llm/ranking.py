"""One ranking from several differently-scaled scores.

Per query each score is centred on its median and scaled by its median absolute deviation, squashed by a logistic curve
into (0, 1), and the bounded values are combined by a weighted geometric mean.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from juralake.operators.running import rank_by_range
from juralake.session import materialise

#: Consistency constant of the median absolute deviation for a normal distribution.
MAD_TO_SIGMA = 1.4826
#: The same for the mean absolute deviation, used where more than half of the values are equal.
MEAN_TO_SIGMA = 1.2533
#: percentile_approx keeps every value up to about this many per group: medians are exact there and bounded in memory beyond.
ACCURACY = 10_000
#: Scores beyond this may overflow where they are centred and scaled.
HUGE = 1e100


def usable(c: Column) -> Column:
    """``c`` as a double, NULL where it is NULL or NaN."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def best_item(scores: Column) -> Column:
    """The largest usable item of an array of scores; NULL for a NULL, empty or wholly unusable one."""
    return F.array_max(F.filter(scores, lambda x: x.isNotNull() & ~F.isnan(x)))


def candidates(results: DataFrame) -> DataFrame:
    """(query_id, chunk_id, original, colbert, sentence): one row per candidate.

    Rows repeated for a (query_id, chunk_id) count once, with the earliest created_at first; rows that lack either key can't
    be ranked and are left out. Extra columns are ignored.
    """
    scored = results.where("query_id IS NOT NULL AND chunk_id IS NOT NULL").select(
        "query_id", "chunk_id",
        F.struct(
            F.col("created_at"), usable(F.col("original_score")).alias("original"), usable(F.col("colbert_score")).alias("colbert"),
            best_item(F.col("sentence_scores")).alias("sentence"),
        ).alias("s"),
    )
    return scored.groupBy("query_id", "chunk_id").agg(F.min("s").alias("s")).select("query_id", "chunk_id", "s.original", "s.colbert", "s.sentence")


def bounded_scores(df: DataFrame, group: str, scores: Sequence[str]) -> DataFrame:
    """``df`` with ``<score>_bounded`` in (0, 1): the logistic of the robust z of each score within its group.

    The scale is 1.4826 MAD; if that is 0, 1.2533 times the mean absolute deviation; if all values are equal, every value
    gets 0.5. NULL stays NULL. Medians come from mergeable summaries, aggregated before the shuffle, so a group that holds a
    third of all rows is never gathered; the two joins back are left to adaptive execution, which splits hot keys.
    """
    med = df.groupBy(group).agg(*(F.percentile_approx(s, 0.5, ACCURACY).alias(f"{s}_med") for s in scores))
    centred = df.join(med, group)
    away = {s: F.abs(F.col(s) - F.col(f"{s}_med")) for s in scores}
    spread = centred.groupBy(group).agg(
        *(F.percentile_approx(away[s], 0.5, ACCURACY).alias(f"{s}_mad") for s in scores),
        *(F.avg(away[s]).alias(f"{s}_dev") for s in scores),
        *(F.max(f"{s}_med").alias(f"{s}_med") for s in scores),
    )
    out = df.join(spread, group)
    for s in scores:
        scale = F.when(F.col(f"{s}_mad") > 0, F.col(f"{s}_mad") * MAD_TO_SIGMA).when(F.col(f"{s}_dev") > 0, F.col(f"{s}_dev") * MEAN_TO_SIGMA)
        z = F.coalesce((F.col(s) - F.col(f"{s}_med")) / scale, F.when(F.col(s).isNotNull(), F.lit(0.0)))
        squashed = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))
        out = out.withColumn(f"{s}_bounded", F.when(z.isNotNull(), squashed))  # least and greatest pass over NULL
    return out.drop(*(f"{s}_{x}" for s in scores for x in ("med", "mad", "dev")))


def fuse(bounded: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``bounded`` with ``fused``: the weighted geometric mean of the bounded scores that a row has.

    Weights of missing scores are shared out over the others; a row without any score has NULL. Rounded to 10 places.
    """
    held = sum((F.when(F.col(f"{s}_bounded").isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for s, w in weights.items()), F.lit(0.0))
    logs = sum((F.coalesce(F.ln(f"{s}_bounded") * float(w), F.lit(0.0)) for s, w in weights.items()), F.lit(0.0))
    return bounded.withColumn("fused", F.when(held > 0, F.round(F.exp(logs / held), 10)))


def ranked(fused: DataFrame, group: str, key: str) -> DataFrame:
    """``fused`` with ``place``: 1 for the best of its group; ties by ``key``, rows without a score last.

    Ranked by ranges of (group, score, key), so a hot group, or any number of equal scores in it, is spread over tasks.
    """
    score = F.coalesce("fused", F.lit(-1.0))
    return rank_by_range(fused, [group], [score.desc(), F.col(key)], "place")


def leading(ranking: DataFrame, group: str, scores: Sequence[str], k: int) -> DataFrame:
    """Rows of a ranking, high enough in it to be among their group's ``k`` best in every one of ``scores``; a row that lacks a score isn't.

    A row that comes before another, with all scores and not just equal, is better in one of them, and only k - 1 are in each. So
    what is among the best in every score has a fused score no lower than the row at place (k - 1) * scores + 1 of those with all.
    Bounding keeps the order of scores but of infinite ones: rows with scores beyond HUGE neither count for that place nor are left out.
    """
    every = ranking.where(" AND ".join(f"{s} IS NOT NULL" for s in scores))
    tame = F.greatest(*(F.abs(s) for s in scores)) <= HUGE
    last = (k - 1) * len(scores) + 1
    counted = every.where(tame).select(group, "fused", F.row_number().over(W.partitionBy(group).orderBy("place")).alias("r"))
    least = counted.where(F.col("r") <= last).groupBy(group).agg(F.min(F.when(F.col("r") == last, F.col("fused"))).alias("least"))
    return every.join(least, group, "left").where(~tame | F.col("least").isNull() | (F.col("fused") >= F.col("least"))).drop("least")


def best_in_each(cands: DataFrame, group: str, key: str, scores: Sequence[str], k: int, among: DataFrame | None = None) -> DataFrame:
    """Rows (of ``among``, if given) among their group's ``k`` best in every one of ``scores``; a row that lacks a score isn't among them.

    Equal scores share a rank. Each rank is cut at k, so Spark limits every group before it shuffles.
    """
    out = cands if among is None else among
    for s in scores:
        w = W.partitionBy(group).orderBy(F.col(s).desc())
        top = cands.where(F.col(s).isNotNull()).select(group, key, F.rank().over(w).alias("r")).where(F.col("r") <= k)
        out = out.join(top.select(group, key), [group, key], "left_semi")
    return out


#: Weights of the three scores in the ranking.
WEIGHTS = {"original": 1.0, "colbert": 1.0, "sentence": 1.0}


def one_ranking(results: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """The ranking of every query's candidates: raw and bounded scores, fused score and place."""
    bounded = bounded_scores(candidates(results), "query_id", list(weights))
    return ranked(materialise(fuse(bounded, weights), "fused"), "query_id", "chunk_id")
