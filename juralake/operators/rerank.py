"""Late-interaction scoring and reranking of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from juralake.functions.text import lowered, words
from juralake.operators.vector import cosine


def maxsim(query: Column, sentences: Column) -> Column:
    """Struct (score, best): the largest cosine of a query vector and sentence vectors, and which sentence (from 0, the first of equals).

    A vector without length scores 0; one of another size, or with items that are NULL, NaN or infinite, none; NULL or no sentences
    give NULL. Rounded to 6 places before the best is chosen.
    """
    sound = lambda s: F.forall(s, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    each = F.transform(sentences, lambda s: F.when(F.coalesce(sound(s), F.lit(False)), F.round(cosine(query, s), 6)))

    def best(a: Column) -> Column:
        top = F.array_max(a)
        return F.when(top.isNotNull(), F.struct(top.alias("score"), (F.array_position(a, top) - 1).cast("int").alias("best")))

    return F.transform(F.array(each), best)[0]


def rescore_by_sentences(candidates: DataFrame, best_sentence: Column, similarity: Column) -> Column:
    """The late-interaction score of a candidate: its best sentence's, else 1 - similarity where that is below 1, else 0.5."""
    return F.round(F.coalesce(best_sentence, F.when(similarity < 1, 1 - similarity).otherwise(F.lit(0.5))), 4)


def reranked(candidates: DataFrame, score: Column, group: str = "query_id", original: str = "original_rank", key: str = "id", limit: int | None = None) -> DataFrame:
    """``candidates`` by ``score`` within ``group``, with rerank_score and reranked_position; equal scores keep their original order."""
    scored = candidates.withColumn("rerank_score", score)
    order = W.partitionBy(group).orderBy(F.col("rerank_score").desc_nulls_last(), original, key)
    out = scored.withColumn("reranked_position", F.row_number().over(order))
    return out.where(F.col("reranked_position") <= limit) if limit is not None else out


def lexical_overlap(query: Column, text: Column) -> Column:
    """The share of different words that a query and a text have in common, to 6 places; 0 where neither has any.

    Stands in, offline, for a model that scores pairs.
    """
    a, b = F.array_distinct(words(lowered(query))), F.array_distinct(words(lowered(text)))
    either = F.size(F.array_union(a, b))
    return F.coalesce(F.round(F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0)), 6), F.lit(0.0))
