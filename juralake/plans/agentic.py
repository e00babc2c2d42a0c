"""Iterative retrieval: rounds of search and judgement over all queries that still want more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juralake.operators.fusion import reciprocal_rank_fusion, with_sources
from juralake.session import materialise

#: Rounds at most, and the relevance that ends them.
ROUNDS, ENOUGH = 3, 0.6


def agentic_search(queries: DataFrame, search: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame, DataFrame], DataFrame], n: int = 8, rounds: int = ROUNDS, enough: float = ENOUGH) -> tuple[DataFrame, DataFrame]:
    """The fused results and the history of every query.

    ``queries`` has (query_id, query, planned ARRAY<STRING>). ``search`` turns (query_id, query) into (query_id, rank, document), ``judge``
    active queries and their results into (query_id, relevance, sufficient, next_query). A query stops when judged sufficient or
    relevant enough, or when neither the judge nor its plan gives a next query. Rounds are bounded; each runs as one batch and
    is written to the shared folder.

    Results: (id, query_id, key, rrf_score, place, lists_found, labels_found); history: (query_id, round, query, relevance).
    """
    active = queries.select("query_id", "query", "planned")
    lists, history = None, None
    for r in range(rounds):
        active = materialise(active, "active")
        found = search(active.select("query_id", "query"))
        one = materialise(found.join(active.select("query_id", F.col("query").alias("asked")), "query_id").select("query_id", F.lit(r).alias("list_no"), (F.col("rank") - 1).alias("rank"), "document", "asked"), "round")
        lists = one if lists is None else lists.unionByName(one)
        judged = active.join(judge(active, one), "query_id", "left")
        told = judged.select("query_id", F.lit(r).alias("round"), "query", F.coalesce("relevance", F.lit(0.5)).alias("relevance"))
        history = told if history is None else history.unionByName(told)
        follow = F.coalesce(F.nullif("next_query", F.lit("")), F.get("planned", F.lit(r + 1)))
        more = ~F.coalesce("sufficient", F.lit(True)) & (F.coalesce("relevance", F.lit(0.5)) < enough) & follow.isNotNull()
        active = judged.where(more).select("query_id", follow.alias("query"), "planned")
    fused = reciprocal_rank_fusion(lists, key_chars=200, limit=n, pass_single=False)
    results = with_sources(lists, fused, "query_id", "list_no", "asked", "document", 200)
    return results.withColumn("id", F.concat(F.lit("agentic_"), F.col("place") - 1)), history
