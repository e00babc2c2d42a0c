"""Retrieval pipelines as one lazy plan for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from juralake.functions import text
from juralake.functions.classify import should_decompose
from juralake.functions.extract import json_array_in
from juralake.operators import fusion, lexical, rerank, vector
from juralake.plans import providers

#: Keywords a query is searched by, hits of each, and candidates that are reranked.
PROBES, HITS, RERANKED = 3, 10, 30


def query_dataset(chunks: DataFrame, queries: DataFrame, n: int = 5, hybrid: bool = True, reranking: bool = True, conditions: Sequence[Mapping[str, str]] | None = None, metadata: Mapping[str, Column] | None = None, threshold: float = 0.0, legacy_untruncated: bool = False, within: str | None = None) -> DataFrame:
    """(query_id, place, id, origin, similarity, rerank_score): the results of every query.

    ``chunks`` has (id, content, embedding), one row per id, ``queries`` (query_id, query, embedding). With conditions: a filtered vector
    search alone. ``within`` names a column of both, such as collection_id, in which vector hits must agree with their query.
    Hybrid: 3 n vector hits (30 at most), then keyword hits that they lack; reranked by pair scores if there are more than n.
    Truncated to n unless ``legacy_untruncated`` keeps unreranked hybrid results whole. Keyword hits have no similarity.
    """
    base = chunks.where(vector.matches_conditions(metadata or {}, conditions)) if conditions is not None else chunks
    wide = hybrid and conditions is None
    hits = vector.search(base, queries, k=min(3 * n, 30) if wide else n, threshold=threshold, within=within)
    merged = hits.select("query_id", "id", "rank", "similarity")
    if not wide:
        return merged.select("query_id", F.col("rank").alias("place"), "id", F.lit(1).alias("origin"), "similarity", F.lit(None).cast("double").alias("rerank_score"))
    keyed = queries.select("query_id", F.posexplode(text.keywords(F.col("query"), PROBES)).alias("pos", "keyword"))
    found = keyed.join(lexical.contains_keywords(chunks, keyed, hits=HITS), "keyword").groupBy("query_id", "id").agg(F.min("pos").alias("rank"))
    merged = fusion.keep_first_union(merged, found.select("query_id", "id", "rank", F.lit(None).cast("double").alias("similarity")), ["query_id", "id"])
    order = W.partitionBy("query_id").orderBy("origin", "rank", "id")
    merged = merged.withColumn("original_rank", F.row_number().over(order))
    if not reranking:
        cut = merged if legacy_untruncated else merged.where(F.col("original_rank") <= n)
        return cut.select("query_id", F.col("original_rank").alias("place"), "id", "origin", "similarity", F.lit(None).cast("double").alias("rerank_score"))
    held = merged.where(F.col("original_rank") <= RERANKED).join(chunks.select("id", "content"), "id").join(queries.select("query_id", "query"), "query_id")
    many = held.join(merged.groupBy("query_id").agg(F.max("original_rank").alias("__n")), "query_id")
    score = F.when(F.col("__n") > n, rerank.lexical_overlap(F.col("query"), F.col("content")))
    out = rerank.reranked(many, score, limit=n)
    return out.select("query_id", F.col("reranked_position").alias("place"), "id", "origin", "similarity", "rerank_score")


def colbert_search(chunks: DataFrame, queries: DataFrame, n: int = 8, candidates: int = 20) -> DataFrame:
    """(query_id, place, id, colbert_score, best_sentence, match): vector candidates by their best sentence.

    ``chunks`` has sentence_embeddings and sentence_texts beside (id, embedding), one row per id; a chunk without usable ones falls
    back on its similarity, and one that ``chunks`` lacks altogether has nothing but that. match is the first 100 characters of the best sentence.
    """
    hits = vector.search(chunks, queries, k=candidates).withColumnRenamed("rank", "original_rank")
    both = hits.join(chunks.select("id", "sentence_embeddings", "sentence_texts"), "id", "left").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    scored = both.withColumn("m", rerank.maxsim(F.col("q"), F.col("sentence_embeddings")))
    six = lambda c: F.col(c).cast("decimal(9,6)")  # noqa: E731 - the places that both have
    ranked = rerank.reranked(scored, rerank.rescore_by_sentences(scored, six("m.score"), six("similarity")).cast("double"), limit=n)
    return ranked.select("query_id", F.col("reranked_position").alias("place"), "id", F.col("rerank_score").alias("colbert_score"), F.col("m.best").alias("best_sentence"), F.substring(F.get("sentence_texts", F.col("m.best")), 1, 100).alias("match"))


def decomposed(queries: DataFrame, make: Callable[[], providers.Completer], most: int = 4) -> DataFrame:
    """(query_id, part, query): the parts of queries worth decomposing, as a model gives them, ``most`` at most; others whole."""
    asked = queries.select("query_id", "query", F.when(should_decompose(F.col("query")), F.col("query")).alias("__ask"))
    replied = providers.completed(asked, "__ask", make, "__reply")
    parts = F.when(F.col("__reply").isNotNull(), F.slice(json_array_in(F.col("__reply"), F.col("query")), 1, most)).otherwise(F.array("query"))
    return replied.select("query_id", F.posexplode(parts).alias("part", "query"))


def decomposed_search(chunks: DataFrame, queries: DataFrame, make_completer: Callable[[], providers.Completer], search: Callable[[DataFrame], DataFrame], n: int = 10) -> DataFrame:
    """(query_id, place, key, rrf_score): results of all parts of each query in one fused ranking.

    ``search`` turns (query_id, query) into (query_id, rank, id); it gets each part with a name of its own as query_id. The texts of
    ``chunks`` (id, content) are what is fused; the results of a query that stays whole pass through without a score.
    """
    parts = decomposed(queries, make_completer).withColumn("__k", F.struct("query_id", "part"))
    kind = parts.schema["__k"].dataType
    hits = search(parts.select(F.to_json("__k").alias("query_id"), "query")).withColumn("k", F.from_json("query_id", kind))
    lists = hits.join(chunks.select("id", "content"), "id").select("k.query_id", F.col("k.part").alias("list_no"), (F.col("rank") - 1).alias("rank"), F.col("content").alias("document"))
    return fusion.reciprocal_rank_fusion(lists, limit=n).select("query_id", "place", "key", "rrf_score")


def vector_of(chunks: DataFrame, make: Callable[[], providers.Embedder], k: int = 10) -> Callable[[DataFrame], DataFrame]:
    """A search for ``decomposed_search`` and the like: queries are embedded and compared with ``chunks`` (id, embedding)."""
    return lambda queries: vector.search(chunks, providers.embedded(queries, "query", make, task="query"), k=k)


def embedding_rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, first: int = 20, n: int = 5) -> DataFrame:
    """(query_id, id, original_rank, rerank_score, reranked_position): the ``first`` candidates of each query by the cosine of vectors.

    ``candidates`` has (query_id, id, rank), ``vectors`` (id, embedding), ``queries`` (query_id, embedding). Stands in where no model scores
    pairs. A candidate whose vector or query is missing or of another size has no score and comes last.
    """
    held = candidates.where(F.col("rank") <= first).join(vectors.select("id", "embedding"), "id", "left").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id", "left")
    scored = held.withColumn("s", F.round(vector.cosine(F.col("q"), F.col("embedding")), 6))
    out = rerank.reranked(scored, F.col("s"), original="rank", limit=n)
    return out.select("query_id", "id", F.col("rank").alias("original_rank"), "rerank_score", "reranked_position")


def context(results: DataFrame, source: str = "source", body: str = "content") -> DataFrame:
    """(query_id, context): each query's results in order under their sources; results are few per query."""
    one = F.concat(F.lit("[Source: "), F.coalesce(F.col(source), F.lit("unknown")), F.lit("]\n"), F.col(body))
    rows = F.array_sort(F.collect_list(F.struct("place", one.alias("t"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n---\n\n").alias("context"))
