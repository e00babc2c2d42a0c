"""Building an index: documents to chunks with contexts, vectors of the chunks in context, and the rows to store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juralake.functions import extract, text
from juralake.operators import chunking, rerank, vector
from juralake.plans import providers
from juralake.sources.elements import merged_metadata


def chunks_in_context(docs: DataFrame, key: str, title: str, body: str, most: int = 256, overlap: int = 50, least: int = chunking.LEAST_TOKENS) -> DataFrame:
    """(key, title, chunk_index, type, token_count, chunk, text_with_context): chunks to index, of ``least`` tokens or more.

    The context tells a chunk's document and what it refers to; it is for the vector alone, the chunk is what is stored.
    """
    named = docs.select(key, title)
    cut = chunking.structured_chunks(docs, key, body, most, overlap).where(F.col("token_count") >= least).join(named, key)
    c = F.col("chunk")
    none = F.lit(None).cast("string")
    prefix = extract.context_prefix(F.col(title), none, F.col("type"), extract.article_refs(c), extract.entities(c), extract.dates(c), extract.report_citations(c))
    return cut.select(key, title, "chunk_index", "type", "token_count", "chunk", F.concat(prefix, c).alias("text_with_context"))


def build(docs: DataFrame, key: str, title: str, body: str, make: Callable[[], providers.Embedder], base: Column | None = None, most: int = 256, overlap: int = 50) -> DataFrame:
    """(id, content, metadata MAP, embedding): rows to store for ``docs``, embedded in their contexts.

    Ids follow from key and place, so building again gives the same rows. ``base`` is metadata of the document (a MAP of strings, as
    a column of its title), which stands where a chunk's own has the same key.
    """
    held = providers.embedded(chunks_in_context(docs, key, title, body, most, overlap), "text_with_context", make)
    own = F.create_map(F.lit("source"), F.col(title), F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("type"), F.col("type"), F.lit("token_count"), F.col("token_count").cast("string"))
    ident = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col("chunk_index").cast("string")), 256)
    return held.select(ident.alias("id"), text.sanitize(F.col("chunk")).alias("content"), merged_metadata(own, base if base is not None else F.lit(None).cast("map<string,string>")).alias("metadata"), "embedding")


def sentence_vectors(chunks: DataFrame, make: Callable[[], providers.Embedder], key: str = "id", body: str = "content") -> DataFrame:
    """(key, sentences, sentence_embeddings, num_sentences): what late interaction stores of each chunk; empty for chunks without sentences."""
    each = chunks.select(F.col(key), text.colbert_sentences(F.coalesce(F.col(body), F.lit(""))).alias("s")).select(key, F.posexplode_outer("s").alias("pos", "sentence"))
    held = providers.embedded(each, "sentence", make, "vector")
    rows = F.array_sort(F.collect_list(F.when(F.col("sentence").isNotNull(), F.struct("pos", "sentence", "vector"))))  # eight a chunk at most
    return held.groupBy(key).agg(rows.alias("r")).select(
        key, F.transform("r", lambda x: x["sentence"]).alias("sentences"), F.transform("r", lambda x: x["vector"]).alias("sentence_embeddings"), F.size("r").alias("num_sentences"),
    )


def simple_pipeline(docs: DataFrame, queries: DataFrame, make: Callable[[], providers.Embedder], key: str = "doc_id", body: str = "text", n: int = 10, best: int = 3) -> DataFrame:
    """(query_id, place, id, content, source, chunk_index, total_chunks, similarity, rerank_score): the smallest whole pipeline.

    Documents are cut at full stops, embedded and searched; of each query's ``n`` hits the ``best`` by their words are kept.
    """
    cut = chunking.sentence_pair_chunks(docs, key, body)
    stored = providers.embedded(cut.withColumn("id", F.concat_ws(":", F.col(key).cast("string"), F.col("chunk_index").cast("string"))), "chunk", make)
    asked = providers.embedded(queries.select("query_id", "query"), "query", make, task="query")
    hits = vector.search(stored, asked, k=n).withColumnRenamed("rank", "original_rank")
    held = hits.join(stored.select("id", F.col(key).alias("source"), "chunk_index", "total_chunks", "chunk"), "id").join(queries.select("query_id", "query"), "query_id")
    out = rerank.reranked(held, rerank.lexical_overlap(F.col("query"), F.col("chunk")), limit=best)
    return out.select("query_id", F.col("reranked_position").alias("place"), "id", F.col("chunk").alias("content"), "source", "chunk_index", "total_chunks", "similarity", "rerank_score")


def retrieval_node(chunks: DataFrame, make: Callable[[], providers.Embedder], query: Callable[[DataFrame], Column], n: int = 5, least: float = 0.3) -> Callable[[DataFrame, dict, str], DataFrame]:
    """What serves the retrieval nodes of a workflow, and the grounding of its actions: hits of at least ``least`` under their sources.

    ``chunks`` has (id, content, source, embedding); ``query`` tells what each request searches for. A request without a hit gets NULL.
    """
    from juralake.plans.retrieve import context

    def serve(requests: DataFrame, data: dict, out: str) -> DataFrame:
        asked = requests.withColumn("__query", query(requests))
        unique = asked.select("__query").where("__query IS NOT NULL").distinct().select(F.col("__query").alias("query_id"), F.col("__query").alias("query"))
        hits = vector.search(chunks, providers.embedded(unique, "query", make, task="query"), k=data.get("n", n)).where(F.col("similarity") >= least)
        found = context(hits.withColumnRenamed("rank", "place").join(chunks.select("id", "content", "source"), "id"))
        return asked.join(found.select(F.col("query_id").alias("__query"), F.col("context").alias(out)), "__query", "left").drop("__query")

    return serve


def research_node(chunks: DataFrame, key: str, query: str, decompose: Callable[[], providers.Completer], analyse: Callable[[], providers.Completer], embed: Callable[[], providers.Embedder]) -> Callable[[DataFrame, dict, str], DataFrame]:
    """What serves the research nodes of a workflow: a report on column ``query`` of each request, told apart by column ``key``."""
    from juralake.plans.assist import research

    def serve(requests: DataFrame, data: dict, out: str) -> DataFrame:
        asked = requests.select(F.col(key).alias("query_id"), F.col(query).alias("query"))
        report = research(chunks, asked, decompose, analyse, embed).select(F.col("query_id").alias(key), F.col("report").alias(out))
        return requests.join(report, key, "left")

    return serve
