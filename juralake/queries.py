"""The engine's own queries: each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from juralake.functions import classify, extract, text
from juralake.operators import ann, chunking, fusion, lexical, rerank, vector
from juralake.plans import agentic, assist, index, providers, retrieve, workflow
from juralake.sources import store
from juralake.sources.tables import delivered_once, first_deliveries, spread, table


def _seeded(docs: DataFrame) -> DataFrame:
    """``docs`` with ``syn``: a legal preamble made from each row, so that patterns have something varied to find."""
    i = F.col("doc_id")
    syn = F.concat(
        F.lit("Article "), (i % 200 + 1).cast("string"), F.lit(" of Regulation "), (i % 37).cast("string"), F.lit(" applies since "), (i % 28 + 1).cast("string"), F.lit(" March 2"), F.lpad((i % 30).cast("string"), 3, "0"),
        F.when(i % 3 == 0, F.concat(F.lit(". The Court and the defendant cite ("), (F.lit(1950) + i % 60).cast("string"), F.lit(") "), (i % 9 + 1).cast("string"), F.lit(" QB "), (i % 400).cast("string"))).otherwise(F.lit(". The commission noted no. 7")),
        F.when(i % 4 == 0, F.concat(F.lit(". See "), (i % 90 + 10).cast("string"), F.lit(" F. Supp. "), (i % 700 + 1).cast("string"), F.when(i % 8 == 0, F.concat(F.lit(", "), (i % 700 + 5).cast("string"))).otherwise(F.lit("")), F.lit(" (2d Cir. "), (F.lit(1980) + i % 40).cast("string"), F.lit(") and "), (i % 50 + 1).cast("string"), F.lit(" U.S.C. § "), (i % 999 + 1).cast("string"))).otherwise(F.lit("")),
        F.when(i % 5 == 0, F.lit(". This agreement binds the parties")).when(i % 5 == 1, F.lit(". GDPR privacy policy")).when(i % 5 == 2, F.lit(". A federal merger case")).otherwise(F.lit("")),
        F.lit(". "), F.coalesce("text", F.lit("")),
    )
    return docs.select("doc_id", "docket", syn.alias("syn"))


def _joined(c: Column) -> Column:
    return F.array_join(c, " ; ")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _spread(spark: SparkSession, d: str) -> DataFrame:
    """Documents for work that takes long on each."""
    return spread(table(spark, d, "documents"))


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return delivered_once(table(spark, d, "chunks"), *columns)


def _texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks with their contents, which are too large to be shuffled for the few that come twice."""
    return first_deliveries(table(spark, d, "chunks"), "content", *columns)


# Vectors


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row by its key
    sim = v.crossJoin(F.broadcast(q)).select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return sim.where("similarity > 0").orderBy(F.col("similarity").desc(), "vec_id").limit(10)


def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.search(v, q, k=5, base_id="vec_id")


def vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    meta = {"label": F.col("label").cast("string"), "parity": (F.col("vec_id") % 2).cast("string")}
    held = v.where(F.col("label").isin(0, 1, 2, 3, 4, 5) & vector.matches_conditions(meta, [{"label": "3"}, {"label": "5", "parity": "0"}, {"parity": "1"}]))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.search(held, q, k=10, base_id="vec_id")


def threshold_gate(spark: SparkSession, d: str) -> DataFrame:
    return vector_topk_batch(spark, d).where("similarity >= 0.3")


def vector_match_models(spark: SparkSession, d: str) -> DataFrame:
    """The same search in each vector column of the chunk table, asked by the chunk of the smallest id that has a vector there."""
    chunks = table(spark, d, "chunks")
    out = None
    for m in table(spark, d, "embedding_models").orderBy("model").collect():  # the fixed registry
        col, dim = m["vector_column"], m["stored_dims"]
        v = delivered_once(chunks, col).where(vector.usable(col, dim)).select("id", F.col(col).alias("embedding"))
        q = v.orderBy("id").limit(1).select(F.col("id").alias("query_id"), "embedding")
        one = vector.search(v, q, k=5).select(F.lit(m["model"]).alias("model"), "rank", "id", "similarity")
        out = one if out is None else out.unionByName(one)
    return out


def maxsim_labels(spark: SparkSession, d: str) -> DataFrame:
    """Late interaction with labels as documents and their vectors as sentences: the best vector of each label for each query."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.best_of_groups(v, q, "label", base_id="vec_id")


def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    """Approximate search: each hundredth vector asks an index of all."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ann.Index(v, ident="vec_id").search(q, k=5)


# Retrieval pipelines


def _searchable(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the vectors of their first model."""
    return _texts(spark, d, "collection_id", "embedding_1536", "sentence_embeddings", "sentence_texts").withColumnRenamed("embedding_1536", "embedding")


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each search query with the vector of its candidate of the smallest id that has one of the model's size."""
    dim = table(spark, d, "embedding_models").where("vector_column = 'embedding_1536'").first()["stored_dims"]
    held = _chunks(spark, d, "embedding_1536").where(vector.usable("embedding_1536", dim))
    cands = table(spark, d, "colbert_results").select("query_id", F.col("chunk_id").alias("id")).distinct()
    own = cands.join(held, "id").groupBy("query_id").agg(F.min_by("embedding_1536", "id").alias("embedding"))
    return table(spark, d, "search_queries").select("query_id", "query", "collection_id").join(own, "query_id")


def query_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval: vector hits, then keyword hits that they lack, reranked in pairs with the query; five of each query."""
    return retrieve.query_dataset(_searchable(spark, d), _asked_vectors(spark, d))


def query_collection(spark: SparkSession, d: str) -> DataFrame:
    """Vector retrieval within the query's own collection."""
    return retrieve.query_dataset(_searchable(spark, d), _asked_vectors(spark, d), hybrid=False, within="collection_id").select("query_id", "place", "id", "similarity")


def match_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Vector retrieval in the collections of users who have any, under conditions on the chunks' metadata; ten of each query."""
    own = table(spark, d, "collections").where("user_id IS NOT NULL").select(F.col("id").alias("collection_id"))
    held = _chunks(spark, d, "collection_id", "metadata", "embedding_1536").join(own, "collection_id", "left_semi").withColumn("__m", F.try_parse_json("metadata"))
    meta = {k: F.try_variant_get("__m", f"$.{k}", "string") for k in ("language", "domain")}
    base = held.where(vector.matches_conditions(meta, [{"language": "en"}, {"language": "de", "domain": "tax"}, {"domain": "contract"}]))
    return vector.search(base.select("id", F.col("embedding_1536").alias("embedding")), _asked_vectors(spark, d), k=10)


def colbert_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.colbert_search(_searchable(spark, d), _asked_vectors(spark, d)).fillna(-1, "best_sentence")


def embedding_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The 20 first candidates of each query by their vectors."""
    q = _asked_vectors(spark, d)
    cands = _candidates(spark, d).select("query_id", F.col("chunk_id").alias("id"), "rank")
    dim = table(spark, d, "embedding_models").where("vector_column = 'embedding_1536'").first()["stored_dims"]
    held = _chunks(spark, d, "embedding_1536").where(vector.usable("embedding_1536", dim)).withColumnRenamed("embedding_1536", "embedding")
    return retrieve.embedding_rerank(cands, held, q)


#: What a model says of every query that is worth decomposing, in the offline queries below.
PARTS = ("contract term", "bank guarantee")


def _bm25_search(texts: DataFrame, k: int):
    return lambda queries: lexical.bm25(texts, queries, k=k).select("query_id", "rank", "id")


def decomposed_search(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    reply = '["' + '", "'.join(PARTS) + '"]'
    return retrieve.decomposed_search(texts, table(spark, d, "search_queries").select("query_id", "query"), lambda: providers.TemplateCompleter(reply), _bm25_search(texts, 10))


def agentic_search(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds at most: a query that finds fewer than five texts goes on with its planned second one."""
    texts = _texts(spark, d)

    def search(queries: DataFrame) -> DataFrame:
        return _bm25_search(texts, 5)(queries).join(texts, "id").select("query_id", "rank", F.col("content").alias("document"))

    def judge(active: DataFrame, found: DataFrame) -> DataFrame:
        n = found.groupBy("query_id").agg(F.count("*").alias("n"))
        told = active.select("query_id").join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        return told.select("query_id", (F.col("n") / 10).alias("relevance"), (F.col("n") >= 5).alias("sufficient"), F.lit(None).cast("string").alias("next_query"))

    q = table(spark, d, "search_queries").select("query_id", "query", F.array("query", F.lit(PARTS[1])).alias("planned"))
    return agentic.agentic_search(q, search, judge, rounds=2)[0]


def result_context(spark: SparkSession, d: str) -> DataFrame:
    """The three best candidates of each query as a model reads them."""
    c = _candidates(spark, d).where("rank <= 3").select("query_id", F.col("rank").alias("place"), F.col("chunk_id").alias("source"), F.col("document").alias("content"))
    return retrieve.context(c).select("query_id", F.md5("context").alias("digest"), F.length("context").alias("size"))


def result_stats(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "colbert_results").where("query_id IS NOT NULL AND colbert_score IS NOT NULL AND NOT isnan(colbert_score)")
    return fusion.result_stats(held, "query_id", "colbert_score", "sentence_scores")


def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "colbert_results").withColumn("sentence_scores", F.transform("sentence_scores", lambda x: F.when(~F.isnan(x), x)))
    return fusion.positional(rows, "sentence_scores", "matched_sentences", keep=("query_id", "chunk_id"))


# Fusion


def _ranked_lists(spark: SparkSession, d: str) -> DataFrame:
    cands = table(spark, d, "colbert_results").where("query_id IS NOT NULL AND chunk_id IS NOT NULL")
    one = cands.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("document", "original_score", "colbert_score"), "created_at").alias("c")).select("query_id", "chunk_id", "c.*")
    parts = []
    for n, score in enumerate(("original_score", "colbert_score")):
        held = one.where(F.col(score).isNotNull() & ~F.isnan(score))
        order = W.partitionBy("query_id").orderBy(F.col(score).desc(), "chunk_id")
        parts.append(held.select("query_id", F.lit(n).alias("list_no"), (F.row_number().over(order) - 1).alias("rank"), "document", F.lit(score).alias("asked")))
    return parts[0].unionByName(parts[1])


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(_ranked_lists(spark, d))


def rrf_agentic(spark: SparkSession, d: str) -> DataFrame:
    lists = _ranked_lists(spark, d)
    fused = fusion.reciprocal_rank_fusion(lists, key_chars=200, limit=8, pass_single=False)
    return fusion.with_sources(lists, fused, "query_id", "list_no", "asked", "document", 200)


def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by score, then keyword hits of the query that aren't among them; the first 8 of each query."""
    q = table(spark, d, "search_queries")
    cands = _candidates(spark, d).select("query_id", F.col("chunk_id").alias("id"), "rank").where("rank <= 30")
    keyed = q.select("query_id", F.posexplode(text.keywords(F.col("query"))).alias("pos", "keyword"))
    hits = lexical.contains_keywords(_texts(spark, d), keyed)
    found = keyed.join(hits, "keyword").groupBy("query_id", "id").agg(F.min("pos").alias("rank"))
    merged = fusion.keep_first_union(cands.select("query_id", "id", F.col("rank").cast("bigint").alias("rank")), found.select("query_id", "id", F.col("rank").cast("bigint").alias("rank")), ["query_id", "id"])
    order = W.partitionBy("query_id").orderBy("origin", "rank", "id")
    return merged.withColumn("place", F.row_number().over(order)).where("place <= 8").select("query_id", "id", "origin", "place")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    cands = table(spark, d, "colbert_results").where("query_id IS NOT NULL AND chunk_id IS NOT NULL")
    one = cands.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("document", "original_score", "sentence_scores"), "created_at").alias("c")).select("query_id", "chunk_id", "c.*")
    held = one.where("original_score IS NOT NULL AND NOT isnan(original_score)")
    return held.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("original_score").desc(), "chunk_id")))


def colbert_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The 20 first candidates by sentence score, with the fallback where they have none; the best 8 of each query."""
    c = _candidates(spark, d).where("rank <= 20")
    best = F.array_max(F.filter("sentence_scores", lambda x: x.isNotNull() & ~F.isnan(x)))
    out = rerank.reranked(c, rerank.rescore_by_sentences(c, best, F.col("original_score")), original="rank", key="chunk_id", limit=8)
    return out.select("query_id", "chunk_id", F.col("rank").alias("original_rank"), "rerank_score", "reranked_position")


def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).where("rank <= 30").join(table(spark, d, "search_queries").select("query_id", "query"), "query_id")
    out = rerank.reranked(c, rerank.lexical_overlap(F.col("query"), F.col("document")), original="rank", key="chunk_id", limit=5)
    return out.select("query_id", "chunk_id", F.col("rank").alias("original_rank"), "rerank_score", "reranked_position")


# Keywords


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "search_queries").select(F.explode(text.keywords(F.col("query"))).alias("keyword"))
    return lexical.contains_keywords(_texts(spark, d), keyed)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(_texts(spark, d), table(spark, d, "search_queries").select("query_id", "query"))


def keywords(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.coalesce(_joined(text.keywords(F.col("text"))), F.lit("")).alias("keywords"))


# Text


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return _spread(spark, d).select("doc_id", F.posexplode(text.split_sentences(F.col("text"), protect=False)).alias("pos", "sentence"))


def sentences_protected(spark: SparkSession, d: str) -> DataFrame:
    s = _seeded(_spread(spark, d)).select("doc_id", text.split_sentences(F.col("syn")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.get("s", F.lit(1)).alias("second"))


def words(spark: SparkSession, d: str) -> DataFrame:
    w = _spread(spark, d).where("text IS NOT NULL").select("doc_id", text.legal_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.element_at("w", F.when(F.size("w") > 0, -1)), F.lit("")).alias("last"))


def abbrev_protect(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(_spread(spark, d)).select("doc_id", text.protect_abbreviations(F.col("syn")).alias("protected"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", text.normalize_legal_text(F.concat(F.lit("see SECTION 4 and  article 5 "), "text")).alias("normal"))


def sanitize(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.lit("a\u0001b\u0007�﻿c"), F.coalesce("text", F.lit("")))
    return _docs(spark, d).select("doc_id", text.sanitize(dirty).alias("clean"))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select("source", text.token_count(F.col("text")).alias("t"))
    return t.groupBy("source").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"), F.max("t").alias("most"), F.count_if(F.col("t") < 25).alias("short"))


def colbert_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = _spread(spark, d).where("text IS NOT NULL").select("doc_id", text.colbert_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


def previews(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.preview(F.col("text")).alias("preview"))


def enhance(spark: SparkSession, d: str) -> DataFrame:
    summary = F.when(F.length("text") >= 50, F.concat(F.lit("about "), F.coalesce("doc_type", F.lit("?"))))
    return _docs(spark, d).select("doc_id", text.enhance_with_summary(F.col("text"), summary).alias("enhanced"))


def template_fill(spark: SparkSession, d: str) -> DataFrame:
    t = F.lit("Dear {{ query.id }}, on {{query.text}} in {{collection}}: {{missing}}{{query.none}} {{collection.name}} {{none.name}}")
    values = {"query": {"id": F.col("query_id"), "text": F.col("query")}, "collection": F.col("collection_id")}
    return table(spark, d, "search_queries").select("query_id", text.fill_template(t, values).alias("filled"))


def prompt_fill(spark: SparkSession, d: str) -> DataFrame:
    t = next(t for name, t in store.PROMPTS if name == "summary")
    return _docs(spark, d).select("doc_id", F.md5(text.fill_template(F.lit(t), {"DOC_TYPE": F.col("doc_type"), "N": F.lit(3), "TEXT": F.col("text")})).alias("digest"))


# Chunks


def _digested(chunks: DataFrame) -> DataFrame:
    """Chunks with their text as a digest, which is as good to compare and shorter."""
    return chunks.withColumn("digest", F.md5("chunk")).drop("chunk")


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return _digested(chunking.packed_chunks(_spread(spark, d), "doc_id", "text", 256, 0))


def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _digested(chunking.packed_chunks(_spread(spark, d), "doc_id", "text", 256, 50))


def simple_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _digested(chunking.sentence_pair_chunks(_spread(spark, d), "doc_id", "text"))


def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = _seeded(_spread(spark, d)).select("doc_id", F.concat(F.lit("Preamble. "), "syn", F.lit(" Section 9 ends."), F.when(F.col("doc_id") % 2 == 0, F.lit(" Chapter 10 too.")).otherwise(F.lit(""))).alias("t"))
    return chunking.sections(docs, "doc_id", "t").select("doc_id", "head", F.length("section").alias("size"))


def structured_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _digested(chunking.structured_chunks(_spread(spark, d), "doc_id", "text"))


def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents as an index holds them: what is stored, and what its vector is made of."""
    out = index.chunks_in_context(_spread(spark, d), "doc_id", "docket", "text")
    return out.select("doc_id", "chunk_index", "type", "token_count", F.md5("chunk").alias("digest"), F.md5("text_with_context").alias("context_digest"))


def contract_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Between the parties\n1. Scope\n"), F.coalesce("text", F.lit("")), F.lit("\n2.1 - Term\nTwo years.\n\n3. End\nNever."))
    out = chunking.contract_chunks(_spread(spark, d).select("doc_id", t.alias("t")), "doc_id", "t")
    return out.withColumn("digest", F.md5("content")).drop("content")


# Extraction


def legal_refs(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(_spread(spark, d)).select("doc_id", _joined(extract.article_refs(F.col("syn"))).alias("refs"))


def legal_dates(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(_spread(spark, d)).select("doc_id", _joined(extract.dates(F.col("syn"))).alias("dates"))


def legal_citations(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(_spread(spark, d)).select("doc_id", _joined(extract.report_citations(F.col("syn"))).alias("cites"))


def legal_entities(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(_spread(spark, d)).select("doc_id", _joined(extract.entities(F.col("syn"))).alias("entities"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    c = _seeded(_spread(spark, d)).select("doc_id", F.posexplode(extract.citations(F.col("syn"))).alias("pos", "c"))
    return c.select("doc_id", "pos", "c.kind", "c.volume", "c.page", "c.year", "c.normal")


def context_prefix(spark: SparkSession, d: str) -> DataFrame:
    s = _seeded(_spread(spark, d))
    x = F.col("syn")
    p = extract.context_prefix(F.concat(F.col("docket"), F.lit("_a-b.pdf")), F.lit(None).cast("string"), F.lit("legal_section"), extract.article_refs(x), extract.entities(x), extract.dates(x), extract.report_citations(x))
    return s.select("doc_id", p.alias("prefix"))


def metadata_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(_spread(spark, d)).select("doc_id", extract.heuristic_metadata(F.col("syn")).alias("m")).select("doc_id", "m.*")


def metadata_normal(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    raw = F.when(F.col("doc_id") % 2 == 0, "European Union").otherwise(F.col("jurisdiction"))
    return docs.select("doc_id", extract.normal_label(F.col("doc_type")).alias("doc_type"), extract.normal_jurisdiction(raw).alias("jurisdiction"))


def enabled_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The document type and jurisdiction that were found, as a collection that wants these alone keeps them."""
    m = _seeded(_spread(spark, d)).select("doc_id", extract.heuristic_metadata(F.col("syn")).alias("m"))
    fields = {k: F.col(f"m.{k}") for k in ("document_type", "jurisdiction", "practice_area", "date")}
    kept = extract.enabled_fields(fields, {"document_type": True, "jurisdiction": True, "practice_area": False})
    return m.select("doc_id", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("kept"))


def reporters(spark: SparkSession, d: str) -> DataFrame:
    c = _seeded(_spread(spark, d)).select("doc_id", F.posexplode(extract.citations(F.col("syn"))).alias("pos", "c")).where("c.reporter IS NOT NULL")
    return c.select("doc_id", "pos", extract.reporter_name(F.col("c.reporter")).alias("reporter"))


def json_mode(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of chunks as a model would reply with it, in a code fence."""
    held = _chunks(spark, d, "metadata").where("metadata IS NOT NULL")
    r = held.select("id", extract.json_or_text(F.concat(F.lit("```json\n"), "metadata", F.lit("\n```"))).alias("r"))
    return r.select("id", F.col("r.json").isNotNull().alias("is_json"), F.try_variant_get("r.json", "$.source", "string").alias("source"), F.coalesce(F.length("r.text"), F.lit(0)).alias("size"))


# Classification


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The queries, each also asked in five other ways."""
    q = spread(table(spark, d, "search_queries")).select("query_id", F.explode(F.array(
        F.col("query"), F.concat(F.lit("what is the meaning of "), "query"), F.concat(F.lit("how does Article 5 of the directive limit a ruling on "), "query", F.lit(" generally?")),
        F.concat(F.lit("compare the effects of "), "query", F.lit(" and of fines, or penalties? And if not, why must it be so unless provided?")), F.concat(F.lit('"'), "query", F.lit('"')), F.lit("  "),
    )).alias("q"))
    return q


def query_class(spark: SparkSession, d: str) -> DataFrame:
    c = _asked(spark, d).select("query_id", "q", classify.classification(F.translate("q", " 　", "  ")).alias("c"))
    return c.select("query_id", "q", "c.kind", F.round("c.confidence", 6).alias("confidence"), "c.n_results", "c.use_reranking")


def adaptive_params(spark: SparkSession, d: str) -> DataFrame:
    """How each query is to be searched for: by its collection's settings, with as many results as its kind asks for."""
    own = table(spark, d, "collections").select(F.col("id").alias("collection_id"), "retrieval_settings.search_mode", "retrieval_settings.reranking_enabled")
    q = table(spark, d, "search_queries").join(own, "collection_id", "left")
    p = classify.adaptive_parameters(F.translate("query", "\u00a0\u3000", "  "), F.col("search_mode"), F.col("reranking_enabled"))
    return q.select("query_id", p.alias("p")).select("query_id", "p.*")


def decompose_gate(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", "q", classify.should_decompose(F.col("q")).alias("decompose"))


# Store


def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.counts(table(spark, d, "collections"), table(spark, d, "chunks"))


def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    return store.with_settings(table(spark, d, "collections")).select("id", "settings.*")


def legal_sources(spark: SparkSession, d: str) -> DataFrame:
    return store.legal_sources(table(spark, d, "collections")).select("id", "name")


def get_documents(spark: SparkSession, d: str) -> DataFrame:
    found = store.get(table(spark, d, "chunks"), table(spark, d, "colbert_results").select(F.col("chunk_id").alias("id")))
    return found.select("id", "collection_id", F.length("content").alias("size"))


def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    return store.delete(table(spark, d, "chunks"), table(spark, d, "colbert_results").select(F.col("chunk_id").alias("id"))).select("id").distinct()


def incremental_anti(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return store.missing(docs, table(spark, d, "colbert_results").select(F.col("query_id").cast("string").alias("id"))).select("id")


def model_registry(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "collections").select("id", F.get_json_object("metadata", "$.embedding_model").alias("model"))
    return store.with_model(used, table(spark, d, "embedding_models"), "lexvec-small")


def history_latest(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "search_queries").where("query <> ''")
    return q.groupBy("collection_id").agg(F.max_by("query", F.struct("issued_at", "query_id")).alias("query"), F.max("issued_at").alias("issued_at"))


def llm_cost(spark: SparkSession, d: str) -> DataFrame:
    used = _docs(spark, d).select(F.coalesce("doc_type", F.lit("unknown")).alias("model"), text.token_count(F.col("text")).alias("tokens_in"), F.lit(100).alias("tokens_out"))
    return providers.cost(used, [("case_law", 0.0025, 0.01), ("contract", 0.00014, 0.00028)])


def collection_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The collection of the smallest name, by its name."""
    colls = table(spark, d, "collections")
    return store.by_name(colls, colls.agg(F.min("name")).first()[0]).select("id", "name")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of collections and their chunks when the collection with the most chunks goes."""
    colls, chunks = table(spark, d, "collections"), table(spark, d, "chunks")
    top = store.counts(colls, chunks).orderBy(F.col("n_chunks").desc(), "name").first()
    left, rest = store.delete_collection(colls, chunks, top["name"])
    return left.agg(F.count("*").alias("n")).select(F.lit("collections").alias("what"), "n").unionByName(rest.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("what"), "n"))


def tenant_rows(spark: SparkSession, d: str) -> DataFrame:
    colls = table(spark, d, "collections")
    return store.for_tenant(colls, colls.agg(F.min("user_id")).first()[0]).select("id", "user_id")


def new_collections(spark: SparkSession, d: str) -> DataFrame:
    """A collection that is there already and one that isn't, got or made: the names that match and their settings."""
    colls = store.with_settings(table(spark, d, "collections")).select("id", "name", "user_id", "metadata", F.col("settings").alias("retrieval_settings"), "created_at")
    held = colls.agg(F.min("name")).first()[0]
    every = store.get_or_create(colls, store.create_collection(spark, held).unionByName(store.create_collection(spark, "a new one", settings={"sac_enabled": True})))
    return every.where(F.col("name").isin(held, "a new one")).select("name", "retrieval_settings.search_mode", "retrieval_settings.sac_enabled")


def insert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as rows to insert, with ids that follow from their content."""
    return store.insertable(_docs(spark, d).where("text IS NOT NULL").select(F.col("text").alias("content")), "c1").select("id", "collection_id", F.md5("content").alias("digest"))


def sentence_vectors_of(spark: SparkSession, d: str) -> DataFrame:
    """How many sentence vectors, and texts, the candidates of all queries have."""
    found = store.get(table(spark, d, "chunks"), table(spark, d, "colbert_results").select(F.col("chunk_id").alias("id")))
    return found.select("id", F.coalesce(F.size("sentence_embeddings"), F.lit(-1)).alias("vectors"), F.coalesce(F.size("sentence_texts"), F.lit(-1)).alias("texts"))


def sentence_vector_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each document and their vectors, as late interaction stores them."""
    out = index.sentence_vectors(_spread(spark, d).where("text IS NOT NULL"), providers.HashedWords, "doc_id", "text")
    return out.select("doc_id", "num_sentences", F.size("sentence_embeddings").alias("vectors"), F.sha2(F.array_join("sentences", "|"), 256).alias("digest"))


def chunk_config(spark: SparkSession, d: str) -> DataFrame:
    """How to chunk for each provider's models, and for one that nobody knows."""
    asked = table(spark, d, "search_queries").select("query_id", F.element_at(F.array(*(F.lit(x) for x in ("voyage-3-large", "embed-v3", "unheard-of"))), (F.col("query_id") % 3 + 1).cast("int")).alias("model"))
    return store.with_model(asked, store.embedding_models(spark), "text-embedding-3-small").select("query_id", "model", "dimensions", "chunk_size", "chunk_overlap")


def contract_prefix(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.contract_chunks(_spread(spark, d), "doc_id", "text")
    return out.select("doc_id", "chunk_index", F.md5(chunking.with_section_prefix()).alias("digest"))


def json_replies(spark: SparkSession, d: str) -> DataFrame:
    """Questions in a model's replies: as a JSON array, as lines, or none but the one asked."""
    i = F.col("query_id").cast("string")
    reply = F.when(F.col("query_id") % 3 == 0, F.concat(F.lit('So: ["first ", '), F.lit('"'), i, F.lit('"] done'))).when(F.col("query_id") % 3 == 1, F.concat(F.lit("- a longer question "), i, F.lit("\n2. \"another long question\"\nshort"))).otherwise(F.lit(""))
    q = table(spark, d, "search_queries").select("query_id", F.posexplode(extract.json_array_in(reply, F.concat(F.lit("asked "), i))).alias("pos", "question"))
    return q


def hyde_expand(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "search_queries").select("query_id", "query")
    return providers.hypothetical(q, "query", lambda: providers.TemplateCompleter("Answer to {prompt}")).select("query_id", "expanded")


def metadata_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Metadata as a model tells it for some documents, by heuristics where it tells nothing."""
    docs = _seeded(_spread(spark, d)).select("doc_id", F.col("syn").alias("content"))
    told = docs.withColumn("content", F.when(F.col("doc_id") % 2 == 0, F.col("content")))
    some = assist.with_metadata(told, lambda: providers.TemplateCompleter('{"document_type": "Case Law", "jurisdiction": "european union", "date": "2020-05-06T10:00"}')).where("content IS NOT NULL")
    none = assist.with_metadata(docs.where("doc_id % 2 = 1"), lambda: providers.TemplateCompleter("I can't say."))
    return some.unionByName(none).select("doc_id", "metadata.document_type", "metadata.jurisdiction", "metadata.date")


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Documents under their summaries, those that are long enough for one."""
    docs = _docs(spark, d).select("doc_id", F.lit(0).alias("chunk_index"), "source", F.col("text").alias("content"))
    return assist.summarised(docs, lambda: providers.TemplateCompleter("of a text")).select("doc_id", F.coalesce("summary", F.lit("")).alias("summary"), F.md5("enhanced").alias("digest"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Search queries as messages of conversations, one a collection."""
    role = F.element_at(F.array(*(F.lit(x) for x in ("user", "assistant", "tool"))), (F.col("query_id") % 3 + 1).cast("int"))
    said = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("FINAL CLASSIFICATION: "), "query")).otherwise(F.col("query"))
    return table(spark, d, "search_queries").where("collection_id IS NOT NULL").select(F.col("collection_id").alias("conv_id"), F.col("query_id").alias("turn"), role.alias("role"), said.alias("content"))


def chat_history(spark: SparkSession, d: str) -> DataFrame:
    return assist.history(_messages(spark, d), last=3)


def latest_classification(spark: SparkSession, d: str) -> DataFrame:
    return assist.latest_classification(_messages(spark, d))


# Workflows and streams


def workflow_levels(spark: SparkSession, d: str) -> DataFrame:
    return workflow.levels(spark, workflow.EXAMPLE)


def workflow_route(spark: SparkSession, d: str) -> DataFrame:
    out = workflow.run(workflow.EXAMPLE, _docs(spark, d).select("doc_id", "text", "lang", "n_chars"), workflow.Handlers())
    return out.select("doc_id", "status", "output")


def workflow_halt(spark: SparkSession, d: str) -> DataFrame:
    """A graph whose router lets only long texts pass."""
    return workflow.run(workflow.GUARDED, _docs(spark, d).select("doc_id", "lang", "n_chars"), workflow.Handlers()).select("doc_id", "status", "output")


def session_count(spark: SparkSession, d: str) -> DataFrame:
    """An extension: sessions of a user are parted by an hour without events."""
    e = table(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = """vector_topk vector_topk_batch vector_filtered threshold_gate vector_match_models maxsim_labels ivf_topk query_dataset query_collection match_filtered colbert_search embedding_rerank
        decomposed_search agentic_search result_context result_stats positional_zip prompt_fill simple_chunks index_chunks enabled_metadata reporters json_mode adaptive_params workflow_halt collection_lookup cascade_delete tenant_rows new_collections insert_rows
        sentence_vectors_of sentence_vector_counts chunk_config contract_prefix json_replies hyde_expand metadata_fallback summaries chat_history latest_classification rrf_fusion rrf_agentic hybrid_merge colbert_rerank rerank_lexical
        keyword_search bm25_topk keywords sentences sentences_protected words abbrev_protect normalize_text sanitize token_stats colbert_sentences previews enhance template_fill
        chunk_pack chunk_overlap chunk_sections structured_chunks contract_chunks legal_refs legal_dates legal_citations legal_entities citations context_prefix metadata_heuristic
        metadata_normal query_class decompose_gate collection_counts settings_merge legal_sources get_documents delete_documents incremental_anti model_registry history_latest
        llm_cost workflow_levels workflow_route session_count"""
    return {n: globals()[n] for n in names.split()}
