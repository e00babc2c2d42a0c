"""Operators around model calls: chunk summaries, metadata, research over sub-questions and grounding queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from juralake.functions import extract, text
from juralake.plans import providers, retrieve

# Texts under so many characters get no summary, and a model reads no more than so many.
SUMMARY_LEAST, SUMMARY_READS = 50, 2000
METADATA_READS = 3000
#: Sub-questions of one piece of research.
SUBQUESTIONS = 3
# Words that ask for obligations, and what a classification message is known and searched by.
OBLIGATION_WORDS = ("obligation", "comply", "compliance", "requirement", "what must", "what do i need")
CLASSIFIED = r"FINAL CLASSIFICATION|❌|🔴|🟡|🟢"
RISK_LEVELS = ("PROHIBITED", "HIGH-RISK", "LIMITED RISK", "MINIMAL RISK")
ROLES = ("provider", "deployer", "importer", "distributor")
TOPICS = ("GPAI", "FRIA", "transparency", "biometric", "employment", "recruitment", "credit scoring", "law enforcement", "migration", "education", "critical infrastructure")


def summarised(chunks: DataFrame, make: Callable[[], providers.Completer], doc: str = "doc_id", place: str = "chunk_index", source: str = "source", body: str = "content") -> DataFrame:
    """``chunks`` with ``summary`` and ``enhanced``: the chunk under a model's summary, which is told the chunk's place in its document.

    Texts under SUMMARY_LEAST characters, and NULL ones, have no summary and stay as they are.
    """
    total = chunks.groupBy(doc).agg(F.count("*").alias("__total"))  # joined back, as a window would gather a long document
    numbered = chunks.join(total, doc)
    prompt = F.concat(F.lit("Source: "), F.coalesce(F.col(source), F.lit("Unknown")), F.lit("\nPart "), (F.col(place) + 1).cast("string"), F.lit(" of "), F.col("__total").cast("string"), F.lit("\n\n"), F.substring(body, 1, SUMMARY_READS))
    asked = numbered.withColumn("__ask", F.when(F.length(text.strip(F.col(body))) >= SUMMARY_LEAST, prompt)).drop("__total")
    return providers.completed(asked, "__ask", make, "summary").drop("__ask").withColumn("enhanced", text.enhance_with_summary(F.col(body), F.col("summary")))


def with_metadata(docs: DataFrame, make: Callable[[], providers.Completer], body: str = "content") -> DataFrame:
    """``docs`` with ``metadata`` (document_type, jurisdiction, practice_area, date, parties): as a model gives it, else by heuristics.

    A reply that holds no JSON object counts as none. Labels are normalised, dates must begin in ISO form, lists have at most 10 items.
    """
    asked = docs.withColumn("__ask", F.when(F.length(body) > 0, F.substring(body, 1, METADATA_READS)))
    told = providers.completed(asked, "__ask", make, "__reply").withColumn("__v", extract.json_object_in(F.col("__reply"))).withColumn("__h", extract.heuristic_metadata(F.col(body)))
    field = lambda name: F.try_variant_get("__v", f"$.{name}", "string")
    parties = F.slice(F.coalesce(F.try_variant_get("__v", "$.parties", "array<string>"), F.when(field("parties").isNotNull(), F.array(field("parties")))), 1, 10)
    date = F.when(field("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(field("date"), 1, 10))
    meta = F.struct(
        F.coalesce(extract.normal_label(field("document_type")), "__h.document_type").alias("document_type"),
        F.coalesce(extract.normal_jurisdiction(field("jurisdiction")), "__h.jurisdiction").alias("jurisdiction"),
        F.coalesce(extract.normal_label(field("practice_area")), "__h.practice_area").alias("practice_area"), F.coalesce(date, "__h.date_iso").alias("date"), parties.alias("parties"),
    )
    return told.withColumn("metadata", meta).drop("__ask", "__reply", "__v", "__h")


def research(chunks: DataFrame, queries: DataFrame, decompose: Callable[[], providers.Completer], analyse: Callable[[], providers.Completer], embed: Callable[[], providers.Embedder], n: int = 5, least: float = 0.3) -> DataFrame:
    """(query_id, report, n_sources): each query's sub-questions answered from what they retrieve, under a summary.

    ``chunks`` has (id, content, source, embedding). Hits under ``least`` are left out; a sub-question without hits is analysed
    without context. Analyses come in the order of the sub-questions, SUBQUESTIONS at most.
    """
    parts = retrieve.decomposed(queries, decompose, SUBQUESTIONS).withColumn("key", F.concat_ws("#", F.col("query_id").cast("string"), "part"))
    asked = providers.embedded(parts.select("key", "query"), "query", embed, task="query")
    hits = retrieve.vector.search(chunks, asked, k=n, query_id="key").where(F.col("similarity") >= least).withColumnRenamed("rank", "place")
    found = hits.join(chunks.select("id", "content", "source"), "id").select(F.col("key").alias("query_id"), "place", "content", "source")
    sources = found.groupBy("query_id").agg(F.count("*").alias("n"))
    known = parts.join(retrieve.context(found).withColumnRenamed("query_id", "key"), "key", "left").join(sources.withColumnRenamed("query_id", "key"), "key", "left")
    prompted = known.withColumn("__ask", F.concat("query", F.lit("\n\n"), F.coalesce("context", F.lit(""))))
    answered = providers.completed(prompted, "__ask", analyse, "analysis")
    one = F.concat(F.lit("## Analysis "), (F.col("part") + 1).cast("string"), F.lit(": "), F.col("query"), F.lit("\n\n"), F.coalesce("analysis", F.lit("")), F.lit("\n"))
    rows = answered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", one.alias("t")))).alias("r"), F.sum(F.coalesce("n", F.lit(0))).alias("n_sources"))  # three rows a query at most
    body = F.array_join(F.transform("r", lambda x: x["t"]), "\n---\n\n")
    summed = providers.completed(rows.withColumn("__ask", body), "__ask", analyse, "summary").join(queries.select("query_id", "query"), "query_id")
    report = F.concat(F.lit("# Research\n\n**Question:** "), F.coalesce("query", F.lit("")), F.lit("\n\n---\n\n## Summary\n\n"), "summary", F.lit("\n\n---\n\n"), "__ask")
    return summed.select("query_id", report.alias("report"), "n_sources")


def latest_classification(messages: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conversation, classification): the last message of an assistant that holds a classification."""
    held = messages.where((F.col("role") == "assistant") & F.col("content").rlike(CLASSIFIED))
    return held.groupBy(conversation).agg(F.max_by("content", order).alias("classification"))


def history(messages: DataFrame, conversation: str = "conv_id", order: str = "turn", last: int = 20) -> DataFrame:
    """The last messages of users and assistants that aren't empty."""
    w = W.partitionBy(conversation).orderBy(F.col(order).desc())
    held = messages.where(F.col("role").isin("user", "assistant") & (F.length("content") > 0))
    return held.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= last).drop("__n")


def grounding_query(message: Column, classification: Column) -> Column:
    """What to search for: a request for obligations becomes the terms of the classification; any other message stays as it is."""
    low = F.lower(classification)
    kept = lambda words, body: F.filter(F.array(*(F.when(body.contains(w), F.lit(w)) for w in words)), lambda x: x.isNotNull())
    levels = F.transform(kept(RISK_LEVELS, classification), F.lower)
    topics = F.filter(F.array(*(F.when(low.contains(w.lower()), F.lit(w)) for w in TOPICS)), lambda x: x.isNotNull())
    named = lambda head, pattern: F.transform(F.regexp_extract_all(classification, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(head), x))
    terms = F.concat(levels, named("Article ", r"Art(?:icle)?\.?\s*(\d+)"), named("Annex ", r"Annex\s+(I{1,3}|IV|V)"), kept(ROLES, low), topics)
    wanted = F.lit(False)
    for w in OBLIGATION_WORDS:
        wanted = wanted | F.lower(message).contains(w)
    return F.when(wanted & (F.size(terms) > 0), F.concat(F.lit("EU AI Act "), F.array_join(terms, " "), F.lit(" obligations requirements"))).otherwise(message)
