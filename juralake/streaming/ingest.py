"""Incremental ingest: the batch transforms over a stream of new documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from juralake.functions.text import sanitize
from juralake.operators.chunking import LEAST_TOKENS, packed_chunks
from juralake.plans.index import build
from juralake.plans.providers import Embedder


def read_documents(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def chunk_stream(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 256, overlap: int = 50) -> DataFrame:
    """Chunks of at least LEAST_TOKENS of each document, with an id that follows from key and place; the same for batch and stream.

    A document is cut on its own, so no state is kept.
    """
    chunks = packed_chunks(docs.select(F.col(key), sanitize(F.col(text)).alias("t")), key, "t", most, overlap)
    ident = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col("chunk_index").cast("string")), 256)
    return chunks.where(F.col("token_count") >= LEAST_TOKENS).select(ident.alias("id"), key, "chunk_index", "token_count", F.col("chunk").alias("content"))


def ingest(docs: DataFrame, out: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Append the chunks of all documents available now to a Parquet table; a restart goes on where the last run ended."""
    return chunk_stream(docs, key, text).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def ingest_index(docs: DataFrame, out: str, checkpoint: str, key: str, title: str, text: str, make: Callable[[], Embedder]) -> StreamingQuery:
    """Append the index rows of all documents available now, chunked by structure and embedded in their contexts, to a Parquet table.

    Every batch is built by the batch plan (``plans.index.build``) and written under its number, so a batch that runs again after a
    failure replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        build(batch, key, title, text, make).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """An extension: events by type and window; those later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
