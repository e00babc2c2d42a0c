"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juralake.session import materialise


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def delivered_once(chunks: DataFrame, *columns: str) -> DataFrame:
    """``id`` and ``columns`` of each chunk, one row per id.

    A chunk may be delivered again with the same content; one delivery is kept. Rows without an id are left out,
    as nothing could be reported for them. Hashing by id also evens out partitions of very uneven content sizes.
    """
    return chunks.where("id IS NOT NULL").select("id", *columns).dropDuplicates(["id"])


def first_deliveries(chunks: DataFrame, *columns: str) -> DataFrame:
    """``delivered_once`` for large columns: the rows of a plain scan, without those that repeat an id, and without shuffling them.

    A first pass reads ids alone and notes, for each id that came more than once, where its first row stands in the files;
    that small table is written, so that Spark knows its size when it chooses how to join, and broadcasts it only if it is
    under the session's threshold. A table of few partitions is dealt out over the cores (``spread``). What isn't read from files goes through ``delivered_once``.
    """
    if not chunks.inputFiles():
        return delivered_once(chunks, *columns)
    at = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = chunks.where("id IS NOT NULL").select("id", *columns, at.alias("__at"))
    twice = placed.groupBy("id").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    known = materialise(twice.select(F.col("id").alias("__id"), "__first"), "twice")
    kept = placed.join(known, F.col("id") == F.col("__id"), "left").where("__first IS NULL OR __first = __at")
    return spread(chunks.select("id"), kept.select("id", *columns))


def rows_of_sample(table: DataFrame, chosen: DataFrame, key: str, *columns: str) -> DataFrame:
    """``key``, ``columns`` and the other columns of ``chosen``: the rows of a plain scan that a bounded sample has chosen by ``key``.

    ``chosen`` has as few rows as can be sent to all. A pass over the keys finds the files that hold them, and only those are read
    for ``columns``, so a sample of a large table costs the texts of as many files as it has rows at most.
    """
    held = F.broadcast(chosen)
    paths = table.inputFiles()
    if len(paths) > 1:
        found = table.select(key, F.col("_metadata.file_path").alias("__path")).join(F.broadcast(chosen.select(key)), key, "left_semi")
        paths = [r[0] for r in found.select("__path").distinct().collect()]
        table = table.sparkSession.read.schema(table.schema).parquet(*paths) if paths else table.limit(0)
    return table.select(key, *columns).join(held, key)


def spread(scan: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``rows``, which come of the plain read ``scan`` (or are it), over at least as many partitions as the session has cores.

    For work that takes long on each row: a table of few files, as on one machine, is dealt out anew; one that is large enough
    comes in many partitions and isn't shuffled. The partitions of a plain read are known without running it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    rows = scan if rows is None else rows
    return rows if scan.rdd.getNumPartitions() >= cores else rows.repartition(cores)
