"""Mixing sources to target weights.

A source gives equal-token blocks of its shuffled documents, epoch after epoch up to its cap. Golden-ratio points mapped
through the cumulative shares give an even schedule of slots; the k-th slot of a source takes its k-th block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juralake.functions.labels import resolve
from juralake.llm.bpe import count_tokens
from juralake.operators.running import running_rank, running_sum
from juralake.session import materialise

#: Tokens in a block of the schedule.
BLOCK_TOKENS = 8192
#: Documents in a bucket of the shuffled order, about; bounds what one task sorts.
BUCKET_DOCS = 50_000
#: Slots of the schedule in a bucket.
BUCKET_SLOTS = 1 << 16
GOLDEN = (math.sqrt(5) - 1) / 2


def sized_documents(documents: DataFrame, aliases: DataFrame, vocab: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; NULL and empty texts have 0 tokens, unresolved sources are ``unknown``.

    Extra columns are ignored; the text goes no further than the tokenizer, so what is shuffled later is three numbers a row.
    """
    slim = documents.select("doc_id", "source", "text").withColumnRenamed("source", "raw_source")
    sized = count_tokens(slim, "text", vocab)
    return resolve(sized, aliases, "source", "raw_source", "source").select("doc_id", "source", "n_tokens")


def mix_shares(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets``: its supply, what it gives to the mixture and whether it reaches its target.

    source, target_share, max_repeats, supply_tokens, target_tokens (share of the tokens of all documents), given_tokens
    (at most supply times max_repeats), repeats (given / supply), reached, actual_share (of what all sources give).
    A source without documents has supply 0. Short sources give all they may; nothing is moved to other sources.
    """
    supply = sized.groupBy("source").agg(F.sum("n_tokens").alias("n"))  # pre-aggregated before the shuffle
    total = supply.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_tokens"))
    own = targets.select("source", "target_share", "max_repeats").join(supply, "source", "left")
    rows = own.crossJoin(total).select(  # total is one row, from an aggregate without keys
        "source", "target_share", "max_repeats",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("supply_tokens"),
        (F.col("target_share") * F.col("all_tokens")).alias("target_tokens"),
    )
    cap = F.col("supply_tokens") * F.col("max_repeats")
    given = rows.withColumn("given_tokens", F.least(cap.cast("double"), "target_tokens")).withColumn("reached", cap >= F.col("target_tokens"))
    whole = given.agg(F.sum("given_tokens").alias("all_given"))
    return given.crossJoin(whole).select(
        "source", "target_share", "max_repeats", "supply_tokens", "target_tokens", "given_tokens",
        F.when(F.col("supply_tokens") > 0, F.col("given_tokens") / F.col("supply_tokens")).otherwise(F.lit(0.0)).alias("repeats"),
        "reached",
        F.when(F.col("all_given") > 0, F.col("given_tokens") / F.col("all_given")).otherwise(F.lit(0.0)).alias("actual_share"),
    )


def mix(sized: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """The mixture: (slot, source, epoch, doc_id, n_tokens), to be read in the order of slot, then of ``in_block``.

    In each epoch a source's documents come in another pseudo-random order. A document is given when its first token lies
    within the source's given tokens, so a source overshoots by less than one document. Documents without tokens give
    nothing to a share and are left out. ``sized`` is read several times and should be materialised.
    """
    spark = sized.sparkSession
    shares = mix_shares(sized, targets).where("given_tokens > 0")
    counts = sized.where("n_tokens > 0").groupBy("source").agg(F.count("*").alias("n_docs"))
    # One row per source of the fixed target table: as many rows as targets has.
    plan = shares.join(counts, "source").select("source", "supply_tokens", "given_tokens", "n_docs").collect()
    if not plan:
        return spark.createDataFrame([], "slot bigint, source string, epoch int, in_block bigint, doc_id bigint, n_tokens bigint")
    of = spark.createDataFrame(
        [(r.source, r.supply_tokens, r.given_tokens, max(1, math.ceil(r.n_docs / BUCKET_DOCS)), math.ceil(r.given_tokens / r.supply_tokens)) for r in plan],
        "source string, supply bigint, given double, n_buckets int, n_epochs int",
    )
    docs = (
        sized.where("n_tokens > 0").join(of, "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("n_epochs") - 1)))
        .withColumn("mixed", F.xxhash64("doc_id", "epoch", F.lit(seed)))
    )
    bucket = F.pmod(F.shiftrightunsigned("mixed", 8), F.col("n_buckets"))
    docs = docs.withColumn("bucket", bucket)
    placed = running_sum(docs, ["source", "epoch"], [F.col("bucket")], [F.col("mixed"), F.col("doc_id")], F.col("n_tokens"), "until")
    begins = F.col("epoch") * F.col("supply") + F.col("until") - F.col("n_tokens")
    taken = placed.withColumn("begins", begins).where("begins < given").withColumn("block", F.floor(F.col("begins") / block_tokens))
    weights = [(r.source, math.ceil(r.given_tokens / block_tokens)) for r in plan]
    slots = _schedule(spark, weights)
    return (
        taken.join(slots, ["source", "block"])
        .select("slot", "source", "epoch", F.col("begins").alias("in_block"), "doc_id", "n_tokens")
    )


def given_shares(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_shares`` with given_tokens, repeats and actual_share as counted in the rows of ``mix``, not as planned."""
    own = materialise(mix(sized, targets).groupBy("source").agg(F.sum("n_tokens").alias("n")), "given")  # a row per source
    plan = mix_shares(sized, targets).drop("given_tokens", "repeats", "actual_share")
    rows = plan.join(own, "source", "left").crossJoin(own.agg(F.sum("n").alias("all_given")))
    given = F.coalesce("n", F.lit(0)).cast("double")
    return rows.select(
        "source", "target_share", "max_repeats", "supply_tokens", "target_tokens", given.alias("given_tokens"),
        F.when(F.col("supply_tokens") > 0, given / F.col("supply_tokens")).otherwise(F.lit(0.0)).alias("repeats"),
        "reached",
        F.when(F.col("all_given") > 0, given / F.col("all_given")).otherwise(F.lit(0.0)).alias("actual_share"),
    )


def _schedule(spark, weights: list[tuple[str, int]]) -> DataFrame:
    """(source, block, slot): an even interleaving of each source's blocks 0, 1, ...

    Slot i belongs to the source whose stretch of the cumulative shares holds the i-th golden-ratio point. A source gets its
    share of slots up to a few; blocks beyond its slots follow the schedule's end, slots beyond its blocks stay empty.
    """
    weights = sorted(weights)
    total = sum(n for _, n in weights)
    point = F.col("id") * F.lit(GOLDEN)
    point = point - F.floor(point)
    source, until = F.lit(weights[-1][0]), 0
    name_of, begin_of = F.lit(weights[-1][0]), F.lit(total - weights[-1][1])
    cuts = []
    for name, n in weights[:-1]:
        cuts.append((name, until, until + n))
        until += n
    for name, begin, end in reversed(cuts):  # a chain over the sources of the target table
        source = F.when(point < end / total, F.lit(name)).otherwise(source)
        name_of = F.when(F.col("id") < end, F.lit(name)).otherwise(name_of)
        begin_of = F.when(F.col("id") < end, F.lit(begin)).otherwise(begin_of)
    slots = spark.range(total).select(F.col("id").alias("slot"), source.alias("source"))
    ranked = running_rank(slots, ["source"], [F.shiftright("slot", 16)], [F.col("slot")], "nth")
    blocks = spark.range(total).select(name_of.alias("source"), (F.col("id") - begin_of).alias("block"))
    return (
        blocks.join(ranked.withColumn("block", F.col("nth") - 1), ["source", "block"], "left")
        .select("source", "block", F.coalesce("slot", F.lit(total) + F.col("block")).alias("slot"))
    )


def mixture_inputs(documents: DataFrame, aliases: DataFrame, vocab: str) -> DataFrame:
    """``sized_documents``, written once to the shared folder because the mixture reads it several times."""
    return materialise(sized_documents(documents, aliases, vocab), "sized")
