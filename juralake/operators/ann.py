"""Approximate vector search: an inverted index of lists around centres, asked by queries of their own.

The centres are trained on a bounded sample; every row is placed in the list of its nearest centre, and a query searches the
lists of its nearest centres exactly, block by block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from juralake.operators.vector import search, usable
from juralake.session import materialise

#: Rows that centres are trained on at most, the lists of an index unless told otherwise, and how many of them a query searches.
TRAIN_ROWS = 10_000
LISTS = 100
PROBES = 20


def centres(vectors: DataFrame, lists: int = LISTS, ident: str = "id", vector: str = "embedding", rounds: int = 8) -> np.ndarray:
    """Unit centres of ``lists`` lists, or fewer where there are fewer vectors, by spherical k-means on the TRAIN_ROWS rows of the smallest hashes.

    They have the size that most of those rows have.
    """
    sample = vectors.where(usable(vector)).select(F.xxhash64(ident).alias("h"), F.col(vector).alias("v")).orderBy("h").limit(TRAIN_ROWS).collect()
    if not sample:
        return np.empty((0, 0))
    dim = max(Counter(len(r["v"]) for r in sample).items(), key=lambda x: (x[1], x[0]))[0]
    v = np.array([r["v"] for r in sample if len(r["v"]) == dim], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = np.unique(v, axis=0)
    rng = np.random.default_rng(5)
    c = v[rng.choice(len(v), min(lists, len(v)), replace=False)].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        held, first = np.unique(own[order], return_index=True)
        c[held] = np.add.reduceat(v[order], first)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def with_lists(df: DataFrame, ident: str, vector: str, c: np.ndarray, probes: int) -> DataFrame:
    """(ident, embedding, list): usable vectors in the lists of their ``probes`` nearest centres, a row for each."""
    kind = df.select(ident).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(c):
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
            n = min(probes, len(c))
            near = np.argpartition(-(v @ c.T), n - 1, axis=1)[:, :n]
            at = pa.array(np.repeat(np.arange(b.num_rows), n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(str))], names=["id", "embedding", "list"])

    held = df.where(usable(vector, c.shape[1] or None)).select(ident, F.col(vector).cast("array<float>").alias("embedding"))
    return held.mapInArrow(run, f"id {kind}, embedding array<float>, list string").withColumnRenamed("id", ident)


class Index:
    """Vectors (id, embedding) of one size in lists, written once to the shared folder; rows of another size aren't in it."""

    def __init__(self, vectors: DataFrame, lists: int = LISTS, ident: str = "id", vector: str = "embedding") -> None:
        self.ident = ident
        self.centres = centres(vectors, lists, ident, vector)
        self.table = materialise(with_lists(vectors, ident, vector, self.centres, 1), "lists")

    def search(self, queries: DataFrame, k: int = 5, probes: int = PROBES, threshold: float = 0.0, query_id: str = "query_id", query_vector: str = "embedding") -> DataFrame:
        """(query_id, rank, id, similarity): the ``k`` most similar rows in the ``probes`` nearest lists, by exact cosine.

        Each list is searched on its own, and no more than k rows a query leave it.
        """
        asked = with_lists(queries, query_id, query_vector, self.centres, probes)
        kind = asked.schema[query_id].dataType
        named = asked.withColumn("k", F.struct(F.col(query_id).alias("q"), F.col("list").alias("l"))).withColumn("part", F.to_json("k"))
        hits = search(self.table, named, k, threshold, self.ident, query_id="part", within="list")
        found = hits.withColumn(query_id, F.from_json("part", named.schema["k"].dataType)["q"].cast(kind))
        order = W.partitionBy(query_id).orderBy(F.col("similarity").desc(), self.ident)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, "rank", self.ident, "similarity")


def lists_for(n: int) -> int:
    """Lists for ``n`` vectors: their square root, LISTS at least."""
    return max(LISTS, math.isqrt(n))
