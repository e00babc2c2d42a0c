"""Keyword and BM25 search."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from juralake.functions.text import lowered, words
from juralake.operators.running import rank_by_range
from juralake.session import discard, materialise

#: Keywords that one automaton holds; more are searched for in several passes.
AUTOMATON_WORDS = 200_000
#: Terms that texts are searched for in one pass, and postings of the texts that a task holds.
TERMS, BLOCK_POSTINGS = 500_000, 6_000_000
#: Sums of scores that differ by more than this differ in the 6 places that they are rounded to.
MARGIN = 2e-6
#: Times that a query's best texts so far are scored whole, to know early what the best reach.
TRIES = 3


def contains_keywords(texts: DataFrame, keywords: DataFrame, ident: str = "id", text: str = "content", hits: int = 10) -> DataFrame:
    """(keyword, id): for each keyword up to ``hits`` texts that contain it anywhere, by id; both are compared in lower case.

    ``keywords`` has a column keyword; NULL and empty ones find nothing. They are written once, with a number; an automaton of
    AUTOMATON_WORDS of them at a time finds all its keywords in one pass over each whole text, and each task hands on the
    ``hits`` smallest ids of each keyword alone. The driver holds one automaton's keywords at a time.
    """
    kind = texts.select(ident).schema[0].dataType.simpleString()
    spark = texts.sparkSession
    wanted = materialise(keywords.select("keyword").where("keyword <> ''").distinct(), "keywords")
    slices = max(1, -(-wanted.count() // AUTOMATON_WORDS))

    def search(part: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for i, w in enumerate(part):
                machine.add_word(w, i)
            machine.make_automaton()
            held: dict[int, list] = {}
            for b in batches:
                ids = b.column(0).to_pylist()
                for i, t in zip(ids, b.column(1).to_pylist(), strict=True):
                    for j in {j for _, j in machine.iter(t)}:
                        own = held.setdefault(j, [])
                        own.append(i)
                        if len(own) > 4 * hits:
                            held[j] = sorted(own)[:hits]
            rows = [(part[j], i) for j, own in held.items() for i in sorted(own)[:hits]]
            for at in range(0, len(rows), 10_000):
                found, own = zip(*rows[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(own, to_arrow_type(id_type))], names=["keyword", "id"])

        id_type = texts.schema[ident].dataType
        return texts.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), lowered(F.col(text)).alias("t")).mapInArrow(run, f"keyword string, id {kind}")

    found = spark.createDataFrame([], f"keyword string, id {kind}")
    for n in range(slices):
        part = sorted(r["keyword"] for r in wanted.where(F.pmod(F.xxhash64("keyword"), F.lit(slices)) == n).collect())  # about AUTOMATON_WORDS
        if part:
            found = search(part) if n == 0 and slices == 1 else found.unionByName(search(part))
    order = W.partitionBy("keyword").orderBy("id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= hits).select("keyword", F.col("id").alias(ident))


def postings(texts: DataFrame, terms: DataFrame, ident: str = "id", text: str = "content") -> DataFrame:
    """(pass, id, size, terms, tfs): a row for each text that has words, with the numbers and counts of those of ``terms`` that stand in it.

    ``terms`` is a written table (term, n INT) of words in lower case, numbered from 1; size is the text's number of words. NULL texts, and
    those without words, have no row. Nothing is shuffled. The driver and the tasks hold TERMS of them at a time: beyond that the texts are split
    once more for each, and a text has a row in each ``pass``.
    """
    kind = texts.schema[ident].dataType
    split = texts.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), words(lowered(F.col(text))).alias("w"))

    def run_of(number: int, held: pa.Array, first: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(1)
                size = np.diff(lists.offsets.to_numpy())
                at = pc.index_in(lists.flatten(), value_set=held)
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                cell = np.repeat(np.arange(len(size)), size)[hit] * max(len(held), 1) + at.drop_null().to_numpy()
                cell, tf = np.unique(cell, return_counts=True)
                row, term = np.divmod(cell, max(len(held), 1))
                ends = pa.array(np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32))
                lists_of = lambda v: pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32)))  # noqa: B023, E731
                out = [pa.array(np.full(len(size), number, np.int32)), b.column(0), pa.array(size.astype(np.int32)), lists_of(term + first), lists_of(tf)]
                yield pa.RecordBatch.from_arrays(out, names=["pass", "id", "size", "terms", "tfs"]).filter(pa.array(size > 0))

        return split.mapInArrow(run, f"pass int, id {kind.simpleString()}, size int, terms array<int>, tfs array<int>")

    out = None
    for number in range(max(1, -(-terms.count() // TERMS))):
        first = number * TERMS + 1
        part = [r["term"] for r in terms.where(F.col("n").between(first, first + TERMS - 1)).orderBy("n").collect()]
        one = run_of(number, pa.array(part, pa.string()), first)
        out = one if out is None else out.unionByName(one)
    return out


class _Block:
    """The postings of a task's texts by term, and the ``k`` best of them for each query."""

    def __init__(self, texts: list[pa.RecordBatch], k: int, k1: float):
        table = pa.Table.from_batches(texts).combine_chunks()
        ids, norm, terms, tfs = (table.column(n).chunk(0) for n in ("id", "norm", "terms", "tfs"))
        new = np.ones(len(ids), bool)
        new[1:] = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)  # rows of one text stand together
        self.k, self.ids = k, ids.filter(pa.array(new))
        size = np.diff(terms.offsets.to_numpy())
        doc = np.repeat((np.cumsum(new) - 1).astype(np.int32), size)
        tf = tfs.flatten().to_numpy().astype(np.float64)
        part = tf * (k1 + 1) / (tf + np.repeat(norm.to_numpy(), size))
        flat = terms.flatten().to_numpy()
        order = np.argsort(flat, kind="stable")
        term, doc = flat[order], doc[order]
        once = np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))  # of a text that comes twice the first
        self.doc, self.part = doc[once], part[order][once]
        self.terms, begin = np.unique(term[once], return_index=True)
        self.ends = np.append(begin, len(self.doc))
        self.most = np.maximum.reduceat(self.part, begin)
        self.sums = np.zeros(len(self.ids))

    def best(self, own: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts, in the order of ids, and the scores in millionths, of the ``k`` best for the terms at ``own``.

        Terms are added by what they can give at most. The whole scores of ``k`` texts that look best tell early what the ``k`` best reach at
        least; once the others' terms can't give as much, these are looked up for the texts alone that can still be among the best.
        Scores that are equal to 6 places are never told apart here.
        """
        order = np.argsort(-idf * self.most[own])
        own, idf = own[order], idf[order]
        rest = np.append(np.cumsum((idf * self.most[own])[::-1])[::-1][1:], 0.0)
        begin, end = self.ends[own], self.ends[own + 1]
        seen: list[np.ndarray] = []
        least, tries, narrow = -1.0, 0, None
        for i in range(len(own)):
            docs, parts = self.doc[begin[i] : end[i]], self.part[begin[i] : end[i]]
            if narrow is not None and 3 * len(narrow) < len(docs):
                self.sums[narrow] += idf[i] * self._parts(docs, parts, narrow)
            else:
                self.sums[docs] += idf[i] * parts
                seen.append(docs)
            if narrow is None:
                if tries < TRIES and len(docs) >= self.k and i + 1 < len(own):
                    tries += 1
                    sums = self.sums[docs]
                    top = np.argpartition(sums, len(sums) - self.k)[len(sums) - self.k :]
                    whole = sums[top]
                    for j in range(i + 1, len(own)):
                        whole = whole + idf[j] * self._parts(self.doc[begin[j] : end[j]], self.part[begin[j] : end[j]], docs[top])
                    least = max(least, whole.min() - MARGIN)
                if least > rest[i]:
                    found = self._found(seen)
                    narrow = found[self.sums[found] >= least - rest[i]]
            elif len(narrow) > self.k:
                sums = self.sums[narrow]
                least = max(least, np.partition(sums, len(sums) - self.k)[len(sums) - self.k] - MARGIN)
                narrow = narrow[sums >= least - rest[i]]
        found = self._found(seen) if narrow is None else narrow
        score = np.floor(self.sums[found] * 1e6 + 0.5).astype(np.int64)
        for d in seen:
            self.sums[d] = 0
        if len(found) > self.k:
            last = np.partition(score, len(score) - self.k)[len(score) - self.k]
            above = np.flatnonzero(score > last)
            keep = np.concatenate([above, np.flatnonzero(score == last)[: self.k - len(above)]])
            found, score = found[keep], score[keep]
        return found, score

    @staticmethod
    def _parts(docs: np.ndarray, parts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """What a term with ``docs`` gives to the texts ``wanted``."""
        at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
        return np.where(docs[at] == wanted, parts[at], 0.0)

    def _found(self, seen: list[np.ndarray]) -> np.ndarray:
        """The texts of ``seen``, each once, in order."""
        if len(seen) == 1:
            return seen[0]
        return np.unique(np.concatenate(seen)) if 32 * sum(map(len, seen)) < len(self.sums) else np.flatnonzero(self.sums).astype(np.int32)

    def search(self, queries: pa.RecordBatch) -> pa.RecordBatch:
        """(no, id, score) of the best texts of each query (no, terms, idfs)."""
        terms, idfs = queries.column("terms"), queries.column("idfs").flatten().to_numpy()
        flat, ends = terms.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(terms.offsets.to_numpy())))
        at = np.searchsorted(self.terms, flat)
        there = np.append(self.terms, -1)[at] == flat
        rows, docs, scores = [], [], []
        for r in range(queries.num_rows):
            own = slice(ends[r], ends[r + 1])
            use = there[own]
            if use.any():
                found, score = self.best(at[own][use], idfs[own][use])
                rows.append(np.full(len(found), r))
                docs.append(found)
                scores.append(score)
        row, doc, score = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, docs, scores))
        return pa.RecordBatch.from_arrays([queries.column("no").take(pa.array(row)), self.ids.take(pa.array(doc)), pa.array(score / 1e6)], names=["no", "id", "score"])


def bm25(texts: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75, ident: str = "id", text: str = "content") -> DataFrame:
    """(query_id, id, score, rank): each query's ``k`` best texts by BM25; ``queries`` has (query_id, query), ``texts`` one row per id. Ties go by id.

    Each text is split once, into one written row of the terms that a query has; a term's frequency is counted in them, and text
    numbers and mean sizes are over all texts with words. Texts are dealt out in blocks of about BLOCK_POSTINGS postings; a task holds one and
    takes all queries in a stream, equal ones once, so that no pair of query and text is a row: what leaves a block is at most k rows a query.
    Repeated terms of a query count once. Scores are rounded to 6 places. The result is written once.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(words(lowered(F.col("query"))))).alias("term"))
    terms = materialise(rank_by_range(asked.select("term").distinct(), [], [F.col("term")], "n").select("term", F.col("n").cast("int").alias("n")), "terms")
    every = materialise(postings(texts, terms, ident, text), "postings")
    of = F.when(F.col("pass") == 0, F.col("size"))
    total = every.agg(F.count(of).alias("texts"), F.avg(of).alias("mean"), F.sum(F.size("terms")).alias("postings")).first()
    df = every.select(F.explode("terms").alias("n")).groupBy("n").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(total["texts"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(terms, "term").join(df, "n").select("query_id", F.struct("n", idf.alias("idf")).alias("t"))
    each = materialise(weighed.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t")), "asked")
    sets = materialise(each.select("t").distinct().withColumn("no", F.monotonically_increasing_id()), "sets")

    blocks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-(total["postings"] or 0) // BLOCK_POSTINGS))
    norm = F.lit(k1) * (1 - b + b * F.col("size") / F.lit(total["mean"]))
    held = every.where(F.size("terms") > 0).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", norm.cast("double").alias("norm"), "terms", "tfs")
    wanted = sets.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "no", F.col("t.n").alias("terms"), F.col("t.idf").alias("idfs"))
    both = held.unionByName(wanted, allowMissingColumns=True).repartitionById(blocks, F.col("block")).sortWithinPartitions(F.col("no").isNotNull(), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        block = None
        for x in batches:
            n = x.column("no").null_count  # texts come before queries
            if n:
                own.append(x.slice(0, n))
            if n < x.num_rows and own:
                block = block or _Block(own, k, k1)
                yield block.search(x.slice(n))

    found = both.select("no", "id", "norm", "terms", "tfs", "idfs").mapInArrow(run, f"no bigint, id {texts.schema[ident].dataType.simpleString()}, score double")
    order = W.partitionBy("no").orderBy(F.col("score").desc(), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialise(each.join(sets, "t").join(best, "no").select("query_id", F.col("id").alias(ident), "score", "rank"), "best")
    for stage in (terms, every, each, sets):
        discard(stage)
    return out
