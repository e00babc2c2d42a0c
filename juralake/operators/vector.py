"""Exact vector search for batches of queries, with thresholds, collections and metadata conditions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors in a block; a task multiplies one block of queries with one of candidates.
BLOCK = 2048


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vector columns in double precision; 0 where either has no length, NULL for NULL or unequal sizes.

    For a query or two; batches go through ``search``, which multiplies matrices instead.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0)))


def usable(vector: str, dim: int | None = None) -> Column:
    """Whether a vector is neither NULL nor all zero, without NULL, NaN or infinite items, and of ``dim`` items if given."""
    sound = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('infinity')) AND exists({vector}, x -> x <> 0)"
    return F.expr(f"coalesce({vector} IS NOT NULL AND size({vector}) > 0 AND {sound}, false)") & (F.size(vector) == dim if dim else F.lit(True))


def _packed(df: DataFrame, ident: str, vector: str, extra: str | None, within: str | None) -> DataFrame:
    """Blocks of up to BLOCK rows of one size and one value of ``within``: ids, bytes of the vectors as they come (floats or doubles), and
    ``extra`` (an INT) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in (b.slice(i, BLOCK) for i in range(0, b.num_rows, BLOCK)):
                lists = s.column(1)
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                flat = flat if flat.dtype in (np.float32, np.float64) else flat.astype(np.float64)
                begin = np.cumsum(size) - size
                groups = pc.fill_null(s.column(3), "").dictionary_encode()
                cell = size.astype(np.int64) * len(groups.dictionary) + groups.indices.to_numpy()
                for c in np.unique(cell):  # vectors of different columns, models or groups never meet
                    own = np.flatnonzero(cell == c)
                    dim = int(size[own[0]])
                    v = flat[begin[own][:, None] + np.arange(dim)]
                    at = pa.array(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), s.column(3).take(at[:1]), pa.array([s.column(0).take(at).to_pylist()], pa.list_(s.column(0).type)), pa.array([v.tobytes()], pa.binary()), pa.array([s.column(2).take(at).to_pylist()], pa.list_(pa.int32()))],
                        names=["dim", "grp", "ids", "vectors", "extra"],
                    )

    kind = df.select(ident).schema[0].dataType.simpleString()
    held = df.where(usable(vector) & (F.col(within).isNotNull() if within else F.lit(True)))
    picked = held.select(F.col(ident), F.col(vector), (F.col(extra) if extra else F.lit(None)).cast("int").alias("extra"), (F.col(within).cast("string") if within else F.lit("")).alias("grp"))
    return picked.mapInArrow(run, f"dim int, grp string, ids array<{kind}>, vectors binary, extra array<int>")


def _block_pairs(base: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block of candidates beside every block of queries of its size and group, over as many tasks as the session shuffles to.

    Candidates' blocks are dealt out by a salt, and queries' blocks go to every salt, so that one size and one group, which may
    be all there is, don't make one task.
    """
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = base.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"))
    q = queries.select("dim", "grp", F.col("ids").alias("qids"), F.col("vectors").alias("qv"), F.col("extra").alias("qe"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"))
    return x.join(q, ["dim", "grp", "salt"]).select("dim", "ids", "vectors", "extra", "qids", "qv", "qe")


def _similarities(b: pa.RecordBatch, r: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Ids of queries and candidates of a pair of blocks, and their cosines to 6 places."""
    of = {n: b.column(i)[r] for i, n in enumerate(b.schema.names)}
    dim = of["dim"].as_py()
    unit = []
    for name, rows in (("qv", len(of["qids"].values)), ("vectors", len(of["ids"].values))):
        raw = of[name].as_buffer()
        v = np.frombuffer(raw, np.float64 if len(raw) == 8 * rows * dim else np.float32).reshape(-1, dim).astype(np.float64)
        unit.append(v / np.linalg.norm(v, axis=1, keepdims=True))
    return of["qids"].values, of["ids"].values, np.round(unit[0] @ unit[1].T, 6)


def search(base: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.0, base_id: str = "id", base_vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding", limit: str | None = None, exclude_self: bool = False, within: str | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): each query's ``k`` most similar rows of cosine above ``threshold`` (strictly).

    ``limit`` names an INT column of ``queries`` with each query's own k (NULL: ``k``); ``within`` a column of both, in which a query and
    its hits must agree (NULL agrees with nothing). Similarities are rounded to 6 places, ties go by id. Unusable vectors, on
    either side, match nothing; empty tables give no rows. A query set meets all rows block by block; what leaves a pair of
    blocks is at most k rows a query and their ties, and the final cut limits groups before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qids, ids, sim = _similarities(b, r)
                own = b.column(6)[r].values
                take = pc.fill_null(own, k).to_numpy(zero_copy_only=False).astype(np.int64) if len(own) else np.empty(0, np.int64)
                good = sim > threshold
                if exclude_self:
                    good &= np.array(ids.to_pylist(), object)[None, :] != np.array(qids.to_pylist(), object)[:, None]
                good[take <= 0] = False
                for n in np.unique(take[(take > 0) & (take < len(ids))]):  # ties at the last place all stay for the final order
                    rows = np.flatnonzero(take == n)
                    held = np.where(good[rows], sim[rows], -np.inf)
                    good[rows] &= sim[rows] >= np.partition(held, len(ids) - n, axis=1)[:, len(ids) - n, None]
                i, j = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(sim[i, j]), pa.array(take[i].astype(np.int32))], names=["q", "i", "similarity", "take"])

    qkind, ikind = queries.select(query_id).schema[0].dataType, base.select(base_id).schema[0].dataType
    pairs = _block_pairs(_packed(base, base_id, base_vector, None, within), _packed(queries, query_id, query_vector, limit, within))
    found = pairs.mapInArrow(run, f"q {qkind.simpleString()}, i {ikind.simpleString()}, similarity double, take int")
    order = W.partitionBy("q").orderBy(F.col("similarity").desc(), "i")
    most = F.lit(k) if limit is None else F.col("take")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(F.col("q").alias(query_id), "rank", F.col("i").alias(base_id), "similarity")


def best_of_groups(base: DataFrame, queries: DataFrame, group: str, base_id: str = "id", base_vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding") -> DataFrame:
    """(query_id, group, score, best): the most similar row of each ``group`` (an INT) of ``base`` for each query, the smallest id of equals.

    Late interaction with groups as documents and their rows as sentences. A pair of blocks gives one row per query and group,
    and these are aggregated before their shuffle; no pair of vectors is a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qids, ids, sim = _similarities(b, r)
                order = np.array(pc.sort_indices(ids))
                label = b.column(3)[r].values.to_numpy(zero_copy_only=False)[order]
                for g in np.unique(label):
                    own = order[label == g]
                    at = sim[:, own].argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([qids, pa.array(np.full(len(qids), g, np.int32)), pa.array(sim[np.arange(len(qids)), own[at]]), ids.take(pa.array(own[at]))], names=["q", "g", "score", "best"])

    qkind, ikind = queries.select(query_id).schema[0].dataType, base.select(base_id).schema[0].dataType
    held = base.where(F.col(group).isNotNull())
    pairs = _block_pairs(_packed(held, base_id, base_vector, group, None), _packed(queries, query_id, query_vector, None, None))
    found = pairs.mapInArrow(run, f"q {qkind.simpleString()}, g int, score double, best {ikind.simpleString()}")
    return found.groupBy(F.col("q").alias(query_id), F.col("g").alias(group)).agg(F.max("score").alias("score"), F.min_by("best", F.struct(-F.col("score"), F.col("best"))).alias("best"))


def matches_conditions(metadata: Mapping[str, Column], conditions: Sequence[Mapping[str, str]] | None) -> Column:
    """Whether a row meets any of ``conditions``, each of which asks for all of its keys; absent keys are wildcards.

    None lets every row pass, an empty list none. Compiled to plain comparisons, so that they can be pushed down.
    """
    if conditions is None:
        return F.lit(True)
    out = F.lit(False)
    for c in conditions:
        one = F.lit(True)
        for key, value in c.items():
            one = one & F.coalesce(metadata[key] == value, F.lit(False))
        out = out | one
    return out


# Sources that can be chosen, and the metadata that each stands for.
FILTERS: dict[str, dict[str, str]] = {
    "decrets": {"source_api": "legifrance", "doc_type": "decret"},
    "lois": {"source_api": "legifrance", "doc_type": "loi"},
    "reglements": {"source_api": "legifrance", "doc_type": "reglement"},
    "codes": {"source_api": "legifrance", "doc_type": "code_article"},
    "cour_de_cassation": {"source_api": "judilibre", "jurisdiction_detail": "cour_cassation"},
    "cours_appel": {"source_api": "judilibre", "jurisdiction_detail": "cour_appel"},
    "tribunaux_judiciaires": {"source_api": "judilibre", "jurisdiction_detail": "tribunal_judiciaire"},
    "conseil_etat": {"source_api": "legifrance", "jurisdiction_detail": "conseil_etat"},
    "cours_administratives_appel": {"source_api": "legifrance", "jurisdiction_detail": "cour_administrative_appel"},
    "tribunaux_administratifs": {"source_api": "legifrance", "jurisdiction_detail": "tribunal_administratif"},
    "constitution_1946": {"doc_type": "texte_constitutionnel", "text_id": "CONSTITUTION_1946"},
    "constitution_1848": {"doc_type": "texte_constitutionnel", "text_id": "CONSTITUTION_1848"},
    "constitution_1958": {"doc_type": "texte_constitutionnel", "text_id": "CONSTITUTION_1958"},
    "bofip": {"source_api": "bofip"},
    "cnil": {"source_api": "cnil"},
    "reglements_eu": {"source_api": "eurlex", "doc_type": "reglement_eu"},
    "directives_eu": {"source_api": "eurlex", "doc_type": "directive_eu"},
    "cjue": {"source_api": "eurlex", "jurisdiction_detail": "cjue"},
    "cedh_cour": {"source_api": "hudoc"},
    "tribunal_fonction_publique": {"source_api": "eurlex", "jurisdiction_detail": "tribunal_fonction_publique"},
    "tue": {"source_api": "eurlex", "jurisdiction_detail": "tue"},
    "cedh_traite": {"doc_type": "traite", "treaty_name": "CEDH"},
}


#: Keys of conditions that a search looks at; the others of FILTERS count only if they are asked for.
CONDITION_KEYS = ("source_api", "doc_type", "jurisdiction_detail")


def resolve_filters(keys: Sequence[str] | None, every_key: bool = False) -> list[dict[str, str]] | None:
    """The conditions of filter keys; None, that is no filter, for none, for all of them, or if none is known. Unknown keys are skipped.

    Conditions hold CONDITION_KEYS alone unless ``every_key``, so the three constitutions are one condition, and stand once each.
    """
    if not keys or set(keys) >= set(FILTERS):
        return None
    out: list[dict[str, str]] = []
    for k in keys:
        one = {n: v for n, v in FILTERS.get(k, {}).items() if every_key or n in CONDITION_KEYS}
        if one and one not in out:
            out.append(one)
    return out or None
