"""The most similar vectors of every vector.

An inverted index by spherical k-means holds vectors as four-bit codes. The codebooks are trained with a score-aware,
anisotropic loss: of the error of a code, the part parallel to the vector counts more, as it shifts the large inner
products. Queries scan the codes of the clusters nearest to themselves, and the best by code are ranked anew with exact cosines.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from juralake.llm.words import mix
from juralake.session import materialise

#: Vectors of each column that the index is trained on, at least, or TRAIN_SHARE for each cluster; every vector is indexed.
TRAIN_ROWS = 16_000
TRAIN_SHARE = 4
#: Clusters per square root of the vectors, and the clusters that each vector searches at least.
CLUSTERS = 0.5
PROBES = 20
#: Part of the five nearest of sample vectors, by brute force in the sample, that must lie in the clusters searched, and
#: how many sample vectors are asked. More clusters are searched until they do.
RECALL = 0.98
ASKED = 1000
#: Clusters that make a cell: its vectors are the candidates of one task, and the queries that search any of them are sent there.
GROUP = 40
#: Candidates of a cell, which then has fewer clusters; queries are any number, as they come in a stream.
CELL_ROWS = 100_000
#: Queries that a task takes from the stream at once, and inner products that it holds.
ASK_ROWS = 4096
PRODUCTS = 8_000_000
#: Vectors by code that are ranked anew exactly.
RERANK = 64
#: Inner products above this share of the norm are the ones whose error counts most.
THRESHOLD = 0.3
#: A cluster with this many times its share of the sample is split on.
SPLIT = 3.0
#: Clusters at most, reached at about a thousand million vectors; beyond, clusters are cut into more cells.
MAX_CLUSTERS = 16_384


def usable_vectors(chunks: DataFrame, models: DataFrame) -> DataFrame:
    """(n, col, id, unit, same): the unit vector (float32 bytes), and a 128-bit digest of it, of every usable vector of every column that ``models`` names.

    Usable are vectors of exactly stored_dims items, none NULL, NaN or infinite, not all zero. ``models`` is the fixed registry of
    vector columns. A vector delivered again comes out again; ``one_each`` sees to that.
    """
    dims = {r["vector_column"]: r["stored_dims"] for r in models.select("vector_column", "stored_dims").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (col, dim) in enumerate(dims.items(), 1):
                lists = b.column(i)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                right = np.flatnonzero((np.diff(offsets) == dim) & lists.is_valid().to_numpy(zero_copy_only=False))
                if not len(right):
                    continue
                values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # NULL items come as NaN
                v = values[offsets[right][:, None] + np.arange(dim)]
                good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
                right, v = right[good], v[good]
                v /= np.abs(v).max(axis=1, keepdims=True, initial=1e-300)
                v = np.ascontiguousarray(v / np.linalg.norm(v, axis=1, keepdims=True), np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([col] * len(right)), b.column(0).take(pa.array(right)), pa.array([x.tobytes() for x in v], pa.binary())], names=["col", "id", "unit"])

    found = chunks.where("id IS NOT NULL").select("id", *dims).mapInArrow(run, "col string, id string, unit binary")
    return found.select(F.monotonically_increasing_id().alias("n"), "col", "id", "unit", F.xxhash64("unit").alias("same"))


@dataclass
class Index:
    """One column's trained index: cluster centres, which clusters each may search, how many each vector does, their cells and the codebooks."""

    dim: int
    centres: np.ndarray
    probes: np.ndarray
    searched: int
    #: The first cell of each cluster, and over how many cells it is dealt out; only a cluster that is too large for one has more.
    cell: np.ndarray
    parts: np.ndarray
    books: np.ndarray  # (subspaces, 16, 2)

    @property
    def n_cells(self) -> int:
        return int((self.cell + self.parts).max())

    def near(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each vector, and the clusters that it searches: of those its cluster may search, the nearest to the vector itself."""
        own = v @ self.centres.T
        cluster = own.argmax(axis=1)
        may = self.probes[cluster]
        if self.searched < may.shape[1]:
            may = np.take_along_axis(may, np.argpartition(-np.take_along_axis(own, may, 1), self.searched - 1, axis=1)[:, : self.searched], 1)
        return cluster, may

    @property
    def weight(self) -> float:
        return (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)

    def pad(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, self.books.shape[0] * 2 - self.dim)))

    def assign(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([(v[i : i + 4096] @ self.centres.T).argmax(axis=1) for i in range(0, len(v), 4096)] or [np.empty(0, np.int64)])

    def encode(self, v: np.ndarray, cluster: np.ndarray, passes: int = 2) -> np.ndarray:
        """Four-bit codes (vectors, subspaces) that minimise the anisotropic loss, one subspace after another."""
        x = np.ascontiguousarray(self.pad(v).T)  # by coordinate, as sums over pairs of coordinates are written out
        t = x - self.pad(self.centres)[cluster].T
        n_sub = len(self.books)
        code = np.empty((n_sub, len(v)), np.uint8)
        along = np.empty((n_sub, len(v)), np.float32)
        for m in range(n_sub):
            r0, r1 = t[2 * m, :, None] - self.books[m, :, 0], t[2 * m + 1, :, None] - self.books[m, :, 1]
            code[m] = (r0 * r0 + r1 * r1).argmin(axis=1)
            b = self.books[m, code[m]]
            along[m] = (t[2 * m] - b[:, 0]) * x[2 * m] + (t[2 * m + 1] - b[:, 1]) * x[2 * m + 1]
        total = along.sum(axis=0)
        every = np.arange(len(v))
        for _ in range(passes):
            for m in range(n_sub):
                rest = total - along[m]
                r0, r1 = t[2 * m, :, None] - self.books[m, :, 0], t[2 * m + 1, :, None] - self.books[m, :, 1]
                own = r0 * x[2 * m, :, None] + r1 * x[2 * m + 1, :, None]
                loss = r0 * r0 + r1 * r1 + (self.weight - 1) * (rest[:, None] + own) ** 2
                code[m] = loss.argmin(axis=1)
                along[m] = own[every, code[m]]
                total = rest + along[m]
        return code.T

    def decode(self, code: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for: each subspace's table looked up."""
        flat = self.books[np.arange(code.shape[1]), code].reshape(len(code), -1)[:, : self.dim]
        return flat + self.centres[cluster]


def _k_means(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = v[rng.choice(len(v), k, replace=False)].copy()
    for _ in range(rounds):
        a = np.concatenate([(v[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(v), 4096)])
        order = np.argsort(a, kind="stable")
        held, first = np.unique(a[order], return_index=True)
        c[held] = np.add.reduceat(v[order], first)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _nearest_centres(centres: np.ndarray, n: int) -> np.ndarray:
    out = []
    for i in range(0, len(centres), 1024):
        near = centres[i : i + 1024] @ centres.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = np.inf  # a cluster searches itself first
        top = np.argpartition(-near, n - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.int32))
    return np.concatenate(out)


def _probes(v: np.ndarray, centres: np.ndarray, rng: np.random.Generator, k: int = 5) -> tuple[np.ndarray, int]:
    """The clusters that each cluster's vectors may search, nearest first, and how many of these each vector searches, those nearest to itself.

    The second is chosen so that the sample's own neighbours are found (RECALL), what the first misses (a quarter of what may be missed) counted.
    """
    cluster = np.concatenate([(v[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(v), 4096)])
    asked = rng.choice(len(v), min(ASKED, len(v)), replace=False)
    if len(v) <= k:
        n = min(PROBES, len(centres))
        return _nearest_centres(centres, n), n
    near, need = [], []
    for i in range(0, len(asked), 250):
        q = asked[i : i + 250]
        s = v[q] @ v.T
        s[np.arange(len(q)), q] = -np.inf
        near.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
        own = centres[cluster[q]] @ centres.T
        reached = np.take_along_axis(own, cluster[near[-1]], axis=1)
        need += [(own > reached[:, j, None]).sum(axis=1) for j in range(k)]
    far = int(np.quantile(np.concatenate(need), 1 - (1 - RECALL) / 4, method="higher")) + 1
    probes = _nearest_centres(centres, min(max(PROBES, far), len(centres)))
    need = []
    for i, of in zip(range(0, len(asked), 250), near, strict=True):
        q = asked[i : i + 250]
        own = v[q] @ centres.T
        may = probes[cluster[q]]
        within = np.take_along_axis(own, may, axis=1)
        for j in range(k):
            at = cluster[of[:, j]]
            before = (within > np.take_along_axis(own, at[:, None], 1)).sum(axis=1)
            need.append(np.where((may == at[:, None]).any(axis=1), before, probes.shape[1]))
    most = int(np.quantile(np.concatenate(need), RECALL, method="higher")) + 1
    return probes, min(max(PROBES, most), probes.shape[1])


def _cells(centres: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The first cell of each cluster, and its number of cells, from the expected vectors of each: neighbouring clusters are in one cell, or in few."""
    n = max(1, round(len(centres) / GROUP), math.ceil(size.sum() / CELL_ROWS))
    n = min(n, len(centres))
    heads = _k_means(centres, n, rng)
    head = (centres @ heads.T).argmax(axis=1)
    chain, left = [0], set(range(1, n))
    while left:
        chain.append(max(left, key=lambda j: (float(heads[chain[-1]] @ heads[j]), -j)))
        left.remove(chain[-1])
    place = np.argsort(chain)
    share = size.sum() / n
    cell, parts = np.zeros(len(centres), np.int64), np.maximum(1, np.ceil(size / CELL_ROWS)).astype(np.int64)
    at, held = 0, 0.0
    for c in sorted(range(len(centres)), key=lambda c: (place[head[c]], -float(centres[c] @ heads[head[c]]), c)):
        if held and (parts[c] > 1 or held + size[c] > CELL_ROWS or at < n - 1 and held + size[c] / 2 > share):
            at, held = at + 1, 0.0
        cell[c] = at
        held += max(size[c], 1.0)
        if parts[c] > 1:
            at, held = at + parts[c], 0.0
    return cell, parts


def clusters_for(n: int) -> int:
    """Clusters of an index of ``n`` vectors."""
    return int(min(max(1, round(CLUSTERS * math.sqrt(n))), MAX_CLUSTERS))


def train(v: np.ndarray, n_vectors: int, seed: int = 7) -> Index:
    """The index of a column from a sample ``v`` of its ``n_vectors`` unit vectors."""
    rng = np.random.default_rng(seed)
    dim = v.shape[1]
    k = min(clusters_for(n_vectors), max(1, len(v) // TRAIN_SHARE))
    centres = _k_means(v, k, rng)
    for _ in range(4):  # dense regions are split on, so that no cluster holds much more than its share
        a = (v @ centres.T).argmax(axis=1)
        size = np.bincount(a, minlength=len(centres))
        big = np.flatnonzero(size > max(SPLIT * len(v) / k, 8))
        if not len(big) or len(centres) > 2 * k:
            break
        parts = [_k_means(v[a == j], int(min(math.ceil(size[j] * k / len(v)), size[j])), rng) for j in big]
        centres = np.concatenate([np.delete(centres, big, axis=0), *parts])
    centres = centres[np.unique((v @ centres.T).argmax(axis=1))]  # an empty one, or one equal to another, would take up a probe
    probes, searched = _probes(v, centres, np.random.default_rng(seed + 1))
    cluster = np.concatenate([(v[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(v), 4096)])
    size = np.bincount(cluster, minlength=len(centres)) * (n_vectors / max(1, len(v)))
    subspaces = (dim + 1) // 2
    index = Index(dim, centres, probes, searched, *_cells(centres, size, rng), np.zeros((subspaces, 16, 2), np.float32))
    x = index.pad(v).reshape(len(v), subspaces, 2)
    t = x - index.pad(centres)[cluster].reshape(x.shape)
    books = np.stack([t[rng.choice(len(v), 16), m] for m in range(subspaces)])
    index.books = (books + rng.normal(0, 1e-4, books.shape)).astype(np.float32)
    extra = index.weight - 1
    sub = np.arange(subspaces)
    for _ in range(5):
        code = index.encode(v, cluster, passes=1)
        along = ((t - index.books[sub, code]) * x).sum(-1)
        for m in range(subspaces):  # each centre by weighted least squares, the other subspaces held
            rest = along.sum(axis=1) - along[:, m]
            xm, tm, c = x[:, m].astype(float), t[:, m].astype(float), code[:, m]
            rhs = tm + extra * xm * (rest + (tm * xm).sum(-1))[:, None]
            a = np.zeros((16, 2, 2)) + 1e-6 * np.eye(2)
            b = 1e-6 * index.books[m].astype(float)
            np.add.at(a, c, np.eye(2) + extra * xm[:, :, None] * xm[:, None, :])
            np.add.at(b, c, rhs)
            index.books[m] = np.linalg.solve(a, b[..., None])[..., 0]
            along[:, m] = ((tm - index.books[m, c]) * xm).sum(-1)
    return index


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


@dataclass
class Cell:
    """A task's candidates, by cluster."""

    index: Index
    n: np.ndarray
    v: np.ndarray
    decoded: np.ndarray
    #: The clusters, and where the candidates of each begin.
    clusters: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, x: Index, held: pa.Table) -> Cell:
        n, cluster = held.column("n").to_numpy(), held.column("cluster").to_numpy()
        order = np.lexsort((n, cluster))  # the same result whatever order rows arrive in
        n, cluster = n[order], cluster[order]
        packed = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(n), -1)[order]
        code = np.stack([packed >> 4, packed & 15], axis=-1).reshape(len(n), -1)[:, : x.books.shape[0]]
        clusters, start = np.unique(cluster, return_index=True)
        return cls(x, n, _unit(held.column("unit"), x.dim)[order], x.decode(code, cluster), clusters, np.r_[start, len(n)])

    def ask(self, asks: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
        """(n, best) for queries: the k best candidates in the clusters that each searches here, and those equal to the last of them."""
        n, cluster, v = asks.column("n").to_numpy(), asks.column("cluster").to_numpy(), _unit(asks.column("unit"), self.index.dim)
        lists = [np.frombuffer(p, np.uint16) for p in asks.column("probes").to_pylist()]
        at = np.searchsorted(self.clusters, flat := np.concatenate(lists))
        here = (at < len(self.clusters)) & (self.clusters[np.minimum(at, len(self.clusters) - 1)] == flat)
        member = np.zeros((len(n), len(self.clusters)), bool)
        member[np.repeat(np.arange(len(n)), [len(p) for p in lists])[here], at[here]] = True
        width = np.diff(self.start)
        for c in np.unique(cluster):
            rows = np.flatnonzero(cluster == c)
            total = width[member[rows].any(axis=0)].sum()
            step = int(max(1, min(512, PRODUCTS // max(1, total))))
            for i in range(0, len(rows) if total else 0, step):
                yield from self._block(n[rows[i : i + step]], v[rows[i : i + step]], member[rows[i : i + step]], k)

    def _block(self, n: np.ndarray, v: np.ndarray, member: np.ndarray, k: int, fold: int = 16) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(member.any(axis=0))
        data = np.concatenate([np.arange(self.start[j], self.start[j + 1]) for j in used] or [np.empty(0, np.int64)])
        if not len(data):
            return
        wide = -(-len(data) // fold)
        by_code = np.full((len(n), wide * fold), -np.inf, np.float32)
        a = 0
        for j in used:
            d = self.decoded[self.start[j] : self.start[j + 1]]
            rows = np.flatnonzero(member[:, j])
            by_code[rows, a : a + len(d)] = v[rows] @ d.T
            a += len(d)
        r = min(RERANK + 1, len(data))  # with the query itself
        if wide > r:  # the best r lie in the r columns of the folded matrix whose best are best
            top = np.argpartition(-by_code.reshape(len(n), fold, wide).max(axis=1), r - 1, axis=1)[:, :r]
            cols = (top[:, None, :] + wide * np.arange(fold)[:, None]).reshape(len(n), -1)
            cols = np.take_along_axis(cols, np.argpartition(-np.take_along_axis(by_code, cols, 1), r - 1, axis=1)[:, :r], 1)
        else:
            cols = np.argpartition(-by_code, r - 1, axis=1)[:, :r]
        best = data[np.minimum(cols, len(data) - 1)]
        near = np.matmul(self.v[best], v[:, :, None])[:, :, 0]
        near[~np.isfinite(np.take_along_axis(by_code, cols, 1)) | (self.n[best] == n[:, None])] = -np.inf
        least = np.partition(near, r - k, axis=1)[:, r - k] if r > k else np.full(len(n), -np.inf, np.float32)
        q, j = np.nonzero((near >= least[:, None] - 1e-5) & np.isfinite(near))  # single precision errs by less
        if not len(q):
            return
        m = best[q, j]
        far = -np.einsum("id,id->i", v[q].astype(float), self.v[m].astype(float))
        order = np.lexsort((self.n[m], far, q))
        q, m, far = q[order], m[order], far[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        count = np.diff(np.r_[first, len(q)])
        last = far[first + np.minimum(count, k) - 1]
        keep = far <= np.repeat(last, count)
        kept = np.add.reduceat(keep, first, dtype=np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(far[keep]), pa.array(self.n[m[keep]])], names=["far", "m"])
        yield pa.RecordBatch.from_arrays([pa.array(n[q[first]]), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)], pa.int32()), pairs)], names=["n", "best"])


def search(vectors: DataFrame, indexes: dict[str, Index], k: int) -> DataFrame:
    """(col, n, id, m, neighbour, cosine, rank): for every vector the ``k`` others of its column that the index finds most similar.

    n and m are the numbers of id and neighbour; equal cosines go by neighbour. ``vectors`` are all different.

    Each vector is a candidate, with its code, in the cell of its cluster alone; as a query it goes to the cells that hold the
    clusters it searches. A task holds a cell's candidates and takes queries in a stream. What leaves it are numbers and cosines;
    the k best of all cells are named in the end.
    """
    first, n_cells = {}, 0
    for col, x in indexes.items():
        first[col] = n_cells
        n_cells += x.n_cells

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = np.array(b.column(1).to_pylist())
            for col in np.unique(cols):
                x = indexes[col]
                own = np.flatnonzero(cols == col)
                v = _unit(b.column(2).take(pa.array(own)), x.dim)
                cluster, probes = x.near(v)
                code = x.encode(v, cluster)
                if code.shape[1] % 2:
                    code = np.pad(code, ((0, 0), (0, 1)))
                packed = pa.array([p.tobytes() for p in (code[:, ::2] << 4) | code[:, 1::2]], pa.binary())
                n = b.column(0).to_numpy(zero_copy_only=False)[own]
                home = x.cell[cluster] + (mix(n.astype(np.uint64)) % x.parts[cluster].astype(np.uint64)).astype(np.int64)
                p = probes.ravel()
                parts = x.parts[p]
                row, p = np.repeat(np.repeat(np.arange(len(own)), probes.shape[1]), parts), np.repeat(p, parts)
                cell = x.cell[p] + np.arange(len(p)) - np.repeat(np.cumsum(parts) - parts, parts)
                order = np.lexsort((p, cell, row))
                row, p, cell = row[order], p[order], cell[order]
                begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])
                row, cell, ends = row[begin], cell[begin], (np.r_[begin, len(p)] * 2).astype(np.int32)
                at = pa.array(row)
                lists = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(p.astype(np.uint16))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([col] * len(row)), pa.array((first[col] + cell).astype(np.int32)), pa.array(n[row]), pa.array(cluster[row].astype(np.int32)), packed.take(pa.array(row, mask=cell != home[row])), b.column(2).take(pa.array(own[row])), lists],
                    names=["col", "cell", "n", "cluster", "code", "unit", "probes"],
                )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, asks = None, [], []
        for b in batches:  # all of one cell, candidates first
            h = b.num_rows - b.column("code").null_count
            if h and cell is None:
                held.append(b.slice(0, h))
            if h < b.num_rows and held:
                if cell is None:
                    cell, asks = Cell.of(indexes[b.column("col")[0].as_py()], pa.Table.from_batches(held)), list(held)
                asks.append(b.slice(h))
                if sum(x.num_rows for x in asks) >= ASK_ROWS:
                    yield from _asked(cell, asks)
                    asks = []
        if held and cell is None:
            cell, asks = Cell.of(indexes[held[0].column("col")[0].as_py()], pa.Table.from_batches(held)), held
        if asks:
            yield from _asked(cell, asks)

    def _asked(cell: Cell, asks: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches(asks)
        for i in range(0, every.num_rows, ASK_ROWS):
            yield from cell.ask(every.slice(i, ASK_ROWS), k)

    rows = vectors.select("n", "col", "unit").mapInArrow(index_rows, "col string, cell int, n bigint, cluster int, code binary, unit binary, probes binary")
    dealt = rows.repartitionById(max(1, n_cells), F.col("cell")).sortWithinPartitions(F.col("code").isNull(), "cluster", "n")
    found = dealt.mapInArrow(scan, "n bigint, best array<struct<far double, m bigint>>")
    every = found.groupBy("n").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("best"))
    best = every.select("n", F.explode(F.filter("best", lambda x: x["far"] <= F.col("best")[F.least(F.size("best"), F.lit(k)) - 1]["far"])).alias("b"))  # more, if equal
    names = vectors.select("n", "col", "id")
    links = best.select("n", F.col("b.m").alias("m"), (-F.col("b.far")).alias("cosine"))
    named = links.join(names.select(F.col("n").alias("m"), F.col("id").alias("neighbour")), "m").join(names, "n")
    ranked = W.partitionBy("n").orderBy(F.col("cosine").desc(), "neighbour")
    return named.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("col", "n", "id", "m", "neighbour", "cosine", "rank")


def train_all(vectors: DataFrame, dims: dict[str, int], train_rows: int = TRAIN_ROWS) -> dict[str, Index]:
    """An index per column, from the vectors with the smallest hashes: ``train_rows``, or TRAIN_SHARE a cluster if those are more."""
    counts = {r["col"]: r["c"] for r in vectors.groupBy("col").agg(F.count("*").alias("c")).collect()}
    out = {}
    for col in sorted(counts):
        most = max(train_rows, TRAIN_SHARE * clusters_for(counts[col]))
        part = min(1.0, most / counts[col])
        picked = vectors.where((F.col("col") == col) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(part * (1 << 20))))
        sample = sorted((bytes(r["unit"]) for r in picked.select("unit").limit(2 * most).collect()))
        out[col] = train(np.frombuffer(b"".join(sample), np.float32).reshape(-1, dims[col]), counts[col])
    return out


def nearest(chunks: DataFrame, models: DataFrame, k: int = 5) -> DataFrame:
    """(col, id, rank, neighbour, cosine): the ``k`` most similar chunks of the same column for every usable vector.

    Every chunk id counts once. Chunks of equal vectors are one entry of the index; each copy's neighbours are its fellow copies
    (by id, at most k), then those of the entry, so any number of copies costs no more than their count times k. Ties go by id.
    A column with one usable vector gives no rows; vectors are all queries, and all are searched.
    """
    dims = {r["vector_column"]: r["stored_dims"] for r in models.select("vector_column", "stored_dims").collect()}
    v = materialise(usable_vectors(chunks, models), "vectors")
    slim = v.select("n", "col", "id", "same")
    entry = slim.groupBy("col", "same").agg(F.min("n").alias("entry"), F.count("*").alias("c"))
    # Written, so that Spark knows how few they are, as a rule, and needn't shuffle all vectors to leave them out.
    copied = materialise(slim.join(entry.where("c > 1"), ["col", "same"]).select("n", "entry", "col", "id"), "copied")
    spare = copied.where("n <> entry").select("n")
    entries = v.join(spare, "n", "left_anti")
    links = materialise(search(entries, train_all(entries, dims), k), "neighbours")
    # Entries that stand for copies, and those that have such a neighbour, are ranked anew; the others' ranks stand.
    copies = copied.select("entry", "col", "id").distinct()
    many = copies.select(F.col("entry").alias("m")).distinct()
    touched = materialise(links.join(many, "m", "left_semi").select("n").union(many.select("m")).distinct(), "touched")
    plain = links.join(touched, "n", "left_anti").select("col", "id", "rank", "neighbour", "cosine")
    first = W.partitionBy("entry").orderBy("id")
    some = copies.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("entry", F.col("id").alias("other"))
    reached = links.join(touched, "n", "left_semi").join(some.withColumnRenamed("entry", "m"), "m", "left")
    named = reached.select("n", "col", "id", F.coalesce("other", "neighbour").alias("neighbour"), "cosine")
    best = W.partitionBy("n").orderBy(F.col("cosine").desc(), "neighbour")
    few = named.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    own = few.join(copies.select(F.col("entry").alias("n"), F.col("id").alias("copy")), "n", "left").select("col", F.coalesce("copy", "id").alias("id"), "neighbour", "cosine")
    fellows = copies.join(some, "entry").select("col", "id", F.col("other").alias("neighbour"), F.lit(1.0).alias("cosine"))
    ranked = W.partitionBy("col", "id").orderBy(F.col("cosine").desc(), "neighbour")
    again = own.unionByName(fellows).where("id <> neighbour").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return plain.unionByName(again.select(*plain.columns))


def similar_pairs(near: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: neighbours of cosine at least ``least``, each pair once; the cosine is exact."""
    a, b = F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")
    return near.where(F.col("cosine") >= least).select(a, b).distinct()
