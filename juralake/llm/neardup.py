"""Near-duplicate records with small edits.

Texts become shingles of words with TF-IDF weights. Improved consistent weighted sampling draws samples that two texts
share with the probability of their weighted Jaccard similarity; bands of samples give candidate pairs, which are
verified by the exact share of distinct shingles alone.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juralake.llm.words import mix, shingle_hashes, word_hashes
from juralake.session import discard, materialise

#: Weights lie within this factor of each other, so a pair of share s with equal frequencies has weighted similarity of at
#: least s / (s + WEIGHT_RANGE (1 - s)), however common what it shares is: 0.5 for a share of 0.6, 0.73 for 0.8.
WEIGHT_RANGE = 1.5
#: Samples in a band and bands: pairs of weighted similarity 0.5 are found with probability 0.973, of 0.6 with 0.9996.
BAND_ROWS = 4
BANDS = 56
#: Shingles in at least this share of the texts have their own IDF; rarer ones share that of this frequency. No more than
#: (shingles of a mean text) / COMMON of them exist, so their table is bounded whatever the corpus.
COMMON = 1e-3
#: Counters that find which shingles may be common; several times as many as common shingles can be.
COUNTERS = 1 << 20
#: Random triples of the sampling, shared by shingles of one hash slot.
POOL = 1 << 13
#: Texts, or pairs of texts, that a worker holds unpacked at a time; so few that their arrays stay in its cache.
SLICE = 300
#: Texts of a band whose pairs one task lists; the pairs of a larger band are dealt out in blocks of so many by so many.
BLOCK = 1000
#: Representatives that each text of a band is compared with, one after another, before what is left is compared pairwise.
PEELS = 3


def shingled(texts: DataFrame, key: str, text: str, n: int, least_words: int) -> DataFrame:
    """(key, same, shingles): one row per row of ``texts``; whole texts are read.

    ``same`` is a 128-bit digest of the words in order, NULL for NULL and wordless texts; ``shingles`` are the 32-bit hashes of
    ``n`` words in order, repeats kept, and empty for texts of fewer than ``least_words`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n_words = word_hashes(b.column(1).to_pylist())
            ends = np.cumsum(n_words)
            same = [hashlib.blake2b(words[e - k : e].tobytes(), digest_size=16).digest() if k else None for e, k in zip(ends, n_words, strict=True)]
            keep = n_words >= max(least_words, n)
            code, count = shingle_hashes(words[np.repeat(keep, n_words)], np.where(keep, n_words, 0), n)
            offsets = np.r_[0, np.cumsum(count)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(code.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), lists], names=["key", "same", "shingles"])

    plain = texts.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "key string, same binary, shingles array<int>")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the length of each list."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.diff(offsets)


def _keys(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text its distinct shingles in rising order, as text number times 2**32 plus shingle, and the frequency of each."""
    key = (np.repeat(np.arange(len(count), dtype=np.uint64), count) << np.uint64(32)) | code
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.diff(np.r_[first, len(key)])


def _distinct(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its distinct shingles in rising order: text number, shingle and frequency."""
    key, tf = _keys(code, count)
    return (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32), tf


def common_shingles(texts: DataFrame, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (rising) in at least COMMON of all texts and the number of texts of each, counted over all texts.

    A first pass counts in COUNTERS slots; only shingles of slots that reach the bound are counted one by one in a second.
    Each task hands on the slots that it has met, which Spark adds up before and after their shuffle. Slots that reach the
    bound are no more than (shingles of a mean text) / COMMON, and COUNTERS at most; they go to the driver.
    """
    bound = max(2.0, COMMON * n_texts)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            _, code, _ = _distinct(*_flat(b.column(0)))
            total += np.bincount((code >> 12).astype(np.int64), minlength=COUNTERS)
        met = np.flatnonzero(total)
        for i in range(0, len(met), 1 << 16):
            part = met[i : i + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"slot": part.astype(np.int32), "n": total[part]})

    counted = texts.select("shingles").mapInArrow(slots, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= bound)
    heavy = np.zeros(COUNTERS, bool)
    heavy[counted.select("slot").toPandas()["slot"].to_numpy(np.int64)] = True

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for b in batches:
            _, code, _ = _distinct(*_flat(b.column(0)))
            one, n = np.unique(code[heavy[(code >> 12).astype(np.int64)]], return_counts=True)
            for c, k in zip(one.tolist(), n.tolist(), strict=True):
                held[c] = held.get(c, 0) + k
        if held:
            yield pa.RecordBatch.from_pydict({"code": np.array([*held], np.int64), "n": np.array([*held.values()], np.int64)})

    common = texts.select("shingles").mapInArrow(exact, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= bound).toPandas()
    code = common["code"].to_numpy(np.int64).astype(np.uint32)
    order = np.argsort(code)
    return code[order], common["n"].to_numpy(np.int64)[order]


class Weights:
    """TF-IDF weights: (1 + ln tf) times ln(1 + texts / df), df being at least COMMON of the texts, all within WEIGHT_RANGE."""

    def __init__(self, n_texts: int, common: np.ndarray, df: np.ndarray) -> None:
        self.common = common
        self.idf = np.log1p(n_texts / np.maximum(df, 1)).astype(np.float32)
        self.rare = np.float32(np.log1p(n_texts / max(1.0, COMMON * n_texts)))

    def of(self, code: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.full(len(code), self.rare, np.float32)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, code), len(self.common) - 1)
            idf = np.where(self.common[at] == code, np.minimum(self.idf[at], self.rare), idf)
        return np.clip(idf * (1 + np.log(tf.astype(np.float32))), self.rare / np.float32(WEIGHT_RANGE), self.rare)


@functools.cache
def _pool(samples: int) -> np.ndarray:
    """For each sample POOL random triples of consistent weighted sampling: r, 1/r, ln c - r and beta."""
    rng = np.random.default_rng(20)
    r = rng.gamma(2.0, 1.0, (samples, POOL))
    ln_c = np.log(rng.gamma(2.0, 1.0, (samples, POOL)))
    return np.stack([r, 1 / r, ln_c - r, rng.uniform(0, 1, (samples, POOL))], axis=-1).astype(np.float32)


def samples(text: np.ndarray, code: np.ndarray, weight: np.ndarray, n_samples: int) -> np.ndarray:
    """Improved consistent weighted samples of texts 0, 1, ... that each have a shingle: an array (texts, n_samples).

    Sample k of a text is the shingle and level that minimise ln c - r (t - beta + 1), where t = floor(ln w / r + beta).
    """
    start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    length = np.diff(np.r_[start, len(text)])
    out = np.empty((len(start), n_samples), np.uint64)
    ln_w = np.log(weight).astype(np.float32)
    pool = _pool(n_samples)
    odd = np.random.default_rng(21).integers(1, 2**63, n_samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    code = mix(code.astype(np.uint64) + np.uint64(1))
    for k in range(n_samples):
        slot = (code * odd[k]) >> np.uint64(64 - 13)
        r, inv, base, beta = pool[k].take(slot.view(np.int64), axis=0).T
        level = np.floor(ln_w * inv + beta)
        value = base - r * (level - beta)
        least = np.minimum.reduceat(value, start)
        hit = np.flatnonzero(value == np.repeat(least, length))
        own = text[hit]
        hit = hit[np.r_[True, own[1:] != own[:-1]]]
        out[:, k] = mix(code[hit] + level[hit].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def bands(texts: DataFrame, weights: Weights) -> DataFrame:
    """(band, n, size): BANDS rows per text with its number of distinct shingles; two texts share a band if they agree in all of
    its BAND_ROWS samples. Texts without shingles have none."""
    spread = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in (b.slice(i, SLICE) for i in range(0, b.num_rows, SLICE)):
                text, code, tf = _distinct(*_flat(s.column(1)))
                if not len(text):
                    continue
                own = np.unique(text)
                drawn = samples(text, code, weights.of(code, tf), BANDS * BAND_ROWS).reshape(len(own), BANDS, BAND_ROWS)
                key = np.zeros((len(own), BANDS), np.uint64) + spread
                for i in range(BAND_ROWS):
                    key = mix(key * np.uint64(3) + drawn[:, :, i])
                n = np.repeat(s.column(0).to_numpy(zero_copy_only=False)[own], BANDS)
                size = np.repeat(np.bincount(text)[own], BANDS)
                yield pa.RecordBatch.from_pydict({"band": key.ravel().view(np.int64), "n": n, "size": size.astype(np.int32)})

    return texts.select("n", "shingles").mapInArrow(run, "band bigint, n bigint, size int")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(band, n, size, whole) of neighbouring rows of equal bands in batches sorted by band, BLOCK rows of one at most at a time;
    not whole are the parts of a larger band. Bands of one row are left out."""
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
    split = False
    for b in batches:
        held = [np.r_[h, c.to_numpy(zero_copy_only=False)] for h, c in zip(held, b.columns, strict=True)]
        band = held[0]
        start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]]) if len(band) else np.empty(0, np.int64)
        ends = np.r_[start[1:], len(band)]
        for s, e in zip(start[:-1].tolist(), ends[:-1].tolist(), strict=True):
            if e - s > 1 or split:
                for i in range(s, e, BLOCK):
                    yield (*(h[i : min(i + BLOCK, e)] for h in held), not split and e - s <= BLOCK)
            split = False
        if len(start):  # the last band may go on in the next batch
            held = [h[start[-1] :] for h in held]
            while len(held[0]) > BLOCK:
                yield (*(h[:BLOCK] for h in held), False)
                held = [h[BLOCK:] for h in held]
                split = True
    if len(held[0]) > 1 or split and len(held[0]):
        yield (*held, not split)


def candidate_pairs(banded: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: numbers of texts that share a band, each pair once.

    Pairs whose numbers of distinct shingles alone keep their share under ``threshold`` are left out. Bands are sorted within
    their partitions and read as a stream, so one exchange serves them; a band of more than BLOCK texts is handed on, and
    its pairs are dealt out over blocks by blocks of it. Every pair of texts that do belong together is a row of the result
    that is asked for, so there are as many as it has links, and some more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _joined_pairs(_groups(batches), threshold):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=["band", "a", "b", "size"])

    sorted_bands = banded.select("band", "n", "size").repartition("band").sortWithinPartitions("band", "n")
    found = materialise(sorted_bands.mapInArrow(run, "band bigint, a bigint, b bigint, size int"), "candidates")
    few = found.where("b >= 0").select("a", "b")
    large = found.where("b < 0").select("band", F.col("a").alias("n"), "size")
    blocks = large.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = large.join(blocks, "band").withColumn("i", F.pmod(F.xxhash64("n"), F.col("blocks")))
    across = F.explode(F.expr("sequence(0L, blocks - 1)"))  # a row goes to all pairs of its block, on one side by one
    x = placed.select("band", F.col("n").alias("a"), F.col("size").alias("size_a"), "i", across.alias("j"))
    y = placed.select("band", F.col("n").alias("b"), F.col("size").alias("size_b"), F.col("i").alias("j"), across.alias("i"))
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold
    return few.unionByName(x.join(y, ["band", "i", "j"]).where("a < b").where(fits).select("a", "b")).distinct()


def _joined_pairs(groups: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]], threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Flat (band, a, b, size) of the pairs of each group that may reach ``threshold``; b is -1 for the rows of parts of a band."""
    out: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for band, n, size, whole in groups:
        if whole:
            i, j = np.triu_indices(len(n), 1)
            fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
            i, j = i[fits], j[fits]
            out.append((band[i], np.minimum(n[i], n[j]), np.maximum(n[i], n[j]), size[i].astype(np.int32)))
        else:
            out.append((band, n, np.full(len(n), -1), size.astype(np.int32)))
        rows += len(out[-1][0])
        if rows > 20_000:
            yield tuple(np.concatenate(c) for c in zip(*out, strict=True))
            out, rows = [], 0
    if out:
        yield tuple(np.concatenate(c) for c in zip(*out, strict=True))


def stars(banded: DataFrame) -> DataFrame:
    """(band, a, b): every text b of a band but its smallest, a, with it; as many rows as bands have texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rep = None, 0
        for band, n, _, _ in _groups(batches):
            same = last == band[0]
            rep = rep if same else n[0]
            last = band[0]
            rest = slice(0 if same else 1, None)
            yield pa.RecordBatch.from_pydict({"band": band[rest], "a": np.full(len(n[rest]), rep), "b": n[rest]})

    sorted_bands = banded.select("band", "n", "size").repartition("band").sortWithinPartitions("band", "n")
    return sorted_bands.mapInArrow(run, "band bigint, a bigint, b bigint")


def verified_pairs(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """(a, b, weighted, share): those of ``pairs`` whose exact share reaches ``threshold``, with both similarities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            (a, a_tf), (c, c_tf) = _keys(*_flat(b.column(2))), _keys(*_flat(b.column(3)))
            m = b.num_rows
            size_a, size_c = (np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=m) for x in (a, c))
            at = np.searchsorted(a, c) if len(a) < len(c) else np.searchsorted(c, a)
            less, more = (a, c) if len(a) < len(c) else (c, a)
            twin = np.flatnonzero(less[np.minimum(at, len(less) - 1)] == more) if len(less) else np.empty(0, np.int64)
            pair = (more[twin] >> np.uint64(32)).astype(np.int64)
            both = np.bincount(pair, minlength=m)
            share = both / np.maximum(size_a + size_c - both, 1)
            near = share >= threshold
            # Weights of those pairs alone.
            total = np.zeros(m)
            for key, tf in ((a, a_tf), (c, c_tf)):
                own = near[(key >> np.uint64(32)).astype(np.int64)]
                total += np.bincount((key[own] >> np.uint64(32)).astype(np.int64), weights=weights.of(key[own].astype(np.uint32), tf[own]), minlength=m)
            twin, pair = twin[near[pair]], pair[near[pair]]
            in_less, in_more = at[twin], twin
            tf_less, tf_more = (a_tf, c_tf) if len(a) < len(c) else (c_tf, a_tf)
            code = more[twin].astype(np.uint32)
            low = np.bincount(pair, weights=np.minimum(weights.of(code, tf_less[in_less]), weights.of(code, tf_more[in_more])), minlength=m)
            weighted = low / np.maximum(total - low, 1e-9)
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(weighted).filter(keep), pa.array(share).filter(keep)], names=["a", "b", "weighted", "share"])

    own = texts.select("n", "shingles")
    with_a = pairs.join(own.withColumnRenamed("n", "a").withColumnRenamed("shingles", "sa"), "a")
    both = with_a.join(own.withColumnRenamed("n", "b").withColumnRenamed("shingles", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a bigint, b bigint, weighted double, share double")


class NearDuplicates:
    """Near duplicates of ``texts`` (key, text): classes of equal words, and links between the representatives of classes.

    ``members``: (n, key, rep, full), the class of each key, the class's smallest key, and whether it takes part in links. A key
    delivered twice with one text counts once; NULL keys are left out. NULL and wordless texts are classes of their own, texts
    of fewer than ``least_words`` words are linked with none but their copies. Extra columns are ignored. Five words and 0.8
    unless told otherwise. Tables lie in the shared folder.
    """

    def __init__(self, texts: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, least_words: int = 0) -> None:
        self.threshold = threshold
        every = materialise(shingled(texts.where(F.col(key).isNotNull()), key, text, n, least_words), "shingles")
        own = F.coalesce("same", F.encode("key", "UTF-8"))  # 16 bytes or a key, which is no digest
        one = every.groupBy(own.alias("same")).agg(F.first("shingles").alias("shingles"), F.min("key").alias("rep"))
        self.classes = materialise(one.select(F.monotonically_increasing_id().alias("n"), "same", "rep", "shingles"), "classes")
        named = self.classes.select("same", "n", "rep", (F.size("shingles") > 0).alias("full"))
        self.members = materialise(every.select(own.alias("same"), "key").distinct().join(named, "same").select("n", "key", "rep", "full"), "members")
        discard(every)  # the classes hold all that is still needed of the texts
        self.full = self.classes.where(F.size("shingles") > 0).select("n", "shingles")
        n_texts = self.full.count()
        self.weights = Weights(n_texts, *common_shingles(self.full, n_texts))
        self.banded = materialise(bands(self.full, self.weights), "bands")

    @functools.cached_property
    def links(self) -> DataFrame:
        """(a, b, weighted, share): every link between classes, by their numbers, a < b."""
        found = candidate_pairs(self.banded, self.threshold)
        return materialise(verified_pairs(found, self.full, self.weights, self.threshold), "links")

    def named_links(self) -> DataFrame:
        """(id_a, id_b, weighted, share): every link between different texts, each text by its smallest key."""
        rep = self.classes.select("n", "rep")
        of_a, of_b = (rep.select(F.col("n").alias(x), F.col("rep").alias(f"rep_{x}")) for x in "ab")
        both = self.links.join(of_a, "a").join(of_b, "b")
        return both.select(F.least("rep_a", "rep_b").alias("id_a"), F.greatest("rep_a", "rep_b").alias("id_b"), "weighted", "share")

    def membership(self) -> DataFrame:
        """(key, rep, n_links): one row per key; ``rep`` is the smallest key of equal words, n_links the other texts it is linked with."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("n_links"))
        return self.members.join(ends, "n", "left").select("key", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def pairs(self, expand: int | None = None) -> DataFrame:
        """(id_a, id_b), id_a < id_b: linked keys, those of equal words too, each pair once.

        ``expand`` is how many pairs of keys are written out for two linked classes, or for one class, at most; for more, the
        classes' smallest keys stand for them, and within a class each key is paired with the smallest, so that together
        with ``membership`` every link can be read off. None writes out all.
        """
        most = F.lit(expand if expand is not None else 1 << 62)
        full = self.members.where("full")
        sizes = full.groupBy("n").agg(F.count("*").alias("c"), F.min("key").alias("rep"))
        links = self.links.select("a", "b")
        of_a, of_b = (sizes.select(F.col("n").alias(x), F.col("c").alias(f"c{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab")
        sized = links.join(of_a, "a").join(of_b, "b").withColumn("fits", F.col("ca") * F.col("cb") <= most)
        a, b = (full.select(F.col("n").alias(x), F.col("key").alias(f"key_{x}")) for x in "ab")
        every = sized.where("fits").select("a", "b").join(a, "a").join(b, "b").select("key_a", "key_b")
        few = sized.where("NOT fits").select(F.col("rep_a").alias("key_a"), F.col("rep_b").alias("key_b"))
        own = full.drop("rep").join(sizes.where("c > 1"), "n").withColumn("fits", F.col("c") * F.col("c") <= most)
        inner = own.where("fits").select("n", F.col("key").alias("key_a"))
        inner = inner.join(full.select("n", F.col("key").alias("key_b")), "n").where("key_a < key_b").select("key_a", "key_b")
        star = own.where("NOT fits AND key <> rep").select(F.col("rep").alias("key_a"), F.col("key").alias("key_b"))
        out = every.unionByName(few).unionByName(inner).unionByName(star)
        return out.select(F.least("key_a", "key_b").alias("id_a"), F.greatest("key_a", "key_b").alias("id_b"))

    def spanning_links(self) -> DataFrame:
        """(a, b): links enough to connect all classes that links connect, without listing all pairs of a band.

        Each text of a band is compared with the band's smallest one, a. What reaches the threshold is connected through it
        and leaves the band, unless it may be linked with one that doesn't: one minus the share is a metric, so x can't be
        linked with y if the shares of a with x and with y differ by more than 1 - threshold. What is left is compared with
        its own smallest one, PEELS times, then pairwise. A band of variants of one text thus takes one comparison a text.
        """
        linked: DataFrame | None = None
        star = materialise(stars(self.banded), "stars")
        slack = 1 - self.threshold
        for _ in range(PEELS):
            if star.isEmpty():
                break
            share = materialise(verified_pairs(star.select("a", "b").distinct(), self.full, self.weights, 0.0), "shares")
            near = share.where(F.col("share") >= self.threshold).select("a", "b")
            linked = near if linked is None else linked.unionByName(near)
            seen = star.join(share.select("a", "b", "share"), ["a", "b"])
            apart = seen.where(F.col("share") < self.threshold).groupBy("band").agg(F.max("share").alias("most"), F.min("b").alias("next"))
            rest = seen.join(apart, "band").where(F.col("share") <= F.greatest(F.lit(self.threshold), F.col("most") + slack + 1e-9))
            star = materialise(rest.where("b <> next").select("band", F.col("next").alias("a"), "b"), "stars")
        if not star.isEmpty():
            size = self.full.select("n", F.size(F.array_distinct("shingles")).alias("size"))
            left = star.select("band", F.col("a").alias("n")).union(star.select("band", "b")).distinct().join(size, "n")
            near = verified_pairs(candidate_pairs(left, self.threshold), self.full, self.weights, self.threshold).select("a", "b")
            linked = near if linked is None else linked.unionByName(near)
        return linked if linked is not None else self.full.select(F.col("n").alias("a"), F.col("n").alias("b")).where("false")

    def groups(self) -> DataFrame:
        """(key, group, n_keys): one row per key; the group is the smallest key that it is linked with, directly or not.

        n_keys counts the keys of the group. A key without links or copies is its own group.
        """
        low = components(self.spanning_links().select(F.col("a").alias("u"), F.col("b").alias("v")))
        placed = self.members.join(low.select(F.col("u").alias("n"), F.col("v").alias("root")), "n", "left")
        placed = placed.withColumn("root", F.coalesce("root", "n"))
        names = placed.groupBy("root").agg(F.min("key").alias("group"), F.count("*").alias("n_keys"))
        return placed.join(names, "root").select("key", "group", "n_keys")


def components(edges: DataFrame) -> DataFrame:
    """(u, v): for every node u of ``edges`` but the smallest of its component, that smallest node v.

    Alternates large and small stars until a round changes nothing, which takes about the logarithm of the nodes: each node's
    smallest neighbour is aggregated before the shuffle, and hot nodes are split by the skew join. Every round is written to
    the shared folder and the one before deleted; nothing but a count and a checksum reaches the driver.
    """
    seen, last = None, None
    edges = edges.where("u <> v")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "stars")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if last is not None:
            discard(last)
        if state == seen:
            return edges
        seen, last = state, edges
