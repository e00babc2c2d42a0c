"""Encoding of a corpus with a public byte-level BPE vocabulary.

Merging runs in batched NumPy rounds: the symbols of all unseen words of a batch stand in one flat array; each round finds
the ranks of the pairs that changed by binary search over the sorted pair keys, takes each word's lowest rank and merges
all its occurrences at once. Ranks that a word merges rise from round to round, so this equals merging one pair at a time.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie; every query and operator takes it as a parameter.
TOKENIZERS = os.environ.get("JURALAKE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No pair can be merged.
NONE = np.int32(2**31 - 1)
#: A worker's word memory is emptied beyond so many words or ids; a matter of speed alone.
MEMORY_WORDS = 400_000
MEMORY_IDS = 4_000_000
#: Ids in a batch that goes back to Spark, at most, but for a single text's.
MOST_IDS = 1 << 28
#: Characters encoded at a time.
SLICE_CHARS = 1_000_000


class BytePairEncoder:
    """A byte-level BPE vocabulary in the ``tokenizers`` JSON form, without its special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.key_rank = order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.of_byte = np.array([vocab[c] for c in _byte_letters()], dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        none = np.empty(0, np.int64)
        self.hashes, self.hash_word = np.empty(0, np.uint64), none
        self.cp, self.first_cp, self.length = np.empty(0, np.uint32), none, none
        self.ids, self.first_id, self.n_ids = np.empty(0, np.int32), none, none
        self.clash: dict[str, int] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, NONE where it isn't a merge."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` one after another, and the number of ids of each. Words aren't empty."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(sym)])
            live = least < NONE
            if not live.all() and (not live.any() or length[live].sum() * 4 < 3 * len(sym)):
                keep = np.repeat(live, length)  # finished words leave the array
                done.append((word[~keep], sym[~keep]))
                word, sym, rank = word[keep], sym[keep], rank[keep]
                continue
            hit = np.flatnonzero((rank == np.repeat(least, length)) & (rank < NONE))
            run = np.r_[True, np.diff(hit) != 1]  # of a a a the first pair merges, the second doesn't
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            now = np.cumsum(stay) - 1
            word, sym, rank = word[stay], sym[stay], rank[stay]
            at = now[hit]
            at = np.unique(np.r_[at, at[at > 0] - 1])
            pair = at[at + 1 < len(sym)]
            pair = pair[word[pair] == word[pair + 1]]
            rank[at] = NONE
            rank[pair] = self.ranks(sym[pair], sym[pair + 1])
        if not done:
            return np.empty(0, np.int32), size
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of ``texts`` and the offsets of each text (one more than texts)."""
        flat, count = [], []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (chars == 0 or chars + len(texts[end]) <= SLICE_CHARS):
                chars += len(texts[end])
                end += 1
            ids, n = self._slice(texts[at:end])
            flat.append(ids)
            count.append(n)
            at = end
        offsets = np.zeros(len(texts) + 1, np.int64)
        if count:
            np.cumsum(np.concatenate(count), out=offsets[1:])
        return np.concatenate(flat) if flat else np.empty(0, np.int32), offsets

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        n_texts = len(texts)
        if not joined:
            return np.empty(0, np.int32), np.zeros(n_texts, np.int64)
        size = np.fromiter(map(len, texts), np.int64, n_texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = word_starts(cp, np.cumsum(size)[:-1])
        length = np.diff(np.r_[begin, len(cp)])
        word = self._words(joined, cp, begin, length)
        n = self.n_ids[word]
        ends = np.cumsum(n)
        take = np.repeat(self.first_id[word] - (ends - n), n) + np.arange(ends[-1])
        text = np.searchsorted(np.cumsum(size), begin, side="right")
        return self.ids[take], np.bincount(text, weights=n, minlength=n_texts).astype(np.int64)

    def _words(self, joined: str, cp: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number in memory of each word; words that it lacks are merged first.

        Words are found by a 64-bit hash and then compared code point by code point; those that differ go by a dict.
        """
        if len(self.hashes) > MEMORY_WORDS or len(self.ids) > MEMORY_IDS:
            self.forget()
        code = word_hashes(cp, begin, length)
        at = self._find(code)
        new = np.flatnonzero(at < 0)
        if len(new):
            first = new[np.unique(code[new], return_index=True)[1]]
            self._learn(joined, cp, begin[first], length[first], code[first])
            at[new] = self._find(code[new])
        same = self.length[at] == length
        total = np.cumsum(length)
        step = np.arange(total[-1]) - np.repeat(total - length, length)
        here = np.minimum(np.repeat(self.first_cp[at], length) + step, len(self.cp) - 1)
        same &= np.add.reduceat(self.cp[here] != cp[np.repeat(begin, length) + step], total - length) == 0
        for i in np.flatnonzero(~same):  # two words of one hash: next to never
            w = joined[begin[i] : begin[i] + length[i]]
            if w not in self.clash:
                self.clash[w] = self._append([w], cp[begin[i] : begin[i] + length[i]], length[i : i + 1])[0]
            at[i] = self.clash[w]
        return at

    def _find(self, code: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(code), -1, np.int64)
        i = np.minimum(np.searchsorted(self.hashes, code), len(self.hashes) - 1)
        return np.where(self.hashes[i] == code, self.hash_word[i], -1)

    def _learn(self, joined: str, cp: np.ndarray, begin: np.ndarray, length: np.ndarray, code: np.ndarray) -> None:
        words = [joined[b : b + n] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
        total = np.cumsum(length)
        chars = cp[np.repeat(begin - (total - length), length) + np.arange(total[-1])]
        number = self._append(words, chars, length)
        hashes, which = np.r_[self.hashes, code], np.r_[self.hash_word, number]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.hash_word = hashes[order], which[order]

    def _append(self, words: list[str], chars: np.ndarray, length: np.ndarray) -> np.ndarray:
        number = np.arange(len(self.length), len(self.length) + len(words))
        ids, n = self.merge(words)
        self.first_cp = np.r_[self.first_cp, len(self.cp) + np.cumsum(length) - length]
        self.cp = np.r_[self.cp, chars]
        self.length = np.r_[self.length, length]
        self.first_id = np.r_[self.first_id, len(self.ids) + np.cumsum(n) - n]
        self.n_ids = np.r_[self.n_ids, n]
        self.ids = np.r_[self.ids, ids]
        return number


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every code point as the split pattern sees it."""
    every = "".join(map(chr, range(0x110000)))
    kind = np.zeros(0x110000, np.uint8)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            kind[m.start() : m.end()] = value
    return kind


def word_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the words of PATTERN begin in code points ``cp``; ``text_starts`` are the places where later texts begin."""
    n = len(cp)
    kind = char_classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[text_starts] = True
    begin = edge.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    # The last white space before a word: a plain space joins the word, any other stands alone.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
    begin[last] = True
    begin[last[cp[last] == 32] + 1] = False
    # English contractions, where a word would begin with the apostrophe.
    for i in np.flatnonzero(cp[:-1] == 39).tolist():
        if begin[i] and not edge[i + 1]:
            a = chr(cp[i + 1])
            b = chr(cp[i + 2]) if i + 2 < n and not edge[i + 2] else ""
            size = 2 if a in "stmd" else 3 if a + b in ("re", "ve", "ll") else 0
            if size:
                begin[i + 1 : i + size] = False
                begin[i + size] = True
    return np.flatnonzero(begin[:n])


def word_hashes(cp: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, from sums over mixed code points."""
    mixed = cp.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    total = np.cumsum(length)
    step = np.arange(int(total[-1])) - np.repeat(total - length, length)
    power = np.cumprod(np.full(int(length.max()), 0x94D049BB133111EB, np.uint64))
    return np.add.reduceat(mixed * power[step], begin) + length.astype(np.uint64)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    """One encoder per process; a worker without the file at ``path`` takes the one that ``sent`` has given it."""
    return BytePairEncoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def sent(spark: SparkSession, vocab: str) -> str:
    """``vocab``, with its file given to all executors by Spark's file server, once per application."""
    sc = spark.sparkContext
    held = sc.__dict__.setdefault("_juralake_files", set())
    if vocab not in held:
        sc.addFile(vocab)
        held.add(vocab)
    return vocab


def vocabulary(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str:
    return f"{folder}/{name}.json"


def encode_ids(df: DataFrame, key: str, text: str, vocab: str) -> DataFrame:
    """``key`` and ``ids`` (ARRAY<INT>) of every row of ``df``: the whole ``text`` in the ids of ``vocab``.

    NULL and empty texts give an empty list; text that looks like a special token is plain text. Repeated rows are each
    encoded. Rows are independent, so the plan has no shuffle; Arrow carries batches to and from NumPy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab)
        for b in batches:
            ids, offsets = bpe.encode(b.column(1).to_pylist())
            at = 0
            while at < b.num_rows:  # offsets of a list column have 32 bits
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + MOST_IDS, side="right")) - 1)
                part = offsets[at : end + 1] - offsets[at]
                lists = pa.ListArray.from_arrays(pa.array(part.astype(np.int32)), pa.array(ids[offsets[at] : offsets[end]]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), lists], names=["key", "ids"])
                at = end

    vocab = sent(df.sparkSession, vocab)
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    plain = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, text: str, vocab: str, name: str = "n_tokens") -> DataFrame:
    """``df`` without ``text`` but with ``name`` (BIGINT), the number of tokens of ``text`` under ``vocab``; 0 for NULL."""

    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab)
        for b in batches:
            _, offsets = bpe.encode(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(offsets))], names=[*rest, name])

    vocab = sent(df.sparkSession, vocab)
    plain = df.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = plain.drop("__text").schema.add(name, "long")
    return plain.mapInArrow(run, fields)
