"""Words of many texts as flat NumPy arrays."""

from __future__ import annotations

import functools

import numpy as np
import regex


@functools.cache
def _word_chars() -> np.ndarray:
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, bool)
    for m in regex.finditer(r"[\p{L}\p{N}]+", every):
        out[m.start() : m.end()] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the lower-cased texts, one text after another, and the number of words of each text.

    Words are runs of letters or digits.
    """
    low = [t.lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = _word_chars()[cp]
    edge = np.zeros(len(cp), bool)
    starts = (np.cumsum(size) - size)[size > 0]
    edge[starts] = True
    begin = inside & (edge | ~np.r_[False, inside[:-1]])
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(begin[at])
    length = np.diff(np.r_[first, len(at)])
    step = np.arange(len(at)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64))
    code = np.add.reduceat(mix(cp[at].astype(np.uint64) + np.uint64(1)) * power[step], first)
    text = np.repeat(np.arange(len(texts)), size)[at[first]]
    return mix(code), np.bincount(text, minlength=len(texts))


def shingle_hashes(words: np.ndarray, n_words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` words in a row within each text, repeats kept, and the number of shingles of each text."""
    count = np.maximum(n_words - n + 1, 0)
    if len(words) < n or not count.sum():
        return np.empty(0, np.uint64), np.zeros(len(n_words), np.int64)
    code = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    text = np.repeat(np.arange(len(n_words)), n_words)
    whole = text[: len(code)] == text[n - 1 :]
    return code[whole], count
