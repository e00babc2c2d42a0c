"""Token budget per source, language and domain.

Tokens are predicted from counts of bytes, words, digits, punctuation and scripts by one linear model per language, fitted
on a bounded tokenized sample and corrected by the ratio of real to predicted tokens on a tokenized holdout. A further
tokenized sample, which neither has seen, tells the error that remains.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from juralake.functions.labels import resolve
from juralake.llm.bpe import count_tokens
from juralake.session import materialise
from juralake.sources.tables import delivered_once, first_deliveries, rows_of_sample

#: Rows of each language that are tokenized to fit its model, those held out to correct its bias, and those that tell its error.
FIT_ROWS = 300
HOLDOUT_ROWS = 100
TEST_ROWS = 100
#: Classes of characters that are counted, each a feature.
CLASSES = (
    (r"\s+", "space"), (r"\p{N}+", "digit"), (r"[\p{P}\p{S}]+", "punct"), (r"\p{Latin}+", "latin"), (r"\p{Greek}+", "greek"), (r"\p{Cyrillic}+", "cyrillic"),
    (r"\p{Han}+", "han"), (r"[\p{Hiragana}\p{Katakana}]+", "kana"), (r"\p{Arabic}+", "arabic"), (r"\p{Devanagari}+", "devanagari"), (r"\p{Thai}+", "thai"),
)
FEATURES = ("bytes", "words", *(name for _, name in CLASSES))
LABELS = ("source", "lang", "domain")


@functools.cache
def _class_of() -> np.ndarray:
    """The class (from 1, 0 for none) of every code point; later classes yield to earlier ones."""
    every = "".join(map(chr, range(0x110000)))
    kind = np.zeros(0x110000, np.uint8)
    for i, (pattern, _) in reversed([*enumerate(CLASSES, 1)]):
        for m in regex.finditer(pattern, every):
            kind[m.start() : m.end()] = i
    return kind


def features(texts: list[str]) -> np.ndarray:
    """One row per text, one column per feature; 0 for an empty text. Words are runs without white space."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), len(FEATURES)), np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return out
    kind = _class_of()[cp]
    row = np.repeat(np.arange(len(texts)), size)
    n = len(CLASSES) + 1
    out[:, 2:] = np.bincount(row * n + kind, minlength=n * len(texts)).reshape(-1, n)[:, 1:]
    n_bytes = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    out[:, 0] = np.bincount(row, weights=n_bytes, minlength=len(texts))
    begins = (kind != 1) & (np.r_[True, kind[:-1] == 1] | np.r_[True, row[1:] != row[:-1]])
    out[:, 1] = np.bincount(row[begins], minlength=len(texts))
    return out


def with_features(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text`` but with the feature columns (BIGINT); NULL counts as empty. Texts go whole, batch by batch."""
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=[*rest, *FEATURES])

    plain = df.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = plain.drop("__text").schema
    for f in FEATURES:
        fields = fields.add(f, "long")
    return plain.mapInArrow(run, fields)


def labelled_chunks(chunks: DataFrame, aliases: DataFrame, *columns: str) -> DataFrame:
    """(id, columns, source, lang, domain): every chunk id once, with canonical labels or ``unknown``.

    The keys source, language and domain stand at the metadata's top level or in its object provenance. NULL metadata,
    text that isn't valid JSON and values that are missing, null or not found give ``unknown``.
    """
    once = first_deliveries(chunks, *columns, "metadata")
    v = once.withColumn("__v", F.try_parse_json("metadata"))
    for name, key in zip(LABELS, ("source", "language", "domain"), strict=True):
        v = v.withColumn(f"raw_{name}", F.coalesce(F.try_variant_get("__v", f"$.{key}", "string"), F.try_variant_get("__v", f"$.provenance.{key}", "string")))
    v = v.drop("__v", "metadata")
    for name in LABELS:
        v = resolve(v, aliases, name, f"raw_{name}", name)
    return v.select("id", *columns, *LABELS)


class Model(NamedTuple):
    """A language's weights of FEATURES, its bias correction, and the error of its total on the test rows, NaN without any."""

    beta: np.ndarray
    bias: float
    error: float


def fit(chunks: DataFrame, aliases: DataFrame, vocab: str, fit_rows: int = FIT_ROWS, holdout_rows: int = HOLDOUT_ROWS, test_rows: int = TEST_ROWS) -> dict[str, Model]:
    """A model per language; "" holds that of all languages together.

    Sampled are the rows with the smallest hash of the id in each language, at most fit_rows + holdout_rows + test_rows. They
    are chosen by id and label alone; only then are their contents read. The driver gets their counts. A language with fewer
    than 30 rows takes the model of all.
    """
    w = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = labelled_chunks(chunks, aliases).select("id", "lang", F.row_number().over(w).alias("n")).where(F.col("n") <= fit_rows + holdout_rows + test_rows)
    # As many rows as the alias table has languages, and one more, times the rows of each: small enough to be sent to all.
    once = delivered_once(rows_of_sample(chunks, materialise(chosen, "chosen"), "id", "content"), "content", "lang", "n").where(F.length("content") > 0)
    sample = once.select("lang", "n", F.col("content").alias("t1"), F.col("content").alias("t2"))
    rows = with_features(count_tokens(sample, "t1", vocab), "t2").collect()
    return fit_rows_of([(r["lang"], int(r["n"] > fit_rows) + int(r["n"] > fit_rows + holdout_rows), [r[f] for f in FEATURES], r["n_tokens"]) for r in rows])


def fit_rows_of(rows: list[tuple[str, int, list[int], int]]) -> dict[str, Model]:
    """The models of sampled rows (language, 0 to fit, 1 held out, 2 to test, features, tokens)."""
    models: dict[str, Model] = {}
    for lang in ["", *sorted({r[0] for r in rows})]:
        own = [r for r in rows if r[0] == lang or not lang]
        if lang and len(own) < 30:
            continue
        used = [r for r in own if not r[1]] or own
        x, y = np.array([r[2] for r in used], float).reshape(-1, len(FEATURES)), np.array([r[3] for r in used], float)
        scale = np.maximum(np.abs(x).max(axis=0, initial=0), 1)
        weight = 1 / np.sqrt(np.maximum(y, 1))  # relative errors count, else long texts rule the fit
        a = x / scale * weight[:, None]
        beta = np.linalg.solve(a.T @ a + 1e-6 * len(y) * np.eye(len(scale)) + 1e-12 * np.eye(len(scale)), a.T @ (y * weight)) / scale if len(y) else np.full(len(scale), 0.0)

        def totals(part: int, own=own, beta=beta) -> tuple[float, float]:
            held = [r for r in own if r[1] == part]
            return float(sum(r[3] for r in held)), sum(max(0.0, float(np.dot(beta, r[2]))) for r in held)

        real, guess = totals(1)
        bias = real / guess if guess > 0 else 1.0
        real, guess = totals(2)
        models[lang] = Model(beta, bias, abs(bias * guess - real) / real if real else math.nan)
    return models


def _of_language(models: dict[str, Model], value: Callable[[Model], Column]) -> Column:
    """``value`` of the model of each row's language."""
    out = value(models[""])
    for lang, m in models.items():
        if lang:
            out = F.when(F.col("lang") == lang, value(m)).otherwise(out)
    return out


def estimate(counted: DataFrame, models: dict[str, Model], name: str = "est_tokens") -> DataFrame:
    """``counted`` (with ``lang`` and FEATURES) with the estimated tokens of each row, as a plain expression of its counts."""

    def of(m: Model) -> Column:
        return F.greatest(F.lit(0.0), sum((F.col(f) * float(b * m.bias) for f, b in zip(FEATURES, m.beta, strict=True)), F.lit(0.0)))

    return counted.withColumn(name, _of_language(models, of))


def token_budget(chunks: DataFrame, aliases: DataFrame, vocab: str) -> DataFrame:
    """(source, lang, domain, n_chunks, n_bytes, est_tokens, test_error): one row per slice that chunk ids fall in.

    Every chunk id counts once with its whole content; NULL and empty contents have no tokens but their slice stands.
    test_error is the error of the total of the language's test rows, as a share of it; NaN where there are none.
    """
    models = fit(chunks, aliases, vocab)
    counted = with_features(labelled_chunks(chunks, aliases, "content").drop("id"), "content")
    slices = (
        estimate(counted, models).groupBy(*LABELS)
        .agg(F.count("*").alias("n_chunks"), F.sum("bytes").alias("n_bytes"), F.round(F.sum("est_tokens")).cast("bigint").alias("est_tokens"))
    )
    return slices.withColumn("test_error", _of_language(models, lambda m: F.lit(m.error)))


def budget_errors(chunks: DataFrame, aliases: DataFrame, vocab: str) -> DataFrame:
    """(source, lang, domain, n_chunks, est_tokens, real_tokens, error): every slice's estimate beside the tokens of all its chunks.

    It tokenizes the whole corpus, which the estimate is there to spare; error is |est - real| / real, NULL without tokens.
    """
    models = fit(chunks, aliases, vocab)
    twice = labelled_chunks(chunks, aliases, "content").select(*LABELS, F.col("content").alias("t1"), F.col("content").alias("t2"))
    both = estimate(with_features(count_tokens(twice, "t1", vocab), "t2"), models)
    sums = both.groupBy(*LABELS).agg(F.count("*").alias("n_chunks"), F.round(F.sum("est_tokens")).cast("bigint").alias("est_tokens"), F.sum("n_tokens").alias("real_tokens"))
    return sums.withColumn("error", F.when(F.col("real_tokens") > 0, F.abs(F.col("est_tokens") - F.col("real_tokens")) / F.col("real_tokens")))
