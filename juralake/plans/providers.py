"""Calls to models behind batched providers, with offline stand-ins that are deterministic.

The stand-ins let every plan run and be checked without a network; what they score says nothing of a model's quality.
"""

from __future__ import annotations

import random
import re
import time
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

T = TypeVar("T")
#: Texts in one call.
BATCH = 64
# Prices of unknown models, for 1000 tokens in and out.
DEFAULT_PRICE = (0.001, 0.002)
# Prices of known models, for 1000 tokens in and out.
PRICES = (("gpt-3.5-turbo", 0.0005, 0.0015), ("gpt-4o-mini", 0.00015, 0.0006), ("deepseek-chat", 0.00014, 0.00028), ("claude-3-haiku", 0.00025, 0.00125), ("open-mistral-nemo", 0.00015, 0.00015), ("mistral-small-latest", 0.0001, 0.0003))


class Embedder(Protocol):
    """Vectors of texts; ``task`` tells documents from queries."""

    dimensions: int

    def embed(self, texts: Sequence[str], task: str) -> np.ndarray: ...


class Completer(Protocol):
    """Replies to prompts."""

    def complete(self, prompts: Sequence[str]) -> list[str]: ...


class HashedWords:
    """A bag of hashed words as a unit vector; a text without words is all zero."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str], task: str = "document") -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                out[i, h % self.dimensions] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class TemplateCompleter:
    """Replies ``template`` with {prompt} filled in."""

    def __init__(self, template: str = "{prompt}") -> None:
        self.template = template

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [self.template.replace("{prompt}", p) for p in prompts]


def backoff(attempt: int, seed: int = 0, most: float = 60.0) -> float:
    """Seconds to wait before an attempt (from 0): doubling up to ``most``, varied by a quarter."""
    base = min(2.0**attempt, most)
    return base + base * 0.25 * (2 * random.Random(seed * 1009 + attempt).random() - 1)


class Transient(Exception):
    """A failure that another attempt may not meet: too many requests, a server's fault, a broken connection."""


def retried(call: Callable[[], T], attempts: int = 5, wait: Callable[[float], None] = time.sleep) -> T:
    """What ``call`` gives, tried anew after each Transient failure, ``attempts`` times at most, with ``backoff`` between."""
    for n in range(attempts):
        try:
            return call()
        except Transient:
            if n == attempts - 1:
                raise
            wait(backoff(n))
    raise ValueError("attempts must be at least 1")


_MADE: dict[str, object] = {}


def once(name: str, make: Callable[[], T]) -> Callable[[], T]:
    """``make``, called once in each worker process, whatever number of tasks it runs; clients with connections are worth keeping."""

    def kept() -> T:
        if name not in _MADE:
            _MADE[name] = make()
        return _MADE[name]  # type: ignore[return-value]

    return kept


#: Texts that one call to a provider may hold; others take any number.
PROVIDER_BATCHES = {"openai": 100, "cohere": 96, "isaacus": 50}
#: The model that each configured key stands for, the first that is set counts; without any, that of DEFAULT_MODEL.
MODEL_KEYS = (("MISTRAL_API_KEY", "open-mistral-nemo"), ("DEEPSEEK_API_KEY", "deepseek-chat"), ("OPENAI_API_KEY", "gpt-4o-mini"), ("OPENROUTER_API_KEY", "openai/gpt-4o-mini"))
DEFAULT_MODEL = "gpt-4o-mini"


def preferred_model(keys: Mapping[str, str]) -> str:
    """The model to complete with, by which of MODEL_KEYS are set in ``keys`` (such as the environment)."""
    return next((model for key, model in MODEL_KEYS if keys.get(key)), DEFAULT_MODEL)


def routed(model: str, models: Sequence[tuple], makes: Mapping[str, Callable[[], Embedder]]) -> Callable[[], Embedder]:
    """A maker of the embedder that serves ``model``, by its provider in a registry of (model, provider, ...) rows.

    It sends as many texts in a call as the provider takes. An unknown model, or a provider without a maker, is refused.
    """
    provider = next((r[1] for r in models if r[0] == model), None)
    if provider not in makes:
        raise ValueError(f"no embedder for model {model!r}")
    make = makes[provider]

    def made() -> Embedder:
        out = make()
        if provider in PROVIDER_BATCHES:
            out.batch = PROVIDER_BATCHES[provider]
        return out

    return made


def messages(system: Column, history: Column | None, user: Column) -> Column:
    """A conversation for a model as JSON: the system's text, those of ``history`` (ARRAY<STRUCT<role, content>>) by users and
    assistants that aren't empty, and the user's."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    head, tail = F.array(one("system", system)), F.array(one("user", user))
    if history is None:
        return F.to_json(F.concat(head, tail))
    kept = F.transform(F.filter(F.coalesce(history, F.slice(tail, 2, 1)), lambda m: m["role"].isin("user", "assistant") & (F.length(m["content"]) > 0)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.to_json(F.concat(head, kept, tail))


def embedded(df: DataFrame, text: str, make: Callable[[], Embedder], name: str = "embedding", task: str = "document") -> DataFrame:
    """``df`` with ``name`` (ARRAY<FLOAT>): the vectors of ``text``; NULL texts have NULL.

    One provider a task; a call holds BATCH texts, or as many as the provider's ``batch``, and is tried anew after Transient failures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            held = [i for i, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            size = getattr(provider, "batch", BATCH)
            for at in range(0, len(held), size):
                part = held[at : at + size]
                for i, v in zip(part, retried(lambda part=part: provider.embed([texts[i] for i in part], task)), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names[:-1], name])

    plain = df.select("*", F.col(text).alias("__text"))
    return plain.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(FloatType()))]))


def completed(df: DataFrame, prompt: str, make: Callable[[], Completer], name: str = "reply") -> DataFrame:
    """``df`` with ``name``: the replies to ``prompt``; NULL prompts have NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            prompts = b.column(b.num_columns - 1).to_pylist()
            held = [i for i, p in enumerate(prompts) if p is not None]
            out: list = [None] * len(prompts)
            for at in range(0, len(held), BATCH):
                part = held[at : at + BATCH]
                for i, r in zip(part, retried(lambda part=part: provider.complete([prompts[i] for i in part])), strict=True):
                    out[i] = r
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names=[*b.schema.names[:-1], name])

    plain = df.select("*", F.col(prompt).alias("__prompt"))
    return plain.mapInArrow(run, StructType([*df.schema.fields, StructField(name, StringType())]))


def cost(usage: DataFrame, prices: Sequence[tuple[str, float, float]] = PRICES) -> DataFrame:
    """(model, calls, tokens_in, tokens_out, cost): usage (model, tokens_in, tokens_out) by model; unknown ones at DEFAULT_PRICE."""
    table = usage.sparkSession.createDataFrame([*prices], "model string, price_in double, price_out double")
    sums = usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    priced = sums.join(table, "model", "left")
    total = F.col("tokens_in") / 1000 * F.coalesce("price_in", F.lit(DEFAULT_PRICE[0])) + F.col("tokens_out") / 1000 * F.coalesce("price_out", F.lit(DEFAULT_PRICE[1]))
    return priced.select("model", "calls", "tokens_in", "tokens_out", F.round(total, 6).alias("cost"))


def hypothetical(df: DataFrame, query: str, make: Callable[[], Completer], name: str = "expanded", n: int = 1) -> DataFrame:
    """``df`` with ``name``: a hypothetical passage that answers ``query``; queries under 10 characters stay as they are.

    With ``n`` over 1 also ``name``_all: that many passages, each asked for on its own, of which ``name`` is the first.
    """
    asked = df.withColumn("__ask", F.when(F.length(query) >= 10, F.col(query)))
    for i in range(n):
        prompt = F.col("__ask") if not i else F.concat("__ask", F.lit(f"\n(passage {i + 1})"))
        asked = completed(asked.withColumn("__one", prompt), "__one", make, f"__reply{i}").drop("__one")
    every = F.filter(F.array(*(F.nullif(f"__reply{i}", F.lit("")) for i in range(n))), lambda x: x.isNotNull())
    out = asked.withColumn(name, F.coalesce(F.get(every, F.lit(0)), F.col(query)))
    if n > 1:
        out = out.withColumn(f"{name}_all", F.when(F.size(every) > 0, every).otherwise(F.array(query)))
    return out.drop("__ask", *(f"__reply{i}" for i in range(n)))
