"""The collection and chunk store on tables: reading, appending, replacing and deleting as DataFrame transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from juralake.functions.text import sanitize
from juralake.sources.tables import delivered_once

# The settings of a collection that sets none itself.
DEFAULT_SETTINGS = {
    "search_mode": "hybrid", "reranking_enabled": True, "legal_tokenization": True, "sac_enabled": False,
    "hyde_enabled": False, "query_decomposition_enabled": False, "agentic_enabled": False, "colbert_enabled": False,
}
# Embedding models: provider, dimensions, most tokens, chunk size and overlap. The first is the default.
EMBEDDING_MODELS = (
    ("text-embedding-3-small", "openai", 1536, 8191, 256, 50),
    ("embed-v3", "cohere", 1024, 512, 384, 75),
    ("kanon-2-embedder", "isaacus", 1792, 4096, 512, 100),
    ("voyage-3-large", "voyage", 1024, 32000, 384, 75),
    ("qwen3-embedding-8b", "openrouter", 1024, 8192, 256, 50),
)


def embedding_models(spark: SparkSession) -> DataFrame:
    """The registry as a table: model, provider, dimensions, max_tokens, chunk_size, chunk_overlap."""
    return spark.createDataFrame(EMBEDDING_MODELS, "model string, provider string, dimensions int, max_tokens int, chunk_size int, chunk_overlap int")


def with_model(df: DataFrame, models: DataFrame, default: str) -> DataFrame:
    """``df`` (with ``model``) with its registry row; an unknown or missing model takes that of ``default``."""
    names = models.select(F.col("model").alias("__m"))
    known = df.join(names, df["model"] == names["__m"], "left").withColumn("model", F.coalesce("__m", F.lit(default))).drop("__m")
    return known.join(models, "model", "left").select(*df.columns, *(c for c in models.columns if c not in df.columns))


def create_collection(spark: SparkSession, name: str, user_id: str | None = None, settings: dict | None = None) -> DataFrame:
    """One row of a new collection; its id follows from its name, so creating it again is the same row."""
    merged = DEFAULT_SETTINGS | (settings or {})
    fields = [F.lit(merged[k]).cast("string" if k == "search_mode" else "boolean").alias(k) for k in DEFAULT_SETTINGS]
    return spark.range(1).select(F.sha2(F.lit(name), 256).alias("id"), F.lit(name).alias("name"), F.lit(user_id).cast("string").alias("user_id"), F.lit("{}").alias("metadata"), F.struct(*fields).alias("retrieval_settings"), F.current_timestamp().alias("created_at"))


def get_or_create(collections: DataFrame, new: DataFrame) -> DataFrame:
    """``collections`` and those of ``new`` whose name they lack."""
    return collections.unionByName(new.join(collections.select("name"), "name", "left_anti").select(*collections.columns))


def by_name(collections: DataFrame, name: str) -> DataFrame:
    """The collection of that name; raises if there is none."""
    found = collections.where(F.col("name") == name).limit(1)
    if found.isEmpty():
        raise LookupError(f"no collection {name!r}")
    return found


def delete_collection(collections: DataFrame, chunks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the collection and its chunks."""
    gone = collections.where(F.col("name") == name).select("id")
    return collections.join(gone, "id", "left_anti"), chunks.join(gone.withColumnRenamed("id", "collection_id"), "collection_id", "left_anti").select(*chunks.columns)


def with_settings(collections: DataFrame) -> DataFrame:
    """``collections`` with ``settings``: each field as the collection sets it, else the default; NULL settings are all defaults."""
    held = collections.schema["retrieval_settings"].dataType.fieldNames()

    def field(name: str, default) -> Column:
        own = F.col(f"retrieval_settings.{name}") if name in held else F.lit(None)
        return F.coalesce(own, F.lit(default)).alias(name)

    return collections.withColumn("settings", F.struct(*(field(k, v) for k, v in DEFAULT_SETTINGS.items())))


def legal_sources(collections: DataFrame) -> DataFrame:
    """Collections whose metadata says that they are a legal source; NULL and broken metadata says nothing."""
    return collections.where(F.try_variant_get(F.try_parse_json("metadata"), "$.source_type", "string") == "legal_source")


def for_tenant(df: DataFrame, user_id: str) -> DataFrame:
    """Rows of a user only."""
    return df.where(F.col("user_id") == user_id)


def counts(collections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, name, n_chunks) of every collection, empty ones too; a chunk delivered twice counts once."""
    n = chunks.where("id IS NOT NULL").select("collection_id", "id").distinct().groupBy("collection_id").agg(F.count("*").alias("n"))
    return collections.join(n, collections["id"] == n["collection_id"], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def get(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of ``ids`` (id), each once; ids without a chunk give nothing."""
    rest = [c for c in chunks.columns if c != "id"]
    return delivered_once(chunks.join(ids.select("id").distinct(), "id", "left_semi"), *rest)


def delete(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """``chunks`` without those of ``ids``."""
    return chunks.join(ids.where("id IS NOT NULL").select("id"), "id", "left_anti").select(*chunks.columns)


def missing(new: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of ``new`` whose id isn't held yet."""
    return new.join(held.select("id"), "id", "left_anti").select(*new.columns)


def insertable(rows: DataFrame, collection_id: str) -> DataFrame:
    """``rows`` (content, optional id and metadata) ready to append: cleaned, with an id that follows from place and content if none is given."""
    return rows.select(*insertable_columns(rows, collection_id))


def insertable_columns(rows: DataFrame, collection_id: str) -> list[Column]:
    ident = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
    meta = F.col("metadata") if "metadata" in rows.columns else F.lit("{}")
    own = F.sha2(F.concat_ws("\u0001", F.lit(collection_id), meta, F.col("content")), 256)
    return [F.coalesce(ident, own).alias("id"), F.lit(collection_id).alias("collection_id"), sanitize(F.col("content")).alias("content"), meta.alias("metadata")]


def insert_json(spark: SparkSession, payload: str, collection_id: str) -> DataFrame:
    """Rows of a JSON array of documents, as ``insertable`` makes them; a payload that isn't one gives no rows."""
    parsed = spark.range(1).select(F.explode(F.coalesce(F.from_json(F.lit(payload), "array<struct<id:string,content:string,metadata:map<string,string>>>"), F.expr("array()"))).alias("r"))
    rows = parsed.select("r.id", "r.content", F.to_json("r.metadata").alias("metadata"))
    return insertable(rows.withColumn("metadata", F.coalesce("metadata", F.lit("{}"))), collection_id)


def append(rows: DataFrame, path: str) -> None:
    """Append to a Parquet table by collection; a job's output is committed whole or not at all."""
    rows.write.mode("append").partitionBy("collection_id").parquet(path)


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.txt", parser: Callable[[Column], Column] | None = None) -> DataFrame:
    """(source, content, error): text files of a folder; ``parser`` turns a binary column into text, UTF-8 by default.

    A file that can't be read as text keeps its row, with error set.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    text = (parser or (lambda c: c.cast("string")))(F.col("content"))
    good = F.try_validate_utf8(text)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), good.alias("content"), F.when(good.isNull(), F.lit("not valid UTF-8")).alias("error"))


def base_metadata(source: Column) -> Column:
    """Metadata that a file name gives: title, year and extension, as JSON."""
    return F.to_json(F.struct(F.regexp_replace(source, r"\.[^.]+$", "").alias("title"), F.nullif(F.regexp_extract(source, r"((?:19|20)[0-9]{2})", 1), F.lit("")).alias("year"), F.regexp_extract(source, r"\.([^.]+)$", 1).alias("extension")))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON-lines files; without ``schema`` it is inferred. A line that isn't JSON has NULL in every column of ``schema``."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def insert_with_vectors(rows: DataFrame, collection_id: str, model: str, dims: int | None = None) -> DataFrame:
    """``insertable`` rows with their vectors in the column of ``model``'s dimensions: embedding_<dimensions>, the others NULL.

    ``rows`` may have embedding (ARRAY<FLOAT>), sentence_embeddings and sentence_texts; what it lacks is NULL. A vector of another
    size than the model's (``dims`` where vectors are stored narrower) is an error of the row that ``error`` names; it isn't stored.
    """
    size = next((m[2] for m in EMBEDDING_MODELS if m[0] == model), EMBEDDING_MODELS[0][2])
    held = lambda name, kind: (F.col(name) if name in rows.columns else F.lit(None)).cast(kind)
    vector = held("embedding", "array<float>")
    wrong = vector.isNotNull() & (F.size(vector) != (dims or size))
    columns = sorted({m[2] for m in EMBEDDING_MODELS}, reverse=True)
    parts = [F.when(~wrong, vector).alias(f"embedding_{d}") if d == size else F.lit(None).cast("array<float>").alias(f"embedding_{d}") for d in columns]
    return rows.select(
        *insertable_columns(rows, collection_id), *parts,
        held("sentence_embeddings", "array<array<float>>").alias("sentence_embeddings"), held("sentence_texts", "array<string>").alias("sentence_texts"),
        F.when(wrong, F.concat(F.lit("vector of "), F.size(vector).cast("string"), F.lit(" items"))).alias("error"),
    )


def insert_outcome(collections: DataFrame, rows: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """``rows`` for the collection called ``name``, and what came of it: success, inserted_count, error.

    An unknown collection takes nothing and is told as the error.
    """
    found = collections.where(F.col("name") == name).select("id").limit(1).collect()
    if not found:
        return rows.limit(0), {"success": False, "inserted_count": 0, "error": f"no collection {name!r}"}
    ready = insertable(rows, found[0]["id"])
    return ready, {"success": True, "inserted_count": ready.count(), "error": None}


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counters of its rows that are read off ``Observation.get`` once it has run; no pass of their own."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in ({"rows": F.count(F.lit(1))} | counters).items())), seen


# Prompts with places for what they are asked about.
PROMPTS = (
    ("clause_extraction", "List every {{CLAUSE_TYPE}} clause of the contract below, each with its section.\n\n{{CONTRACT}}"),
    ("summary", "Summarise the following {{DOC_TYPE}} in {{N}} sentences.\n\n{{TEXT}}"),
    ("comparison", "Compare the two provisions and say how they differ.\n\nFirst: {{FIRST}}\n\nSecond: {{SECOND}}"),
)


def prompts(spark: SparkSession) -> DataFrame:
    """(name, template): the prompt templates."""
    return spark.createDataFrame(PROMPTS, "name string, template string")
