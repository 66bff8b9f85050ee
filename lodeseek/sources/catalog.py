"""The catalogue of embedding models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULT_MODELS
from ..functions.display import display_name

#: Engine, model, description, dimension, recommended.
MODELS = [
    ("SBERT", "intfloat/e5-small-v2", "Speed: high, accuracy: medium-high (English only)", 384, False),
    ("SBERT", "nomic-ai/nomic-embed-text-v1", "Speed: high, accuracy: medium-high (English only)", 384, False),
    ("SBERT", "nomic-ai/nomic-embed-text-v1.5", "Speed: medium, accuracy: medium-high (English only)", 768, False),
    ("SBERT", "sentence-transformers/all-MiniLM-L12-v2", "Speed: high, accuracy: medium (English)", 384, False),
    ("SBERT", "jinaai/jina-embeddings-v5-text-small", "Speed: slow, accuracy: high (English only)", 1024, False),
    ("SBERT", "jinaai/jina-embeddings-v5-text-nano", "Speed: slow, accuracy: medium (English only)", 768, False),
    ("SBERT", "sentence-transformers/all-mpnet-base-v2", "Speed: medium, accuracy: medium (English only)", 768, False),
    ("SBERT", "minishlab/potion-multilingual-128M", "Speed: highest, accuracy: low", 256, False),
    ("SBERT", "thenlper/gte-small", "Speed: medium, accuracy: low (English only)", 384, False),
    ("Candle", "sentence-transformers/all-MiniLM-L6-v2", "Speed: high, accuracy: medium (English)", 384, False),
    ("Candle", "BAAI/bge-base-en-v1.5", "BGE base English embeddings (768-dim)", 768, False),
    ("Candle", "sentence-transformers/all-MiniLM-L12-v2", "Speed: high, accuracy: medium (English)", 384, False),
    ("Candle", "intfloat/multilingual-e5-large-instruct", "Multilingual instruction-tuned E5 (1024-dim)", 1024, False),
    ("Candle", "mixedbread-ai/mxbai-embed-large-v1", "Large English embedding model from MixedBread.ai", 1024, False),
    ("Candle", "snowflake/snowflake-arctic-embed-xs", "Snowflake Arctic embed model, xs", 384, False),
    ("Candle", "snowflake/snowflake-arctic-embed-s", "Snowflake Arctic embed model, small", 384, False),
    ("Candle", "Snowflake/snowflake-arctic-embed-m", "Snowflake Arctic embed model, medium", 768, False),
    ("Candle", "snowflake/snowflake-arctic-embed-l", "Snowflake Arctic embed model, large", 1024, False),
]
#: Models of a run-time list that are recommended.
RECOMMENDED = ("BGEBaseENV15", "AllMiniLML6V2")
BATCH = 32


def preferred_batch(model: Column, description: Column) -> Column:
    """Texts to embed at once; null (all in one batch) for quantized models."""
    low = F.lower(model)
    one = F.contains(low, F.lit("-q")) | F.contains(low, F.lit("-int8")) | F.contains(low, F.lit("quantized")) | F.contains(F.lower(description), F.lit("quantized"))
    return F.when(~one, F.lit(BATCH))


def models(spark: SparkSession, engine: str, cached: tuple[str, ...] = (), listed: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """Models of an engine: the default first, then cached ones, then by id.

    listed: (model, description, dimension) as an engine tells them at run time, for engines without rows here.
    """
    rows = [(e, m, d, n, r) for e, m, d, n, r in MODELS if e == engine]
    rows += [(engine, m, d, n, m in RECOMMENDED) for m, d, n in listed or []]
    df = spark.createDataFrame(rows, "engine string, model_id string, description string, dimension int, is_recommended boolean")
    full = df.select(
        "engine", "model_id", display_name(F.col("model_id")).alias("display_name"), "description", "dimension",
        F.col("model_id").isin(*cached).alias("is_cached") if cached else F.lit(False).alias("is_cached"), "is_recommended",
        (F.col("model_id") == DEFAULT_MODELS.get(engine, "")).alias("is_default"), preferred_batch(F.col("model_id"), F.col("description")).alias("preferred_batch_size"),
    )
    assert {x.split()[0] for x in schema.MODELS.split(", ")} <= set(full.columns)
    return full.orderBy(F.desc("is_default"), F.desc("is_cached"), "model_id")
