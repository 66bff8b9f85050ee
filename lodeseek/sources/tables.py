"""Tables of texts as corpora of files: each row a file, its path made of its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that documents get by doc_id, so that types, omissions and sizes all occur.
EXTENSIONS = ("txt", "md", "json", "xml", "html", "log", "csv", "pdf", "rs", "jsonl")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text, size_bytes of the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return docs.select("doc_id", path.alias("path"), "text", F.octet_length("text").cast("long").alias("size_bytes"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
