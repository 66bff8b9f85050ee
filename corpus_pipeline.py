"""A training-data pipeline over documents: each stage works on all that its predecessor kept.

Defined results. A null or empty text fails the quality rules' least number of words, so it goes in the first stage, and later
stages would leave it as it is; an empty table gives an empty one in every stage; repeated rows are judged alike, and one of them
stays in near-dedup; of texts alike the smallest doc_id stays, of rows without doc_id the first by hash of its text; columns
beside those of documents pass through all stages but the last, whatever their names, and n_chars follows the text if it is there.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import decontam, packing, quality, secret_scan, simhash
from lodeseek.llm.queries import tokenizer
from lodeseek.llm.shared import bounded, recorded, release, write_shared

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Of this thread, for each table folder: working files of the last stage. The next one gets that stage's rows as written, so they
#: are done with.
_working = threading.local()
#: Bytes of an Arrow batch. What the JVM takes for batches outside its heap stays with it, and one executor runs all stages.
_BATCH = 2 << 20


def _tidy(stage: Stage) -> Stage:
    """stage, on small Arrow batches, deleting what the stage before it has left in the shared folder, unless its input still reads it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = _working.__dict__
        left = release(spark, held.pop(sf_dir, []), docs)
        with recorded() as made:
            out = stage(spark, bounded(docs, _BATCH), sf_dir)
        held[sf_dir] = left + made
        return out

    return run


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose votes make them likely good."""
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW))
    return quality.score_quality(rows, keep=[_ROW]).where("kept").select(f"{_ROW}.*")


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


_ROW = "row"


def _apart(docs: DataFrame) -> DataFrame:
    """text, and all other columns as one, so that none of them clashes with what an operator adds."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(_ROW))


def _together(found: DataFrame, docs: DataFrame, text: F.Column) -> DataFrame:
    """The columns of docs from rows of _apart with spans; where there are some, with a new text, and n_chars to match."""
    found = found.withColumn("new", F.when(F.size("spans") > 0, text))
    put = {"text": F.coalesce("new", "text")}
    for c in docs.columns:
        if c != "text":
            put[c] = F.col(_ROW)[c]
    if "n_chars" in put:
        put["n_chars"] = F.coalesce(F.length("new").cast("long"), put["n_chars"])
    return found.select(*[put[c].alias(c) for c in docs.columns])


#: Words that a worker of decontamination looks through at once, few for the same reason as _BATCH.
_SHARD = 250_000


@_tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items or more go; from others, what stems from the benchmark is cut."""
    found = decontam.find_leaks(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["text", _ROW], shard_words=_SHARD)
    clean = found.where(F.size("item_ids") < 2)
    return _together(clean, docs, decontam.cut_spans(F.col("text"), F.col("spans")))


@_tidy
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; the documents stay."""
    found = secret_scan.find_secrets(_apart(docs), keep=["text", _ROW], model=secret_scan.fit(docs))
    return _together(found, docs, secret_scan.redacted(F.col("text"), F.col("spans")))


#: Pieces that a worker of packing keeps, and bytes of texts that it encodes at once: few, as the stages before leave executors little memory.
_PIECES, _TOGETHER = 100_000, 1 << 19


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=0, pieces=_PIECES, together=_TOGETHER, lean=True)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packed),
]
#: Fitted rules, hashing and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_shared(docs, f"pipeline-{k}")
    return docs
