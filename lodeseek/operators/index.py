"""The vector index: versions of a Parquet table beside a description, and a pointer to the current one.

Building, replacing and removing write a new version and then move the pointer, so readers see the old rows or the new
ones. A change writes its new rows and the paths whose older rows are gone, nothing else; see layout for buckets, tombstones and compaction.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import IndexingConfig
from ..functions import paths
from ..sources import work
from . import chunk, embed, layout
from .layout import BUCKET_ROWS
from .store import Folder

VERSION = 1
#: Of the folders and descriptions; an index with another one has to be built anew.
LAYOUT = 2
#: Paths that a scan is asked for by name at most; with more it reads the buckets whole.
NAMED_PATHS = 1000


class IndexError_(RuntimeError):
    pass


@dataclass(frozen=True)
class Opened:
    """chunks: all live rows; rows_of reads those of some files only."""

    chunks: DataFrame
    meta: dict
    path: str = ""

    def rows_of(self, file_paths: list[str]) -> DataFrame:
        """Rows of some files (a few, such as a search's hits), from their buckets alone."""
        spark, paths_ = self.chunks.sparkSession, sorted(set(file_paths))
        named = spark.createDataFrame([(p,) for p in paths_], "file_path string").select(layout.bucket_of(F.col("file_path"), int(self.meta["buckets"])).alias("b"))
        entries = {str(r["b"]): self.meta["parts"].get(str(r["b"]), layout.entry()) for r in named.distinct().collect()}
        return layout.live(spark, self.path, entries, F.col("file_path").isin(paths_)).select(*layout.COLUMNS)


def chunk_documents(docs: DataFrame, config: IndexingConfig, root: str, semantic: bool = True) -> DataFrame:
    """Chunks of documents (path, file_type, text, source_map) in the index's columns, without vectors."""
    rows = docs.where(F.col("text").isNotNull() & (F.col("text") != ""))
    keep = ["path", "file_type", "source_map"]
    cut = (chunk.semantic_chunks if semantic else chunk.fixed_windows)(rows.select(*keep, "text"), config, keep=keep)
    cut = cut.withColumn("o", chunk.chunk_origin(F.col("source_map"), F.col("byte_start"), F.col("byte_end"), F.col("line")))
    box = lambda f: F.col(f"o.bbox.{f}").cast("double")
    return cut.select(
        paths.relative(F.col("path"), root).alias("file_path"), "chunk_idx", "byte_start", "byte_end", F.col("o.origin_type").alias("origin_type"), F.col("o.page").alias("page"),
        F.col("o.line").alias("line"), F.col("o.col").alias("col"), box("x").alias("bbox_x"), box("y").alias("bbox_y"), box("width").alias("bbox_w"), box("height").alias("bbox_h"), "chunk_text",
    )


def prepare(docs: DataFrame, embedder: embed.Embedder, config: IndexingConfig, root: str, semantic: bool = True) -> DataFrame:
    """Index rows of documents, with embed_error. A row with an error bars its whole file (see good_rows)."""
    return embed.embed_passages(chunk_documents(docs, config, root, semantic), embedder)


def good_rows(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of files that embedded whole, files that did not with an error)."""
    failed = prepared.where("embed_error is not null").groupBy("file_path").agg(F.min("embed_error").alias("error"))
    return prepared.join(failed, "file_path", "left_anti").drop("embed_error"), failed


def _published(spark: SparkSession, path: str, rows: DataFrame, meta: dict, removed: list[str], began: float) -> dict:
    """Writes rows as a version with parts of its own, and moves the pointer to it."""
    made = layout.write_rows(spark, path, rows, meta["buckets"], meta["number"])
    entries = {b: layout.entry() | {"parts": [p], "rows": p["rows"], "files": p["files"]} for b, p in made.items()}
    meta = meta | {"layout": LAYOUT, "build_duration_ms": int((time.time() - began) * 1000)}
    return layout.commit(Folder(spark, path), meta, entries, None, removed)


def _places(meta: dict) -> list[str]:
    return [p["path"] for e in meta["parts"].values() for p in [*e["parts"], *e["deleted"]]]


def build(spark: SparkSession, path: str, docs: DataFrame, embedder: embed.Embedder, root: str, config: IndexingConfig = IndexingConfig(), semantic: bool = True, bucket_rows: int = BUCKET_ROWS) -> dict:
    """A full build: prepares, writes a new version, moves the pointer. The version before it stays until the next build.

    The result is the description, with failed_files, errors (of 1000 files at most, to show) and errors_path (a table of all, if any).
    """
    began = time.time()
    folder = Folder(spark, path)
    old = layout.description(folder) if folder.exists("CURRENT") else None
    removed = _places(layout.with_entries(folder, old)) if old and old.get("layout") == LAYOUT else []
    number = int(old["version"][1:]) + 1 if old else 1
    staged = f"{folder.path}/staging-{number}"
    try:
        prepare(docs, embedder, config, root, semantic).write.mode("overwrite").parquet(staged)
        prepared = spark.read.parquet(staged)
        rows, failed = good_rows(prepared)
        report = f"{folder.path}/v{number:08d}-errors"
        failed.write.mode("overwrite").parquet(report)
        errors = spark.read.schema("file_path string, error string").parquet(report)
        n_failed = errors.count()
        meta = {"schema_version": VERSION, "number": number, "engine": embedder.engine, "model_id": embedder.model_id, "dimension": embedder.dimension, "root_path": root, "built_at": int(began)}
        meta |= {"failed_files": n_failed, "buckets": max(1, -(-prepared.count() // bucket_rows)), "bucket_rows": bucket_rows}
        meta = _published(spark, path, rows, meta, removed, began)
    finally:
        folder.delete(f"staging-{number}")
    layout.vacuum(folder, keep=2)
    return meta | {"errors": {r["file_path"]: r["error"] for r in errors.limit(1000).collect()}, "errors_path": report if n_failed else None}


def create(spark: SparkSession, path: str, rows: DataFrame, meta: dict, bucket_rows: int = BUCKET_ROWS) -> dict:
    """An index of rows that are ready. meta: engine, model_id, dimension, root_path."""
    rows = work.written(rows.select(*layout.COLUMNS), "index-rows")  # they are counted, then dealt
    first = {"schema_version": VERSION, "number": 1, "built_at": int(time.time()), "buckets": max(1, -(-rows.count() // bucket_rows)), "bucket_rows": bucket_rows}
    return _published(spark, path, rows, first | meta, [], time.time())


def read_meta(spark: SparkSession, path: str) -> dict:
    """The description of the current version, with its counts; it reads no rows."""
    folder = Folder(spark, path)
    if not folder.exists("CURRENT"):
        raise IndexError_(f"no index at {path}")
    return layout.description(folder)


def open_index(spark: SparkSession, path: str, model_id: str | None = None, dimension: int | None = None) -> Opened:
    """The current version; refuses another schema version, model or dimension."""
    meta = read_meta(spark, path)
    try:
        version = int(meta.get("schema_version", 0))
    except (TypeError, ValueError):
        version = 0
    if version != VERSION:
        raise IndexError_(f"schema version {version} is not {VERSION}")
    if model_id is not None and meta["model_id"] != model_id:
        raise IndexError_(f"the index has model {meta['model_id']}, not {model_id}")
    if dimension is not None and int(meta["dimension"]) != dimension:
        raise IndexError_(f"the index has dimension {meta['dimension']}, not {dimension}")
    if meta.get("layout") != LAYOUT:
        raise IndexError_(f"layout {meta.get('layout')} is not {LAYOUT}: build the index anew")
    meta = layout.with_entries(Folder(spark, path), meta)
    return Opened(layout.live(spark, path, meta["parts"]).select(*layout.COLUMNS), meta, path)


def replaced(old: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """old without rows of files in gone (file_path), and new."""
    return old.join(gone.select("file_path").distinct(), "file_path", "left_anti").unionByName(new)


def apply_changes(spark: SparkSession, path: str, new: DataFrame, removed: DataFrame, changed: DataFrame, batch: int | None = None) -> dict:
    """A new version: rows of removed and changed files (file_path) go, those of new come. A batch number is applied once.

    What is written is new and a tombstone for each file that had rows; of the index, only paths in the buckets of these files are
    read. Buckets that are due for it are then compacted, as a version of its own. new is read more than once: give it written.
    """
    meta = open_index(spark, path).meta
    if batch is not None and meta.get("batch", -1) >= batch:
        return meta
    number, buckets, entries = int(meta["number"]) + 1, int(meta["buckets"]), dict(meta["parts"])
    wrong = F.min(F.when(F.size("embedding") != int(meta["dimension"]), F.col("file_path")))
    filled = new.groupBy(layout.bucket_of(F.col("file_path"), buckets).alias("bucket")).agg(wrong.alias("wrong")).collect()
    if found := [r["wrong"] for r in filled if r["wrong"] is not None]:
        raise IndexError_(f"dimension of {min(found)} is not {meta['dimension']}")
    gone = removed.select("file_path").unionByName(changed.select("file_path")).distinct().withColumn("bucket", layout.bucket_of(F.col("file_path"), buckets))
    few = gone.limit(NAMED_PATHS + 1).collect()
    named = len(few) <= NAMED_PATHS
    touched = {str(r["bucket"]) for r in (few if named else gone.select("bucket").distinct().collect())}
    here = layout.live(spark, path, {b: entries[b] for b in touched if b in entries}, F.col("file_path").isin([r["file_path"] for r in few]) if named else None)
    dead = here.select("file_path", "bucket").join(gone, ["file_path", "bucket"], "left_semi").groupBy("file_path", "bucket").agg(F.count("*").alias("n"))
    tombs = layout.write_deleted(spark, path, dead, number, len(touched))
    made = layout.write_rows(spark, path, new, buckets, number, len(filled))
    # Files whose rows come without the old ones going (new is not among the changed) are counted once.
    again = _known(spark, path, entries, new, gone, buckets) if made else {}
    for b, tomb in tombs.items():
        e = entries[b]
        entries[b] = e | {"deleted": [*e["deleted"], tomb], "rows": e["rows"] - tomb["rows"], "files": e["files"] - tomb["files"], "dead": e["dead"] + tomb["rows"]}
    for b, part in made.items():
        e = entries.get(b, layout.entry())
        entries[b] = e | {"parts": [*e["parts"], part], "rows": e["rows"] + part["rows"], "files": e["files"] + part["files"] - again.get(b, 0)}
    head = {k: v for k, v in meta.items() if k not in ("parts", "version", "removed", "changed")} | {"number": number} | ({} if batch is None else {"batch": batch})
    folder = Folder(spark, path)
    meta = layout.commit(folder, head, entries, set(tombs) | set(made), [])
    meta = layout.compact(spark, path, meta, set(tombs) | set(made), int(meta.get("bucket_rows", BUCKET_ROWS)))
    layout.vacuum(folder, keep=4)
    return meta


def _known(spark: SparkSession, path: str, entries: dict, new: DataFrame, gone: DataFrame, buckets: int) -> dict[str, int]:
    """For each bucket, how many files of new have rows which stay."""
    files = new.select("file_path").distinct().join(gone.select("file_path"), "file_path", "left_anti").withColumn("bucket", layout.bucket_of(F.col("file_path"), buckets))
    touched = {str(r["bucket"]) for r in files.select("bucket").distinct().collect()} & entries.keys()
    if not touched:
        return {}
    here = layout.live(spark, path, {b: entries[b] for b in touched}).select("file_path", "bucket").distinct()
    return {str(r["bucket"]): r["n"] for r in here.join(files, ["file_path", "bucket"], "left_semi").groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def remove_file(spark: SparkSession, path: str, file_path: str) -> dict:
    """Rows of exactly this path go; nothing below it does."""
    gone = spark.createDataFrame([(file_path,)], "file_path string")
    return apply_changes(spark, path, spark.createDataFrame([], schema.INDEX), gone, gone.limit(0))


def drop(spark: SparkSession, path: str) -> None:
    folder = Folder(spark, path)
    if folder.exists():
        folder.delete()


def counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("file_path").alias("indexed_files"), F.count("*").alias("total_chunks"))


def status(spark: SparkSession, path: str) -> dict:
    """Counts, description and size, as the description has them; the model and dimension are not checked."""
    return read_meta(spark, path)


def usable(found: dict | None, directory: str) -> bool:
    """Whether an index has anything for a directory."""
    if not found or not directory or not found["indexed_files"] or not found["total_chunks"]:
        return False
    return not found.get("root_path") or found["root_path"] == directory
