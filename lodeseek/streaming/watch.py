"""File events to index changes: the last event of each path in a micro-batch counts; removals and replacements are one version."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema, state
from ..config import SUPPORTED_EXTENSIONS, IndexingConfig
from ..functions import paths
from ..operators import embed, index
from ..operators.store import Folder
from . import source

log = logging.getLogger(__name__)
DEBOUNCE = "500 milliseconds"


def latest(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The last event of each path: path, exists, is_file."""
    last = F.max(F.struct(*(order or ["ts"]), "exists", "is_file"))
    return events.groupBy("path").agg(last.alias("e")).select("path", "e.exists", "e.is_file")


def classify(events: DataFrame, extensions: tuple[str, ...] | list[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """path and op: changed (an existing file of a searched type) or removed (whatever does not exist); folders and other types are left out."""
    kind = paths.file_type(F.col("path"), extensions)
    op = F.when(~F.col("exists"), "removed").when(F.col("is_file") & kind.isNotNull(), "changed")
    return latest(events).select("path", op.alias("op")).where("op is not null")


def apply_batch(spark: SparkSession, path: str, events: DataFrame, read: Callable[[DataFrame], DataFrame], embedder: embed.Embedder, root: str, config: IndexingConfig = IndexingConfig(), batch: int | None = None, semantic: bool = True) -> None:
    """One micro-batch. read: documents (path, file_type, text, source_map, error) of changed paths.

    A file that cannot be read or embedded keeps its old rows; one without chunks loses them.
    """
    folder = Folder(spark, path)
    aside = f"changes-{uuid.uuid4().hex}"
    try:
        # Written, not cached: the batch is read several times, and what was read and embedded is not made twice.
        classify(events, config.supported_extensions).write.parquet(f"{folder.path}/{aside}/ops")
        ops = spark.read.schema("path string, op string").parquet(f"{folder.path}/{aside}/ops")
        if ops.isEmpty():
            return
        relative = paths.relative(F.col("path"), root).alias("file_path")
        docs = read(ops.where("op = 'changed'").select("path"))
        docs.select(relative, F.isnull("text").alias("broken")).write.parquet(f"{folder.path}/{aside}/docs")
        index.prepare(docs, embedder, config, root, semantic).write.parquet(f"{folder.path}/{aside}/rows")
        rows, failed = index.good_rows(spark.read.parquet(f"{folder.path}/{aside}/rows"))
        seen = spark.read.schema("file_path string, broken boolean").parquet(f"{folder.path}/{aside}/docs")
        changed = seen.where("not broken").select("file_path").join(failed, "file_path", "left_anti")
        index.apply_changes(spark, path, rows, ops.where("op = 'removed'").select(relative), changed, batch)
    finally:
        folder.delete(aside)


def watch(spark: SparkSession, events_dir: str, path: str, read: Callable[[DataFrame], DataFrame], embedder: embed.Embedder, root: str, checkpoint: str, config: IndexingConfig = IndexingConfig(), once: bool = False, wait: Callable[[float], None] = time.sleep, settle: int = 0) -> StreamingQuery:
    """A streaming query over event files; a batch that is run again after a failure is not applied twice.

    settle: milliseconds without an event of a path before its last one counts, so that bursts over several batches are one change
    (0: the last of each batch; not for a query that runs once). An index that is not ready yet is waited for, with growing waits; then the last failure is raised.
    """
    state.retried(lambda: index.open_index(spark, path, embedder.model_id, embedder.dimension), sleep=wait)
    stream = spark.readStream.schema(schema.EVENTS).parquet(events_dir)
    if settle and not once:
        stream = source.debounced(stream, settle)

    def each(events: DataFrame, number: int) -> None:
        apply_batch(events.sparkSession, path, events, read, embedder, root, config, number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


#: What a restart has to apply.
catch_up = source.differences
