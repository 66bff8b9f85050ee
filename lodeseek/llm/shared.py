"""What several operators share: the shared work folder, ``let`` bindings, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as the body of a regex class.
SPACE_CLASS = r"\x20\x09-\x0D"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where the session has none and runs on this machine alone (tests), a temporary folder is made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeseek-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Lists of the folders written while recorded() is open, in this thread (or task) only.
_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Within it, the folders that write_shared makes are listed."""
    made: list[str] = []
    before = _recorders.set((*_recorders.get(), made))
    try:
        yield made
    finally:
        _recorders.reset(before)


def _reads(df: DataFrame) -> list[str]:
    """Folders that df's plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    plans = [leaves.apply(k) for k in range(leaves.size())]
    found = [p.relation().location().rootPaths() for p in plans if p.getClass().getSimpleName() == "LogicalRelation" and hasattr(p.relation(), "location")]
    return [paths.apply(k).toString() for paths in found for k in range(paths.size())]


def release(spark: SparkSession, folders: list[str], unless_read_by: DataFrame) -> list[str]:
    """Deletes folders that a plan does not read; gives those that it does."""
    used = [p.split(":", 1)[-1].lstrip("/") for p in _reads(unless_read_by)]
    left = []
    for folder in folders:
        if any(p.startswith(folder.split(":", 1)[-1].lstrip("/")) for p in used):
            left.append(folder)
            continue
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return left


def forget(written: DataFrame) -> None:
    """Deletes the folder of what write_shared gave, once all that came from it is written."""
    paths = _reads(written)
    for made in _recorders.get():
        made[:] = [m for m in made if not any(p.split(":", 1)[-1].lstrip("/") == m.split(":", 1)[-1].lstrip("/") for p in paths)]
    release(written.sparkSession, [p for p in paths if p.split(":", 1)[-1].lstrip("/").startswith(shared_dir(written.sparkSession).split(":", 1)[-1].lstrip("/"))], written.sparkSession.range(0))


_CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_clean_lock = threading.Lock()
_clean_open: list[str | None] = []


@contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffles is deleted as it ends, not when the driver happens to collect its garbage."""
    with _clean_lock:
        _clean_open.append(_clean_open[0] if _clean_open else spark.conf.get(_CLEAN_CONF, None))
        spark.conf.set(_CLEAN_CONF, "true")
    try:
        yield
    finally:
        with _clean_lock:
            before = _clean_open.pop()
            if not _clean_open:
                spark.conf.unset(_CLEAN_CONF) if before is None else spark.conf.set(_CLEAN_CONF, before)


def write_shared(df: DataFrame, tag: str, **options: int) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage; its shuffle files go at once.

    The files survive the loss of any executor; they go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _without_shuffles(spark):
        df.write.options(**options).parquet(path)
    for made in _recorders.get():
        made.append(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the Arrow batches that Python workers get, about; a longer row comes alone.
BATCH_BYTES = 6 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame, most: int = 0) -> DataFrame:
    """df, in a session whose Arrow batches have a bound in bytes (10,000 long texts are no longer one batch): most, or BATCH_BYTES."""
    conf, most = df.sparkSession.conf, most or BATCH_BYTES
    if int(re.sub(r"\D", "", str(conf.get(_BATCH_CONF, None) or "")) or 1 << 40) > most:
        conf.set(_BATCH_CONF, str(most))
    return df


_Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Gives what Arrow and C have freed in this process back to the system; else a worker holds it while it waits for other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable[[_Batches], _Batches]) -> Callable[[_Batches], _Batches]:
    """run, a function for mapInArrow, that gives back at its end what it has freed."""

    @wraps(run)
    def whole(batches: _Batches) -> _Batches:
        yield from run(batches)
        give_back()

    return whole


def by_size(batches: Iterator[pa.RecordBatch], at: int, most: int = 3 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """batches cut so that the texts of column at take `most` bytes or less (a longer text comes alone), in `rows` rows or fewer."""
    for b in batches:
        sizes = pc.binary_length(b.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, lo = np.cumsum(sizes), 0
        while lo < b.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = min(max(lo + 1, int(np.searchsorted(ends, before + most, "right"))), lo + rows)
            yield b.slice(lo, hi - lo)
            lo = hi


#: Rows of one number that are broadcast at most (some 10 MB in an executor).
BROADCAST_ROWS = 500_000


def only(df: DataFrame, written: DataFrame, on: str) -> DataFrame:
    """Rows of df whose column on is in written, a written table of numbers: broadcast if they are few, else joined by a shuffle.

    They are counted first, so the texts of df are not shuffled for a table that turns out to be small.
    """
    return df.join(F.broadcast(written) if written.count() <= BROADCAST_ROWS else written, on, "left_semi")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; all other characters stay."""
    return F.translate(text, _UPPER, _UPPER.lower())


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns named (in any case), which an operator is about to add."""
    lower = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in lower])
