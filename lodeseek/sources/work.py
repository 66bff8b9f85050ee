"""Tables written on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and the session is local (tests), a temporary folder that is then set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeseek-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the work folder; what is written there goes when the driver's JVM ends."""
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once and read back."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the Arrow batches that Python workers get, about; a longer row comes alone.
BATCH_BYTES = 16 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have a bound in bytes: the session's own where it has a lower one, else BATCH_BYTES."""
    conf = df.sparkSession.conf
    found = re.sub(r"\D", "", str(conf.get(_BATCH_CONF, None) or ""))
    if not found or int(found) > BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df


#: Bytes of the rows that a Python worker turns into objects at once, which take many times as much.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about SLICE_BYTES in a column of texts; a longer row comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo = held = 0
    for k, size in enumerate(sizes):
        if k > lo and held + size > SLICE_BYTES:
            yield batch.slice(lo, k - lo)
            lo = k
            held = 0
        held += int(size)
    if batch.num_rows > lo:
        yield batch.slice(lo)
