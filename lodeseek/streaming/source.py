"""Where file events come from: listings of a folder, compared, and bursts of events made one.

A poll lists the folder in tasks and joins the listing with the one before; what differs goes to a folder of event files, which a stream
reads. The number of the listing is moved on last, so a poll that fails is made again, and an event that comes twice changes
nothing. After a restart the first poll finds what changed meanwhile.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from .. import schema
from ..config import SUPPORTED_EXTENSIONS
from ..operators.store import Folder
from ..sources import files

_LISTING = "path string, size_bytes long, modified timestamp"


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of two listings (path, size_bytes, modified) that differ, with op: changed or removed."""
    both = old.select("path", F.struct("size_bytes", "modified").alias("a")).join(new.select("path", F.struct("size_bytes", "modified").alias("b")), "path", "full")
    op = F.when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("path", op.alias("op")).where("op is not null")


def poll(spark: SparkSession, root: str, state: str, extensions: tuple[str, ...] | list[str] = SUPPORTED_EXTENSIONS) -> int:
    """Lists root once and adds what changed since the last poll to the event files below state; how many events."""
    folder = Folder(spark, state)
    number = int(folder.read("LISTING")) if folder.exists("LISTING") else 0
    listing = f"{folder.path}/listing-{number + 1}"
    path = F.regexp_replace("path", "^file:/+", "/").alias("path")
    files.names(spark, root, files.BUILD, extensions).select(path, "size_bytes", "modified").write.mode("overwrite").parquet(listing)
    new = spark.read.schema(_LISTING).parquet(listing)
    old = spark.read.schema(_LISTING).parquet(f"{folder.path}/listing-{number}") if number else new.limit(0)
    found = differences(old, new)
    events = found.select("path", (F.col("op") == "changed").alias("exists"), (F.col("op") == "changed").alias("is_file"), F.current_timestamp().alias("ts"))
    events.write.mode("append").parquet(f"{folder.path}/events")
    folder.write("LISTING", str(number + 1))
    folder.delete(f"listing-{number - 1}")
    return found.count()


def start(spark: SparkSession, root: str, state: str, checkpoint: str, every: str = "1 second", extensions: tuple[str, ...] | list[str] = SUPPORTED_EXTENSIONS) -> StreamingQuery:
    """A query that polls root again and again; its ticks have no rows of their own."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: poll(spark, root, state, extensions) and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Settle(StatefulProcessor):
    """Holds a path's last event until none has come for a while; each event starts the wait anew."""

    def __init__(self, milliseconds: int) -> None:
        self.milliseconds = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, exists boolean, is_file boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = [tuple(r) for part in rows for r in part[["ts", "exists", "is_file"]].itertuples(index=False)]
        if self.last.exists():
            events.append(tuple(self.last.get()))
        last = max(events, key=lambda e: pd.Timestamp(e[0]).tz_localize(None) if pd.Timestamp(e[0]).tzinfo is None else pd.Timestamp(e[0]).tz_convert(None))
        self.last.update((pd.Timestamp(last[0]).to_pydatetime(), bool(last[1]), bool(last[2])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.milliseconds)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.last.exists():
            yield pd.DataFrame()
            return
        ts, exists, is_file = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"path": [key[0]], "exists": [exists], "is_file": [is_file], "ts": [ts]})

    def close(self) -> None:
        pass


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def debounced(events: DataFrame, milliseconds: int = 500) -> DataFrame:
    """A stream of file events with one event, the last, for each burst of a path, over batches too.

    The state is one event a path, in the store that timers need, which the session is set to where it has another.
    """
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if events.sparkSession.conf.get(_PROVIDER, None) != rocks:
        events.sparkSession.conf.set(_PROVIDER, rocks)
    return events.groupBy("path").transformWithStateInPandas(Settle(milliseconds), outputStructType=schema.EVENTS, outputMode="Append", timeMode="ProcessingTime")
