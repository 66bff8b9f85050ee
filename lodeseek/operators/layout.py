"""How an index lies on disk: buckets that split, parts, tombstones, and a log of versions.

A row's bucket follows from its path's hash and the number of buckets by linear hashing: one more bucket splits one older bucket and moves no
other row. A bucket is a list of parts, each written by one version with its number. A change writes new rows as parts of the buckets
that it touches, and the paths whose older rows are gone as tombstones with its number; readers leave out rows of such paths with a smaller number.
So a change writes as much as it changes. Compaction writes a bucket anew where a share of its rows is dead, merges its small parts where
there are many, and splits buckets as the index grows, so each row is written again a number of times that grows with the logarithm of the index.

A version is a description: counts, and the buckets' entries, whole every FULL_EVERY versions and in between only those that changed. A pointer names the current
version; what a version no longer uses is deleted when no version that is kept uses it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from .store import Folder

#: Rows of a bucket, about, and of a file at most.
BUCKET_ROWS = 100_000
#: A bucket is written anew when so large a share of its rows is dead, and its small parts merged when it has more than so many.
DEAD_SHARE, MOST_PARTS = 0.3, 8
FULL_EVERY = 16
#: Buckets that a task writes, about, where many are written.
TASK_BUCKETS = 16
#: Paths with tombstones that are broadcast at most.
BROADCAST_PATHS = 200_000
COLUMNS = [c.split()[0] for c in schema.INDEX.split(", ")]
_PART = f"{schema.INDEX}, number long, bucket int"
_TOMBS = "file_path string, n long, number long, bucket int"


def bucket_of(path: Column, buckets: int) -> Column:
    low = 1 << (buckets.bit_length() - 1)
    wide = F.pmod(F.xxhash64(path), F.lit(2 * low))
    return F.when(wide < buckets, wide).otherwise(F.pmod(F.xxhash64(path), F.lit(low))).cast("int")


def split_from(bucket: int, buckets: int) -> int:
    """Which of `buckets` buckets the rows of a bucket come from that is made by further splits."""
    while bucket >= buckets:
        bucket -= 1 << (bucket.bit_length() - 1)
    return bucket


def entry() -> dict:
    return {"parts": [], "deleted": [], "rows": 0, "files": 0, "dead": 0}


def _read(spark: SparkSession, path: str, kind: str, places: list[str], of: str) -> DataFrame:
    if not places:
        return spark.createDataFrame([], of)
    # Spark lists folders in a task each, up to this many; there are as many folders as buckets.
    conf, most = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(conf)) > most:
        spark.conf.set(conf, str(most))
    return spark.read.schema(of).option("basePath", f"{path.rstrip('/')}/{kind}").parquet(*[f"{path.rstrip('/')}/{p}" for p in places])


def live(spark: SparkSession, path: str, entries: dict[str, dict], only: Column | None = None) -> DataFrame:
    """Rows of buckets, with number and bucket, without those that tombstones cover. only: a condition on file_path for the scans.

    Buckets without tombstones are read as they are.
    """
    where = lambda df: df if only is None else df.where(only)
    clean = [p["path"] for e in entries.values() if not e["deleted"] for p in e["parts"]]
    marked = [e for e in entries.values() if e["deleted"] and e["parts"]]
    rows = where(_read(spark, path, "rows", clean, _PART))
    if not marked:
        return rows
    tombs = where(_read(spark, path, "deleted", [d["path"] for e in marked for d in e["deleted"]], _TOMBS)).groupBy("bucket", "file_path").agg(F.max("number").alias("gone"))
    if sum(d["files"] for e in marked for d in e["deleted"]) <= BROADCAST_PATHS:
        tombs = F.broadcast(tombs)
    older = where(_read(spark, path, "rows", [p["path"] for e in marked for p in e["parts"]], _PART)).alias("r")
    t = tombs.alias("t")
    same = (F.col("r.bucket") == F.col("t.bucket")) & (F.col("r.file_path") == F.col("t.file_path")) & (F.col("r.number") < F.col("t.gone"))
    return rows.unionByName(older.join(t, same, "left_anti"))


def _dealt(rows: DataFrame, filled: int, *keys: Column | str) -> DataFrame:
    """rows by keys, in enough tasks for the files of `filled` buckets: small rows in many files would all be left to one task else."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if filled <= cores:
        return rows.repartition(*keys)
    return rows.repartition(min(filled, max(4 * cores, -(-filled // TASK_BUCKETS))), *keys)


def write_rows(spark: SparkSession, path: str, rows: DataFrame, buckets: int, number: int, filled: int | None = None) -> dict[str, dict]:
    """Writes rows as parts: {bucket: {path, number, rows, files, bytes}}. A bucket is one file, or one for each BUCKET_ROWS of its rows.

    filled: how many buckets rows lie in, about (all, if not given).
    """
    folder, place = Folder(spark, path), f"rows/number={number}"
    dealt = rows.select(*COLUMNS).withColumn("bucket", bucket_of(F.col("file_path"), buckets))
    # Chunks of one huge file are spread too.
    dealt = _dealt(dealt, buckets if filled is None else filled, "bucket", F.floor(F.col("chunk_idx") / BUCKET_ROWS)).sortWithinPartitions("bucket", "file_path", "chunk_idx")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", BUCKET_ROWS).partitionBy("bucket").parquet(f"{folder.path}/{place}")
    return _counted(spark, path, "rows", place, _PART, F.count("*"), number)


def write_deleted(spark: SparkSession, path: str, gone: DataFrame, number: int, filled: int = 1) -> dict[str, dict]:
    """Writes tombstones (file_path, n: their rows, bucket): {bucket: {path, number, rows, files, bytes}}. filled: how many buckets they lie in, about."""
    place = f"deleted/number={number}"
    _dealt(gone, filled, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path.rstrip('/')}/{place}")
    return _counted(spark, path, "deleted", place, _TOMBS, F.sum("n"), number)


def _counted(spark: SparkSession, path: str, kind: str, place: str, of: str, n_rows: Column, number: int) -> dict[str, dict]:
    """What a version wrote at a place, by bucket, from one read of it."""
    stored = F.collect_set(F.struct("_metadata.file_path", "_metadata.file_size"))
    size = F.aggregate(stored, F.lit(0).cast("long"), lambda total, file: total + file["file_size"])
    found = _read(spark, path, kind, [place], of).groupBy("bucket").agg(n_rows.alias("rows"), F.countDistinct("file_path").alias("files"), size.alias("bytes")).collect()
    return {str(r["bucket"]): {"path": f"{place}/bucket={r['bucket']}", "number": number, "rows": r["rows"], "files": r["files"], "bytes": r["bytes"]} for r in found}


# the log


def _name(number: int) -> str:
    return f"v{number:08d}"


def commit(folder: Folder, meta: dict, entries: dict[str, dict], changed: set[str] | None, removed: list[str]) -> dict:
    """Writes a version and moves the pointer to it. changed: buckets whose entries differ from the version before (None: all).

    Totals are changed along with the entries, so nothing reads rows for them.
    """
    full = changed is None or meta["number"] - meta.get("base", 0) >= FULL_EVERY
    meta = meta | {
        "indexed_files": sum(e["files"] for e in entries.values()), "total_chunks": sum(e["rows"] for e in entries.values()),
        "db_size_bytes": sum(p["bytes"] for e in entries.values() for p in [*e["parts"], *e["deleted"]]), "base": meta["number"] if full else meta["base"],
    }
    body = meta | {"removed": removed} | ({"parts": entries} if full else {"changed": {b: entries.get(b) for b in sorted(changed)}})
    folder.write(f"{_name(meta['number'])}.json", json.dumps(body))
    folder.write("CURRENT", _name(meta["number"]))
    return meta | {"parts": entries}


def description(folder: Folder) -> dict:
    """The current version's description, without the entries of buckets."""
    version = folder.read("CURRENT")
    return json.loads(folder.read(f"{version}.json")) | {"version": version}


def with_entries(folder: Folder, meta: dict) -> dict:
    """A description with the entries of all buckets (parts): the last whole ones, and what changed since."""
    if "parts" in meta:
        return meta
    entries = json.loads(folder.read(f"{_name(meta['base'])}.json"))["parts"]
    for number in range(meta["base"] + 1, meta["number"] + 1):
        changed = meta["changed"] if number == meta["number"] else json.loads(folder.read(f"{_name(number)}.json"))["changed"]
        entries = {b: e for b, e in (entries | changed).items() if e is not None}
    return {k: v for k, v in meta.items() if k != "changed"} | {"parts": entries}


def vacuum(folder: Folder, keep: int) -> None:
    """Deletes what no version among the last `keep` uses; a reader of an older one has that long."""
    numbers = sorted(int(n[1:-5]) for n in folder.names() if n.startswith("v") and n.endswith(".json"))
    oldest = numbers[-keep:][0]
    done = int(folder.read("VACUUMED")) if folder.exists("VACUUMED") else 0
    base = json.loads(folder.read(f"{_name(oldest)}.json")).get("base", oldest)
    for number in numbers:
        if done < number <= oldest:
            for place in json.loads(folder.read(f"{_name(number)}.json")).get("removed", []):
                folder.delete(place)
    if oldest > done:
        folder.write("VACUUMED", str(oldest))
    for number in numbers:
        if number < base:  # the whole entries that kept versions build on stay
            folder.delete(f"{_name(number)}.json")
            folder.delete(f"{_name(number)}-errors")


# compaction


def small_parts(parts: list[dict]) -> list[dict]:
    """Parts to merge: all smaller ones, from the smallest on, up to the first that outweighs those before it twice; two at least."""
    ordered, total = sorted(parts, key=lambda p: p["rows"]), 0
    for k, part in enumerate(ordered):
        if k > 1 and part["rows"] > 2 * total:
            return ordered[:k]
        total += part["rows"]
    return ordered


def compact(spark: SparkSession, path: str, meta: dict, touched: set[str], bucket_rows: int = BUCKET_ROWS) -> dict:
    """A version after meta with buckets compacted and split where that is due; meta as it is where nothing is."""
    entries, buckets = dict(meta["parts"]), int(meta["buckets"])
    wanted = max(buckets, -(-meta["total_chunks"] // bucket_rows))
    split = {str(split_from(b, buckets)) for b in range(buckets, wanted)}
    whole = {b for b in touched if b in entries and entries[b]["dead"] > DEAD_SHARE * (entries[b]["rows"] + entries[b]["dead"])}
    whole = (whole | split) & entries.keys()
    merged = {b: small_parts(entries[b]["parts"]) for b in touched - whole if b in entries and len(entries[b]["parts"]) > MOST_PARTS}
    if not whole and not merged and wanted == buckets:
        return meta
    number = meta["number"] + 1
    sources = {b: entries[b] for b in whole} | {b: entries[b] | {"parts": parts} for b, parts in merged.items()}
    made = write_rows(spark, path, live(spark, path, sources), wanted, number, len(sources) + wanted - buckets)
    removed = [p["path"] for e in sources.values() for p in e["parts"]] + [d["path"] for b in whole for d in entries[b]["deleted"]]
    for b in whole:
        del entries[b]
    for b, parts in merged.items():
        lost = sum(p["rows"] for p in parts) - made.get(b, {"rows": 0})["rows"]
        entries[b] = entries[b] | {"parts": [p for p in entries[b]["parts"] if p not in parts], "dead": entries[b]["dead"] - lost}
        if not entries[b]["parts"]:  # tombstones have nothing left to cover
            removed += [d["path"] for d in entries[b]["deleted"]]
            entries[b]["deleted"] = []
    for b, part in made.items():
        old = entries.get(b) if b in merged else None
        entries[b] = (old | {"parts": [*old["parts"], part]}) if old else entry() | {"parts": [part], "rows": part["rows"], "files": part["files"]}
    entries = {b: e for b, e in entries.items() if e["parts"]}
    changed = whole | set(merged) | set(made) | split
    return commit(Folder(spark, path), {k: v for k, v in meta.items() if k not in ("parts", "version")} | {"number": number, "buckets": wanted}, entries, changed, removed)
