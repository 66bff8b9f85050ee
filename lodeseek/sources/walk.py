"""Folders walked and files read in tasks: neither names nor contents pass through the driver.

A walk goes in rounds. Each round's tasks take folders, list them and go on below them until they have seen BUDGET entries; what is left then is
the next round's folders, dealt anew, so a tree of any shape keeps all tasks busy. A folder carries the rules of the
ignore files above it, and adds its own, so an ignored folder is never listed. Links are not followed.

Tasks open files through Arrow's file systems (local files, HDFS, S3, GCS), as a URI names them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import work
from .ignore import Rule, parse

#: Entries that a task lists before it hands on the folders it has left, and folders that are dealt to a task at most where there are many.
BUDGET, FOLDERS = 20_000, 4096
#: Bytes of contents that a batch of rows has, about, and that a task reads.
BATCH_BYTES, TASK_BYTES = 16 << 20, 64 << 20
LISTED = "relative string, size_bytes long, modified timestamp"
_RULES = "array<struct<expression:string,negated:boolean,folders:boolean>>"
_ROUND = f"folder string, rules {_RULES}, {LISTED}"
IGNORE_FILES = (".gitignore", ".ignore")
SCHEMES = ("file", "hdfs", "s3", "gs")


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    if re.match(r"file:/+", root):
        return pafs.LocalFileSystem(), "/" + re.sub("^file:/+", "", root)
    if ":" not in root.split("/", 1)[0]:
        return pafs.LocalFileSystem(), root
    return pafs.FileSystem.from_uri(root)


def reachable(root: str) -> bool:
    """Whether tasks can open a root by themselves; a store that only Spark's readers know they cannot."""
    return root.split(":", 1)[0] in SCHEMES or ":" not in root.split("/", 1)[0]


@lru_cache(maxsize=4096)
def _together(expressions: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile("|".join(f"(?:{e})" for e in expressions))


@lru_cache(maxsize=65536)
def _one(expression: str) -> re.Pattern[str]:
    return re.compile(expression)


def ignored(relative: str, is_folder: bool, rules: list[Rule]) -> bool:
    """Whether the last rule that fits an entry ignores it; most entries fit none, which one look at all rules tells."""
    if not rules or not _together(tuple(r[0] for r in rules)).fullmatch(relative):
        return False
    for expression, negated, only_folders in reversed(rules):
        if (is_folder or not only_folders) and _one(expression).fullmatch(relative):
            return not negated
    return False


def entries(fs: pafs.FileSystem, path: str) -> list[tuple[str, bool, int, object]]:
    """(name, is folder, size, modified) of what a folder holds, without links and other things; nothing if it cannot be listed."""
    if isinstance(fs, pafs.LocalFileSystem):
        import datetime
        import os

        out = []
        try:
            with os.scandir(path) as found:
                for e in found:
                    if e.is_symlink() or not (e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)):
                        continue
                    stat = e.stat(follow_symlinks=False)
                    out.append((e.name, e.is_dir(follow_symlinks=False), stat.st_size, datetime.datetime.fromtimestamp(stat.st_mtime, datetime.timezone.utc)))
        except OSError:
            return []
        return out
    try:
        found = fs.get_file_info(pafs.FileSelector(path))
    except OSError:
        return []
    return [(f.base_name, f.type == pafs.FileType.Directory, f.size or 0, f.mtime) for f in found if f.type in (pafs.FileType.Directory, pafs.FileType.File)]


class Walker:
    """Walks below a root from some folders on; folders are relative to it, "" is itself."""

    def __init__(self, root: str, hidden: bool, ignore_files: bool) -> None:
        self.fs, self.top = opened(root)
        self.top = self.top.rstrip("/")
        self.hidden, self.ignore_files = hidden, ignore_files

    def own_rules(self, folder: str, names: set[str]) -> list[Rule]:
        out = []
        for name in IGNORE_FILES:
            if name in names:
                try:
                    with self.fs.open_input_stream(f"{self.top}/{folder}{name}") as f:
                        out += parse(f.read().decode("utf-8", "replace"), folder)
                except OSError:
                    continue
        return out

    def walk(self, todo: list[tuple[str, list[Rule]]], budget: int) -> Iterator[tuple[str, list[Rule]] | tuple[str, int, object]]:
        """Files (relative, size, modified), and after `budget` entries the folders (path, rules) that are left."""
        seen = 0
        while todo:
            folder, rules = todo.pop()
            if seen >= budget:
                yield folder, rules
                continue
            found = entries(self.fs, f"{self.top}/{folder}")
            seen += 1 + len(found)
            if self.ignore_files:
                rules = rules + self.own_rules(folder, {name for name, is_folder, _, _ in found if not is_folder})
            for name, is_folder, size, modified in found:
                relative = folder + name
                if (not self.hidden and name.startswith(".")) or ignored(relative, is_folder, rules):
                    continue
                if is_folder:
                    todo.append((relative + "/", rules))
                else:
                    yield relative, size, modified


def tasks_of(folders: int, cores: int) -> int:
    """Tasks that a round's folders are dealt to: one each while they are few, four a core, then FOLDERS to a task."""
    return min(folders, max(4 * cores, -(-folders // FOLDERS)))


def listed(spark: SparkSession, root: str, hidden: bool = True, ignore_files: bool = True, budget: int = BUDGET) -> DataFrame:
    """relative, size_bytes, modified of all files below root that a walk finds, in a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(root, hidden, ignore_files)
        kinds = pa.struct([("expression", pa.string()), ("negated", pa.bool_()), ("folders", pa.bool_())])
        names = [c.split()[0] for c in ("folder", "rules", *LISTED.split(", "))]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.string(), pa.list_(kinds), pa.string(), pa.int64(), pa.timestamp("us", "UTC"))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for b in batches:
            given = [(r["folder"], [(x["expression"], x["negated"], x["folders"]) for x in r["rules"]]) for r in b.to_pylist()]
            rows: list[tuple] = []
            for got in walker.walk(given, budget):
                if len(got) == 2:
                    rows.append((got[0], [dict(zip(("expression", "negated", "folders"), x, strict=True)) for x in got[1]], None, None, None))
                else:
                    rows.append((None, None, *got))
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    folders, n = spark.createDataFrame([("", [])], f"folder string, rules {_RULES}"), 1
    rounds = []
    while n:
        dealt = folders.repartition(tasks_of(n, spark.sparkContext.defaultParallelism))
        found = work.written(dealt.mapInArrow(run, _ROUND), "walk")
        rounds.append(found.where("folder is null").select("relative", "size_bytes", "modified"))
        folders = found.where("folder is not null").select("folder", "rules")
        n = folders.count()
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (with relative and size_bytes) and content, read in tasks of about TASK_BYTES; a file that is gone by then is left out."""
    total = files.agg(F.sum("size_bytes"), F.count("*")).first()
    n = max(1, -(-(total[0] or 0) // TASK_BYTES), min(total[1], files.sparkSession.sparkContext.defaultParallelism))
    at, size_at = files.columns.index("relative"), files.columns.index("size_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(root)

        def read(relative: str) -> bytes | None:
            try:
                with fs.open_input_stream(f"{top.rstrip('/')}/{relative}") as f:
                    return f.read()
            except FileNotFoundError:
                return None

        def made(b: pa.RecordBatch, lo: int, held: list[bytes | None]) -> pa.RecordBatch:
            part = b.slice(lo, len(held))
            whole = pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*part.schema.names, "content"])
            return whole.filter(whole.column(whole.num_columns - 1).is_valid())

        for b in batches:
            lo, held, size = 0, [], 0
            for k, (relative, length) in enumerate(zip(b.column(at).to_pylist(), b.column(size_at).to_pylist(), strict=True)):
                if held and size + (length or 0) > BATCH_BYTES:
                    yield made(b, lo, held)
                    lo, held, size = k, [], 0
                held.append(read(relative))
                size += length or 0
            if held:
                yield made(b, lo, held)

    return files.repartition(int(n)).mapInArrow(run, files.select("*", F.lit(b"").alias("content")).schema)


def write_files(rows: DataFrame, root: str) -> int:
    """Writes each row (relative, content: binary) as a file below root, in the tasks that have the rows; how many. A task done again writes the same files."""
    at, content_at = rows.columns.index("relative"), rows.columns.index("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(root)
        last = None
        for b in batches:
            for relative, content in zip(b.column(at).to_pylist(), b.column(content_at), strict=True):
                path = f"{top.rstrip('/')}/{relative}"
                if (folder := path.rpartition("/")[0]) != last:
                    fs.create_dir(folder, recursive=True)
                    last = folder
                with fs.open_output_stream(path) as f:
                    f.write(content.as_buffer() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return work.bounded(rows).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


#: Bytes of a part of a large file of lines, about, and of the reads that look for line ends.
SPLIT_BYTES, BLOCK = 32 << 20, 1 << 20


def _starts(f: pa.NativeFile, size: int, at: int) -> int:
    """The first byte at `at` or behind it that begins a line (size: none does)."""
    if at == 0 or at >= size:
        return min(at, size)
    at -= 1
    f.seek(at)
    while block := f.read(BLOCK):
        k = block.find(b"\n")
        if k >= 0:
            return at + k + 1
        at += len(block)
    return size


def line_parts(files: DataFrame, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """files (with relative and size_bytes) in parts of whole lines: and byte_base, line_base, content.

    A part has the lines that begin within its range of split_bytes. A first pass over the ranges counts their lines, running sums
    over a file's ranges number them, and a second pass reads the parts, each by itself. A line longer than a range is in one part.
    """
    ranges = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size_bytes") - 1, F.lit(0)).cast("long"), F.lit(split_bytes).cast("long"))))
    at, size_at, part_at = (ranges.columns.index(c) for c in ("relative", "size_bytes", "part"))
    n = max(1, ranges.count())
    tasks = max(-(-n * split_bytes // TASK_BYTES), min(n, files.sparkSession.sparkContext.defaultParallelism))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(root)
        for b in batches:
            found = []
            for relative, size, part in zip(b.column(at).to_pylist(), b.column(size_at).to_pylist(), b.column(part_at).to_pylist(), strict=True):
                with fs.open_input_file(f"{top.rstrip('/')}/{relative}") as f:
                    size = min(size, f.size())
                    start, lines = _starts(f, size, part), 0
                    # A part that owns no line ends where it begins.
                    end = _starts(f, size, part + split_bytes) if start < part + split_bytes else start
                    f.seek(start)
                    left = end - start
                    while left > 0 and (block := f.read(min(BLOCK, left))):
                        lines += block.count(b"\n")
                        left -= len(block)
                    found.append((start, end, lines))
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "byte_base", "byte_end", "lines"])

    zero = F.lit(0).cast("long")
    spread = ranges.repartition(int(tasks))
    placed = work.written(spread.mapInArrow(counted, ranges.select("*", zero.alias("byte_base"), zero.alias("byte_end"), zero.alias("lines")).schema), "line-parts")
    before = Window.partitionBy("relative").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = placed.withColumn("line_base", F.coalesce(F.sum("lines").over(before), zero)).where(F.col("byte_end") > F.col("byte_base"))
    based = work.written(based.drop("part", "lines"), "line-bases")
    from_at, to_at = based.columns.index("byte_base"), based.columns.index("byte_end")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(root)
        for b in batches:
            for k in range(b.num_rows):  # one part a batch
                row = b.slice(k, 1)
                with fs.open_input_file(f"{top.rstrip('/')}/{row.column(at)[0].as_py()}") as f:
                    start, end = row.column(from_at)[0].as_py(), row.column(to_at)[0].as_py()
                    f.seek(start)
                    content = f.read(end - start)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], [*row.schema.names, "content"])

    return based.repartition(int(tasks)).mapInArrow(read, based.select("*", F.lit(b"").alias("content")).schema).drop("byte_end")


class _Folder(InputPartition):
    def __init__(self, todo: list[tuple[str, list[Rule]]]) -> None:
        super().__init__(todo)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        on = lambda name: options.get(name, "true").lower() != "false"
        self.walker = (options["path"], on("hidden"), on("ignoreFiles"))
        self.wanted = int(options.get("partitions", 64))

    def partitions(self) -> list[InputPartition]:
        """Folders near the root, found by listing few of them here; all below is listed by the tasks."""
        walker, todo, kept = Walker(*self.walker), [("", [])], []
        while todo and len(todo) < self.wanted and len(kept) < 4 * self.wanted:
            folder, rules = todo.pop(0)
            below = [x for x in walker.walk([(folder, rules)], 1) if len(x) == 2]
            kept.append((folder, rules))
            todo += below
        # A kept folder gives its own files only; the others go down.
        return [_Folder([("=", k)]) for k in kept] + [_Folder([("/", t)]) for t in todo]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for how, start in partition.value:
            for got in Walker(*self.walker).walk([start], 1 if how == "=" else 1 << 62):
                if len(got) == 3:
                    yield got


class FolderSource(DataSource):
    """spark.read.format("folder").load(root): relative, size_bytes, modified of a walk's files. Options hidden, ignoreFiles, partitions.

    Listed anew each time it is read, without a table between; trees with few large branches are better off with listed().
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)
