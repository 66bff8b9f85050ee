"""Folders of files as rows of path, size and content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SUPPORTED_EXTENSIONS
from ..functions import paths
from .walk import SPLIT_BYTES, contents, line_parts, listed, reachable

HEAD_BYTES = 64 * 1024


@dataclass(frozen=True)
class Walk:
    """What a walk leaves out."""

    hidden: bool = True
    ignore_files: bool = True
    max_size: int = 0
    supported_only: bool = True


#: One preset for each use: exact search, index build (no size limit), listing (no hidden files, all types).
GREP, BUILD, LISTING = Walk(), Walk(), Walk(hidden=False, supported_only=False)


def _top(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return jvm, fs, fs.makeQualified(top).toString().rstrip("/") + "/"


def _relative(path: Column, base: str) -> Column:
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    return F.replace(plain(path), plain(F.lit(base)), F.lit(""))


def names(spark: SparkSession, root: str, walk: Walk = GREP, extensions: tuple[str, ...] | list[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """path, relative, size_bytes, file_type, modified of files below root that walk lets through, listed in tasks and written.

    A root in a store that only Spark's own readers open is listed by them; hidden files and ignore rules are not seen there.
    """
    _, _, base = _top(spark, root)
    if reachable(base):
        found = listed(spark, base, walk.hidden, walk.ignore_files)
    else:
        meta = F.col("_metadata")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select(_relative(F.col("path"), base).alias("relative"), meta["file_size"].alias("size_bytes"), meta["file_modification_time"].alias("modified"))
    path = F.concat(F.lit(base), "relative")
    kind = paths.file_type(path, extensions)
    if walk.supported_only:
        found = found.where(kind.isNotNull())
    if walk.max_size:
        found = found.where(F.col("size_bytes") <= walk.max_size)
    return found.select(path.alias("path"), "relative", "size_bytes", kind.alias("file_type"), "modified")


def with_content(found: DataFrame, root: str) -> DataFrame:
    """Files of names() and their contents, read in tasks."""
    spark = found.sparkSession
    _, _, base = _top(spark, root)
    if reachable(base):
        return contents(found, base)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select(_relative(F.col("path"), base).alias("relative"), "content")
    return found.join(read, "relative").select(*found.columns, "content")


def with_lines(found: DataFrame, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Files of lines of names(), with content, byte_base and line_base: whole (0, 0), or those over split_bytes in parts of whole lines.

    So no file is too large to be read, and tasks share the largest ones.
    """
    _, _, base = _top(found.sparkSession, root)
    none = F.lit(0).cast("long")
    whole = with_content(found.where(F.col("size_bytes") <= split_bytes) if reachable(base) else found, root).withColumns({"byte_base": none, "line_base": none})
    if not reachable(base):
        return whole
    large = found.where(F.col("size_bytes") > split_bytes)
    if large.isEmpty():
        return whole
    return whole.unionByName(line_parts(large, base, split_bytes))


def scan(spark: SparkSession, root: str, walk: Walk = GREP, extensions: tuple[str, ...] | list[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """path, relative, size_bytes, file_type, content of files below root that walk lets through.

    Types, sizes and ignore rules are tested on names before any content is read.
    """
    return with_content(names(spark, root, walk, extensions).drop("modified"), root)


def exists(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether path exists, and whether it is a folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(where), fs.exists(where) and fs.getFileStatus(where).isDirectory()


def confined(spark: SparkSession, path: str, root: str) -> bool:
    """Whether path is root or below it when links are followed; a path that does not exist is judged by its nearest folder that does."""
    if not paths.is_under(path, root):
        return False
    jvm = spark.sparkContext._jvm

    def real(name: str) -> str:
        where = jvm.org.apache.hadoop.fs.Path(name)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        below = []
        while not fs.exists(where) and where.getParent() is not None:
            below.insert(0, where.getName())
            where = where.getParent()
        if fs.getUri().getScheme() == "file":
            found = jvm.java.io.File(fs.makeQualified(where).toUri().getPath()).getCanonicalPath()
        else:
            found = fs.resolvePath(where).toUri().getPath()
        return "/".join([found.rstrip("/"), *below])

    return paths.is_under(real(path), real(root))


def strict_text(content: Column) -> Column:
    """Text of valid UTF-8, else null: what indexing reads."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def lossy_text(content: Column) -> Column:
    """Text with replacement characters for invalid bytes: what searching reads."""
    return F.make_valid_utf8(content.cast("string"))


def head_text(content: Column, size: int = HEAD_BYTES) -> Column:
    return F.make_valid_utf8(F.substring(content, 1, size).cast("string"))


def listing(files: DataFrame, max_size: int = 0, extensions: tuple[str, ...] | list[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """path, size_bytes, file_type, extension, omit_reason (null: listed), by parts of the path.

    A file of an unsupported type is shown as plain text.
    """
    kind = paths.file_type(F.col("path"), extensions)
    reason = paths.omit_reason(F.col("path"), F.col("size_bytes"), max_size, extensions)
    return files.select("path", "size_bytes", F.coalesce(kind, F.lit(paths.PLAIN_TEXT)).alias("file_type"), paths.extension_of(F.col("path")).alias("extension"), reason.alias("omit_reason"))


def in_order(listed: DataFrame) -> DataFrame:
    return listed.orderBy(F.split("path", "/"))
