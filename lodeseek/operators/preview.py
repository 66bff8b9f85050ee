"""Previews: where a match is highlighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SUPPORTED_EXTENSIONS
from ..functions import paths
from ..functions import text as t
from ..sources import files


def highlight(text: Column, start: Column, end: Column, line: Column, compat: bool = False) -> Column:
    """highlight_line and the range in UTF-16 units of a byte range, or of a line where there is no range.

    Line 0 without a range is no highlight. compat: a range at a line's start counts to the line before.
    """
    of = t.compat_line_of if compat else t.line_of
    first = t.utf16_length(t.byte_prefix(text, start)).cast("long")
    units = t.utf16_length(t.byte_slice(text, start, end)).cast("long")
    made = lambda n, a, b: F.struct(n.cast("int").alias("highlight_line"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    of_range = made(of(text, start), first, first + units)
    of_line = t.let(t.line_range(text, line), lambda r: made(line, r["start"], r["end"]))
    return F.when(start.isNotNull(), of_range).when(line == 0, made(F.lit(0), F.lit(0), F.lit(0))).otherwise(of_line)


def of_pages(page: Column, box: Column) -> Column:
    """The preview of a match in a document with pages: its page and box, as they are."""
    return F.struct(F.lit("Pdf").alias("kind"), page.cast("int").alias("page"), box.alias("bbox"))


def opened(path_type: Column, text: Column, language: Column) -> Column:
    """What opening a file shows: page 1 of a document with pages, else its text from the top; an error for other types."""
    pdf = path_type == "Pdf"
    return F.struct(
        F.when(pdf, "Pdf").when(path_type.isNotNull(), "Text").alias("kind"), F.when(pdf, 1).alias("page"), F.when(~pdf, text).alias("content"),
        F.when(~pdf, language).alias("language"), F.when(~pdf, 0).alias("highlight_line"),
        F.when(path_type.isNull(), "unsupported file type").alias("error"),
    )


def open_file(spark: SparkSession, path: str, root: str, extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """One row of what opening a file below root shows. A path that leads out of root, by links too, is refused, as is an unsupported type."""
    if not files.confined(spark, path, root):
        raise PermissionError(f"{path} is not below {root}")
    found = spark.createDataFrame([(path,)], "path string").withColumn("file_type", paths.file_type(F.col("path"), extensions))
    kind = found.first()["file_type"]
    if kind is None:
        raise ValueError(f"unsupported file type: {path}")
    text = F.lit(None).cast("string")
    if kind == paths.PLAIN_TEXT:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            text = F.lit(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace"))
        finally:
            stream.close()
    return found.select("path", opened(F.col("file_type"), text, paths.language_hint(F.col("path"))).alias("shown")).select("path", "shown.*")
