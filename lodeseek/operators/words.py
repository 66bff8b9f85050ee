"""Words of pages from their characters: gaps and islands over rows of characters, in built-in expressions.

White space ends a word and stays in the text; so does the end of a line, which is a line end of the text. A word's box is the smallest around
the boxes of its characters that have an area; where none has, the word has no box. Rows without a character
are no part of any text, but keep their line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import SPACES


def documents_of_characters(chars: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, source_map (a segment a word), page_count of characters (keys, page, line, at, char, x1, y1, x2, y2).

    Characters meet in one task by line, lines by document. Lines are in order of page and line, characters of at.
    """
    line_keys = [*keys, "page", "line"]
    within = Window.partitionBy(*line_keys).orderBy("at")
    real = chars.where("char is not null and char <> ''").withColumns({"space": F.contains(F.lit(SPACES), F.col("char")), "size": F.octet_length("char").cast("long")})
    placed = real.withColumns({"from": F.sum("size").over(within) - F.col("size"), "island": F.sum(F.col("space").cast("int")).over(within)})
    area = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    least = lambda c: F.min(F.when(area, F.col(c)))
    most = lambda c: F.max(F.when(area, F.col(c)))
    words = placed.where("not space").groupBy(*line_keys, "island").agg(F.min("from").alias("start"), F.max(F.col("from") + F.col("size")).alias("end"), least("x1").alias("x"), least("y1").alias("y"), most("x2").alias("right"), most("y2").alias("bottom"))
    box = F.when(F.col("x").isNotNull(), F.struct(F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), (F.col("right") - F.col("x")).cast("float").alias("width"), (F.col("bottom") - F.col("y")).cast("float").alias("height")))
    in_line = words.groupBy(*line_keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", box.alias("bbox")))).alias("words"))
    kept = F.when(F.col("char").isNotNull(), F.struct("at", "char"))
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda c: c["char"]), ""), F.lit("\n"))
    lines = chars.groupBy(*line_keys).agg(text.alias("body")).join(in_line, line_keys, "left")
    order = Window.partitionBy(*keys).orderBy("page", "line")
    size = F.octet_length("body").cast("long")
    based = lines.withColumn("base", F.sum(size).over(order) - size)
    nothing = F.lit(None).cast("int")
    segment = lambda w: F.struct(
        (F.col("base") + w["start"]).alias("start"), (F.col("base") + w["end"]).alias("end"),
        F.struct(F.lit("PdfPage").alias("origin_type"), nothing.alias("line"), nothing.alias("col"), F.col("page").cast("int").alias("page"), w["bbox"].alias("bbox")).alias("origin"),
    )
    found = based.select(*keys, "page", "line", "body", F.coalesce(F.transform("words", segment), F.expr(f"cast(array() as array<{schema.SEGMENT}>)")).alias("segments"))
    whole = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page", "line", "body", "segments"))).alias("lines"), F.max("page").cast("int").alias("page_count"))
    return whole.select(*keys, F.array_join(F.transform("lines", lambda x: x["body"]), "").alias("text"), F.flatten(F.transform("lines", lambda x: x["segments"])).alias("source_map"), "page_count")
