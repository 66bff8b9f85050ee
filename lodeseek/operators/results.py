"""Results as lists show them: collapsed rows, history, navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLLAPSED = 5


def collapsed(matches: DataFrame, limit: int = COLLAPSED) -> DataFrame:
    """Rows (kind, path, match_index, start, total) of a result list: a file, its first matches, and a row to expand if there are more."""
    order = Window.partitionBy("path").orderBy("start", "end")
    # So written, the first rows of each path are picked before anything is shuffled.
    few = matches.select("path", "start", "end").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    few = few.select(F.lit("match").alias("kind"), "path", (F.col("n") - 1).alias("match_index"), "start", F.lit(None).cast("long").alias("total"))
    totals = matches.groupBy("path").agg(F.count("*").alias("total"))
    kinds = F.when(F.col("total") > limit, F.array(F.lit("file"), F.lit("expand"))).otherwise(F.array(F.lit("file")))
    heads = totals.select(F.explode(kinds).alias("kind"), "path", F.lit(None).cast("int").alias("match_index"), F.lit(None).cast("long").alias("start"), "total")
    return few.unionByName(heads)


def without_repeats(history: DataFrame, key: str, order: str, same: list[str]) -> DataFrame:
    """history without rows equal (in columns same) to the row before, for each key."""
    w = Window.partitionBy(key).orderBy(order)
    again = F.lit(True)
    for c in same:
        again = again & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return history.withColumn("__keep", first | ~again).where("__keep").drop("__keep")


def find_in_page(segments: DataFrame, wanted: str) -> DataFrame:
    """Segments (columns page, item, text) that contain wanted in any case, numbered page by page."""
    hits = segments.where(F.contains(F.lower("text"), F.lit(wanted.lower())))
    keys = [c for c in hits.columns if c not in ("page", "item", "text")]
    return hits.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("page", "item")) - 1)


def step(current: int, total: int, by: int) -> int:
    """The next hit's number, around the ends."""
    return (current + by) % total if total else 0
