"""Semantic search: exact cosine top-k over stored vectors, grouped by file in rank order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SUPPORTED_EXTENSIONS
from ..functions import paths, vectors
from ..sources import work
from ..sources.work import bounded

KNOWN_ORIGINS = ("TextFile", "PdfPage")


def check_dimension(found: int, query: list[float]) -> None:
    if len(query) != found:
        raise ValueError(f"dimension mismatch: the index has {found}, the query {len(query)}")


def scored(index: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    return index.withColumn("score", vectors.cosine(F.col(vector), query))


def top_k(index: DataFrame, query: list[float], k: int, ties: list[str], vector: str = "embedding") -> DataFrame:
    """The k rows nearest to query (0: all), by score, then ties; rank from 0.

    Each task keeps its own k; the query is a literal. Scores are ranked on keys and vectors alone, no texts. Vectors of zeros have
    no score and come last.
    """
    ranked = scored(index.select(*ties, vector), query, vector).select(*ties, "score").orderBy(F.desc_nulls_last("score"), *ties)
    if k > 0:
        ranked = ranked.limit(k)
    return ranked


def with_columns_of(hits: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """hits with the other columns of an index, which is read whole: give it the rows of the hits' files alone where they are few."""
    return hits.join(index, keys)


def supported(hits: DataFrame, extensions: tuple[str, ...] | list[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """Hits in files still searched and of a known origin; applied behind the limit, so fewer than k may stay."""
    return hits.where(paths.file_type(F.col("file_path"), extensions).isNotNull() & F.col("origin_type").isin(*KNOWN_ORIGINS))


def decoded(hits: DataFrame, root: str) -> DataFrame:
    """Hits as matches: absolute path, origin, a box only if it is whole, a text range for text only."""
    box = F.when(
        F.col("bbox_x").isNotNull() & F.col("bbox_y").isNotNull() & F.col("bbox_w").isNotNull() & F.col("bbox_h").isNotNull(),
        F.struct(F.col("bbox_x").cast("float").alias("x"), F.col("bbox_y").cast("float").alias("y"), F.col("bbox_w").cast("float").alias("width"), F.col("bbox_h").cast("float").alias("height")),
    )
    in_text = F.col("origin_type") == "TextFile"
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    return hits.select(
        paths.absolute(F.col("file_path"), root).alias("path"), F.col("chunk_text").alias("matched_text"), F.lit("").alias("context_before"), F.lit("").alias("context_after"),
        "origin_type", F.when(in_text, number("line")).alias("line"), F.when(in_text, number("col")).alias("col"), F.when(~in_text, number("page")).alias("page"),
        F.when(~in_text, box).alias("bbox"), F.when(in_text, F.col("byte_start")).alias("start"), F.when(in_text, F.col("byte_end")).alias("end"), F.col("score").cast("float").alias("score"), "chunk_idx",
    )


def by_file(hits: DataFrame, key: str, ties: list[str], score: str = "score", few: bool = True) -> DataFrame:
    """Hits grouped by file in rank order: rank (0: the file of the best hit), key, best_score, n, matches (all other columns, best first).

    few: hits are a search's k rows, so one task can rank them; else they are ranked in ranges of their order.
    """
    order = [F.desc_nulls_last(score), *ties]
    others = [c for c in hits.columns if c != key]
    ranked = numbered(hits, order, "rank") if not few else hits.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    grouped = ranked.groupBy(key).agg(F.min("rank").alias("first"), F.max(score).alias("best_score"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", *others))).alias("matches"))
    files = numbered(grouped, [F.col("first")], "rank") if not few else grouped.withColumn("rank", (F.row_number().over(Window.orderBy("first")) - 1).cast("long"))
    return files.select("rank", key, "best_score", "n", "matches").orderBy("rank")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their number from 0 in an order, without all of them in one task.

    Rows are dealt in ranges of the order and written, numbered within a range, and moved on by how many the ranges before have.
    """
    spark = rows.sparkSession
    dealt = work.written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()  # one row a range
    before = [(r["__range"], sum(x["n"] for x in sizes[:k])) for k, r in enumerate(sizes)]
    starts = F.broadcast(spark.createDataFrame(before, "__range int, __before long"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("__within", within).join(starts, "__range").select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__before") + F.col("__within")).alias(name))


#: Vectors that a task holds at once, and questions that meet them at once.
VECTORS_AT_ONCE, QUESTIONS_AT_ONCE = 32_768, 512


def top_k_each(index: DataFrame, questions: DataFrame, k: int, ties: list[str], vector: str = "embedding", block: int = QUESTIONS_AT_ONCE, at_once: int = VECTORS_AT_ONCE) -> DataFrame:
    """The k rows nearest to each of many questions (query_id, query): query_id, ties, score, rank.

    Vectors are dealt into groups of about `at_once`; questions go to all groups, in rows of about `block`. A task takes a group's vectors and
    then one row of questions after another, each as one matrix product, and keeps k rows a question. So neither side passes through the
    driver, and what is shuffled at the end is k rows a question and group.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    kept, n_ties = index.select(*ties, F.col(vector).cast("array<double>").alias("__vector")), len(ties)
    n_groups, n_blocks = max(1, -(-kept.count() // at_once)), max(1, -(-questions.count() // block))
    # Dealt by the vector's own hash: copies of a row are spread by their ties.
    group = F.pmod(F.xxhash64(*ties, "__vector"), F.lit(n_groups)).cast("int")
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    rows_of_questions = asked.groupBy(F.pmod(F.xxhash64("query_id", "query"), F.lit(n_blocks)).alias("b")).agg(F.collect_list(F.struct("query_id", "query")).alias("__asked"))
    kind = asked.select(F.array(F.struct("query_id", "query"))).schema.fields[0].dataType
    vectors_ = kept.select(group.alias("__group"), F.lit(0).alias("__side"), *ties, "__vector", F.lit(None).cast(kind).alias("__asked"))
    blank = [F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in [*ties, "__vector"]]
    sent = rows_of_questions.select(F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("__group"), F.lit(1).alias("__side"), *blank, "__asked")
    dealt = vectors_.unionByName(sent).repartition(n_groups, "__group").sortWithinPartitions("__group", "__side")
    fields = kept.select(F.lit(0).cast("long").alias("query_id"), *ties, F.lit(0.0).alias("score")).schema

    def best(held: pa.Table, matrix: np.ndarray, lengths: np.ndarray, place: np.ndarray, cell: pa.Scalar) -> pa.RecordBatch:
        names = np.array([q["query_id"] for q in cell.as_py()], np.int64)
        part = np.array([q["query"] for q in cell.as_py()], np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = (part @ matrix.T) / np.outer(np.sqrt((part * part).sum(axis=1)), lengths)
        scores = np.where(np.isfinite(scores), scores, -2.0)
        most, picked = min(k, len(matrix)), []
        for mine in scores:
            near = np.flatnonzero(mine >= np.partition(mine, -most)[-most])  # all that tie with the k-th: ties decide
            picked.append(near[np.lexsort((place[near], -mine[near]))[:most]])
        at = np.concatenate(picked)
        value = scores[np.repeat(np.arange(len(names)), most), at]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, most)), *[held.column(c).take(pa.array(at)).combine_chunks() for c in ties], pa.array(value)], ["query_id", *ties, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, ready = None, [], None
        for b in batches:
            groups, sides = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((groups[1:] != groups[:-1]) | (sides[1:] != sides[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                if groups[lo] != number:
                    number, parts, ready = groups[lo], [], None
                if sides[lo] == 0:
                    parts.append(b.slice(lo, hi - lo))
                    continue
                if not parts:
                    continue  # a group without vectors
                if ready is None:
                    held = pa.Table.from_batches(parts).select([*ties, "__vector"])
                    matrix = held.column("__vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)
                    place = np.empty(held.num_rows, np.int64)
                    place[pc.sort_indices(held.select(ties), [(c, "ascending") for c in ties], null_placement="at_start").to_numpy()] = np.arange(held.num_rows)
                    ready = held.select(ties), matrix, np.sqrt((matrix * matrix).sum(axis=1)), place
                for row in range(lo, hi):
                    yield best(*ready, b.column(2 + n_ties + 1)[row])

    found = bounded(dealt).mapInArrow(run, fields).withColumn("score", F.when(F.col("score") >= -1.5, F.col("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), *ties)) - 1
    return found.withColumn("rank", rank).where(F.col("rank") < k)
