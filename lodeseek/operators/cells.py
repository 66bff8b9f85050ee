"""Exact top-k that leaves out most of an index: vectors in cells, visited by bound.

Vectors of a version are written once more by cell, the nearest of some centroids, with keys and no texts. Of each cell its centroid's angle to its
farthest vector is known. By the triangle inequality of angles no vector of a cell is nearer to a query than the query's angle to the centroid
less that angle, so a cell whose bound is under the k-th best score so far has no hit. Cells are visited in order of bound: first the best few, then all that the
k-th best score of those doesn't rule out. Results are those of a scan, ties included.

Centroids come from a bounded sample (SAMPLE vectors, by hash of their keys); every vector gets a cell. Cells hold for the version they were made of; searches of
later versions scan until make() is called anew. Vectors of zeros have a cell of their own, the last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import bounded
from . import knn
from .store import Folder

#: Vectors of a cell, about, cells at most, vectors of the sample, and rounds of k-means over it.
CELL_ROWS, MOST, SAMPLE, ROUNDS = 4096, 4096, 20_000, 8
KEYS = ["file_path", "chunk_idx"]
#: Angles are of single-precision vectors: bounds are widened by this much.
SLACK = 1e-5
_NONE = -1
_ROWS = "file_path string, chunk_idx int, embedding array<float>"


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def centroids(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n centroids, or fewer, of unit vectors, by rounds of k-means from evenly spread ones."""
    sample = _unit(sample[(sample != 0).any(axis=1)].astype(np.float64))
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    found = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(rounds):
        nearest = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        moved = _unit(sums)
        found = np.where((moved != 0).any(axis=1, keepdims=True), moved, found)
    return np.unique(found, axis=0)


def make(spark: SparkSession, path: str, cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> dict:
    """Writes the cells of the current version, and their description beside it."""
    from . import index

    opened = index.open_index(spark, path)
    folder, number, dim = Folder(spark, path), int(opened.meta["number"]), int(opened.meta["dimension"])
    rows = opened.chunks.select(*KEYS, "embedding")
    chosen = rows.orderBy(F.xxhash64(*KEYS), *KEYS).limit(sample).select("embedding").toArrow()  # bounded
    flat = chosen.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    middles = centroids(flat.reshape(-1, dim), max(1, min(MOST, -(-int(opened.meta["total_chunks"]) // cell_rows))))
    at = rows.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(b.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
            cell, angle = np.full(b.num_rows, _NONE, np.int32), np.zeros(b.num_rows)
            real = (x != 0).any(axis=1)
            if len(middles) and real.any():
                near = x[real] @ middles.T
                cell[real] = near.argmax(axis=1)
                angle[real] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], [*b.schema.names, "cell", "angle"])

    dealt = bounded(rows).mapInArrow(run, rows.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("angle")).schema)
    place = f"cells-{number}"
    salt = F.pmod(F.xxhash64(*KEYS), F.lit(8))  # a crowded cell is some files
    dealt.repartition("cell", salt).write.mode("overwrite").partitionBy("cell").parquet(f"{folder.path}/{place}")
    written = spark.read.schema(f"{_ROWS}, angle double, cell int").parquet(f"{folder.path}/{place}")
    found = written.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()  # MOST rows
    made = [{"cell": r["cell"], "n": r["n"], "angle": r["angle"], "centroid": middles[r["cell"]].tolist() if r["cell"] != _NONE else None} for r in found]
    old = json.loads(folder.read("CELLS")) if folder.exists("CELLS") else None
    described = {"number": number, "place": place, "cells": made}
    folder.write("CELLS", json.dumps(described))
    if old and old["place"] != place:
        folder.delete(old["place"])
    return described


def of_version(spark: SparkSession, path: str, number: int) -> dict | None:
    """The description of a version's cells, if there are any."""
    folder = Folder(spark, path)
    found = json.loads(folder.read("CELLS")) if folder.exists("CELLS") else None
    return found if found and found["number"] == number else None


def _read(spark: SparkSession, path: str, described: dict, cells: list[dict]) -> DataFrame:
    if not cells:
        return spark.createDataFrame([], _ROWS)
    base = f"{path.rstrip('/')}/{described['place']}"
    return spark.read.schema(_ROWS).parquet(*[f"{base}/cell={c['cell']}" for c in cells])


def top_k(spark: SparkSession, path: str, described: dict, query: list[float], k: int) -> tuple[list, int]:
    """(the k nearest rows: file_path, chunk_idx, score, as knn.top_k has them; how many cells were read)."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    q = _unit(np.array([query], np.float64))[0]
    real = [c for c in described["cells"] if c["cell"] != _NONE]
    zero = [c for c in described["cells"] if c["cell"] == _NONE]
    if not q.any():  # no score rules a cell out
        return knn.top_k(_read(spark, path, described, real + zero), query, k, KEYS).collect(), len(real + zero)
    angles = np.arccos(np.clip(np.array([c["centroid"] for c in real]).reshape(len(real), len(q)) @ q, -1, 1))
    bounds = np.cos(np.maximum(angles - np.array([c["angle"] for c in real]), 0)) + SLACK
    order = np.argsort(-bounds, kind="stable")
    enough = int(np.searchsorted(np.cumsum([real[i]["n"] for i in order]), k)) + 1
    first = [real[i] for i in order[:enough]]
    hits = knn.top_k(_read(spark, path, described, first), query, k, KEYS).collect()
    least = hits[-1]["score"] if len(hits) == k else -2.0
    more = [real[i] for i in order[enough:] if bounds[i] >= least]
    if not more and len(hits) == k:
        return hits, len(first)
    more = more if len(hits) == k or sum(c["n"] for c in first + more) >= k else more + zero
    again = knn.top_k(_read(spark, path, described, more), query, k, KEYS).collect()
    both = sorted([*hits, *again], key=lambda r: (r["score"] is None, -(r["score"] or 0.0), r["file_path"], r["chunk_idx"]))
    return both[:k], len(first) + len(more)
