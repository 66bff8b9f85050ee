"""A search end to end: exact or semantic, over a folder or a table."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import state
from ..config import GREP, IndexingConfig, SearchQuery, Settings
from ..functions import paths
from ..operators import cells, embed, grep, index, knn
from ..sources import extract, files, work


class SearchError(RuntimeError):
    pass


def resolved(query: SearchQuery, settings: Settings | None) -> SearchQuery:
    """The settings' extensions win over the query's."""
    from dataclasses import replace

    return query if settings is None else replace(query, supported_extensions=tuple(settings.supported_extensions))


def _lines(found: DataFrame, root: str) -> DataFrame:
    """path, text, byte_base, line_base of files of lines; large ones are several rows."""
    read = files.with_lines(found.where(F.col("file_type") == paths.PLAIN_TEXT), root, files.SPLIT_BYTES)
    return read.select("path", "file_type", files.lossy_text(F.col("content")).alias("text"), "byte_base", "line_base")


def _line_matches(plain: DataFrame, query: SearchQuery) -> DataFrame:
    """Matches in rows of _lines, with lines and bytes counted from the file's begin."""
    found = grep.grep_lines(plain, query, keep=["path", "byte_base", "line_base"])
    moved = found.withColumns({"line": (F.col("line") + F.col("line_base")).cast("int"), "start": F.col("start") + F.col("byte_base"), "end": F.col("end") + F.col("byte_base")})
    return moved.drop("byte_base", "line_base")


def _line_counts(plain: DataFrame, query: SearchQuery) -> DataFrame:
    return grep.count_lines(plain, query, keep=["path"]).groupBy("path").agg(F.sum("n_matches").alias("n_matches"))


def _documents(found: DataFrame, root: str, registry: extract.Registry | None) -> tuple[DataFrame, DataFrame]:
    """(documents of lines, read where they are searched; other documents, extracted once and written) of listed files."""
    plain = _lines(found, root)
    other = files.with_content(found.where(F.col("file_type") != paths.PLAIN_TEXT), root)
    return plain, work.written(extract.extracted_documents(other, registry), "extracted")


#: Files that a search with a cap looks through first; each further step takes GROWTH times as many.
FIRST_FILES, GROWTH = 256, 4


def _capped(found: DataFrame, root: str, query: SearchQuery, registry: extract.Registry | None) -> tuple[list[str], DataFrame, int]:
    """(paths that the cap lets through, the other documents looked at, how many files were looked at).

    Files are numbered in order of path. Steps go through them, each larger than all before it together, until the cap is
    reached; what comes later is neither read nor searched.
    """
    numbered = work.written(knn.numbered(found, [F.col("path")], "number"), "listing")
    total, lo, size, n_matches, kept, seen = numbered.count(), 0, FIRST_FILES, 0, [], []
    while lo < total and n_matches < query.max_results:
        plain, other = _documents(numbered.where((F.col("number") >= lo) & (F.col("number") < lo + size)).drop("number"), root, registry)
        seen.append(other)
        counts = _line_counts(plain, query).unionByName(grep.grep_whole(other.where("error is null"), query, keep=["path"]).groupBy("path").agg(F.count("*").alias("n_matches")))
        for row in sorted(grep.cap_files(counts, query.max_results - n_matches).collect()):  # max_results at most
            kept.append(row["path"])
            n_matches += row["n_matches"]
        lo, size = lo + size, size * GROWTH
    others = seen[0] if seen else extract.extracted_documents(files.with_content(found.limit(0), root), registry)
    for more in seen[1:]:
        others = others.unionByName(more)
    if n_matches >= query.max_results:  # what a walk in this order never comes to
        others = others.where(F.col("path") <= kept[-1])
    return kept, others, min(lo, total)


def search_folder(spark: SparkSession, query: SearchQuery, registry: extract.Registry | None = None, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, errors) of an exact search below query.root.

    Files of lines are searched where they are read. Other files are extracted once, before the search, and their texts written to
    the work folder. With a cap on results, files are counted in order of path until it is reached; then only
    the files that it lets through are read for matches, and errors of later files are none.
    """
    query = resolved(query, settings)
    if not query.root or not query.root.strip():
        raise SearchError("no folder to search")
    walk = files.Walk(ignore_files=query.respect_gitignore, max_size=query.max_file_size)
    found = files.names(spark, query.root, walk, query.supported_extensions)
    if query.max_results > 0:
        kept, other, _ = _capped(found, query.root, query, registry)
        plain = _lines(found.where(F.col("path").isin(kept)), query.root)
        pages = other.where("error is null").where(F.col("path").isin(kept))
    else:
        plain, other = _documents(found, query.root, registry)
        pages = other.where("error is null")
    errors = other.where("error is not null").select("path", "error")
    return _line_matches(plain, query).unionByName(grep.grep_whole(pages, query, keep=["path"])), errors


class Rebuilds:
    """Builds that go on behind searches, one for each index at a time; each runs under a tag of its own, so it can be stopped."""

    def __init__(self) -> None:
        self.running: dict[str, tuple[InheritableThread, str]] = {}
        self.failed: dict[str, BaseException] = {}
        self.lock = threading.Lock()

    def start(self, spark: SparkSession, path: str, build: Callable[[], object]) -> bool:
        """Whether a build began: none does while one for the same index goes on."""
        with self.lock:
            if self.goes_on(path):
                return False
            tag = f"rebuild-{uuid.uuid4().hex}"

            def run() -> None:
                spark.addTag(tag)
                try:
                    build()
                    self.failed.pop(path, None)
                except Exception as error:  # kept for whoever asks; the old index stays
                    self.failed[path] = error
                finally:
                    spark.removeTag(tag)

            thread = InheritableThread(target=run, daemon=True)
            self.running[path] = thread, tag
            thread.start()
            return True

    def goes_on(self, path: str) -> bool:
        return path in self.running and self.running[path][0].is_alive()

    def wait(self, path: str, seconds: float | None = None) -> None:
        """Waits for a build, and raises what it failed with."""
        if path in self.running:
            self.running[path][0].join(seconds)
        if path in self.failed:
            raise self.failed.pop(path)

    def stop(self, spark: SparkSession, path: str) -> None:
        if self.goes_on(path):
            spark.interruptTag(self.running[path][1])


REBUILDS = Rebuilds()


def search_index(
    spark: SparkSession, query: SearchQuery, path: str, embedder: embed.Embedder | None, settings: Settings | None = None, building: bool = False,
    rebuild: Callable[[], object] | None = None, rebuilds: Rebuilds = REBUILDS,
) -> DataFrame:
    """Matches of a semantic search, with rank; the query's folder and flags have no effect. Refused while a first index is being built.

    Where the index's version has cells (cells.make), those that can hold a hit are read, else all vectors.
    If the index is of another folder than the query's, rebuild (such as a call of build_index) begins behind the search, which answers from the
    old index; once the new one is published, searches find that.
    """
    query = resolved(query, settings)
    try:
        meta = index.read_meta(spark, path)
    except index.IndexError_:
        meta = None
    if building or embedder is None:
        state.before_semantic_search(query.root, meta, building, embedder is not None)
    opened = index.open_index(spark, path, embedder.model_id, embedder.dimension)
    if state.before_semantic_search(query.root, opened.meta, building, True) and rebuild:
        rebuilds.start(spark, path, rebuild)
    vector = embed.embed_query(embedder, query.pattern)
    knn.check_dimension(int(opened.meta["dimension"]), vector)
    keys = ["file_path", "chunk_idx"]
    hits, rows = knn.top_k(opened.chunks, vector, query.max_results, keys), opened.chunks
    if query.max_results > 0:
        described = cells.of_version(spark, path, int(opened.meta["number"]))
        found = cells.top_k(spark, path, described, vector, query.max_results)[0] if described else hits.collect()  # max_results at most
        hits, rows = spark.createDataFrame(found, hits.schema), opened.rows_of([r["file_path"] for r in found])
    full = knn.with_columns_of(hits, rows.drop("embedding"), keys)
    return knn.decoded(knn.supported(full, query.supported_extensions), opened.meta["root_path"]).orderBy(F.desc_nulls_last("score"), "path", "chunk_idx")


def by_file(hits: DataFrame, few: bool = True) -> DataFrame:
    """A semantic search's hits as one row a file, files and matches in rank order. few: the search had a limit."""
    return knn.by_file(hits, "path", ["path", "chunk_idx"], few=few)


def build_index(spark: SparkSession, root: str | None, path: str, embedder: embed.Embedder, registry: extract.Registry | None = None, config: IndexingConfig = IndexingConfig(), semantic: bool = True) -> dict:
    """An index of a folder: all files of searched types, ignore rules on, no limit of size. What cannot be read is among the errors.

    Run it within cancellable() to be able to stop it.
    """
    there, folder = files.exists(spark, root) if root and root.strip() else (False, False)
    validate_root(root, None, there, folder)
    listed = files.names(spark, root, files.BUILD, config.supported_extensions)
    validate_root(root, listed.select("path"))
    found = files.with_content(listed.drop("modified"), root)
    docs = extract.documents(found.select("path", "file_type", "size_bytes", "content"), registry, strict=True)
    plain_path = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return index.build(spark, path, docs.withColumn("path", plain_path(F.col("path"))), embedder, root, config, semantic)


def stream_rows(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time, so that a slow reader holds back the work."""
    return df.toLocalIterator(prefetchPartitions=False)


def stream_files(matches: DataFrame) -> Iterator[Row]:
    """One row a file (path, file_type, n_matches, matches in order of place), in order of path, as stream_rows gives them."""
    return stream_rows(grep.by_file(matches).orderBy("path"))


@contextmanager
def cancellable(spark: SparkSession) -> Iterator[threading.Event]:
    """Within it, jobs carry a tag; setting the event and leaving cancels them."""
    tag, stop = f"search-{uuid.uuid4().hex}", threading.Event()
    spark.addTag(tag)
    try:
        yield stop
    finally:
        if stop.is_set():
            spark.interruptTag(tag)
        spark.removeTag(tag)


def validate_root(root: str | None, listed: DataFrame | None, exists: bool = True, is_folder: bool = True) -> None:
    """Raises the first thing that is wrong with a folder to index."""
    if not root or not root.strip():
        raise SearchError("choose a folder first")
    if not exists:
        raise SearchError(f"the folder does not exist: {root}")
    if not is_folder:
        raise SearchError(f"not a folder: {root}")
    if listed is not None and listed.isEmpty():
        raise SearchError(f"no file to index in {root}")


def mode_of(query: SearchQuery) -> str:
    return "exact" if query.mode == GREP else "semantic"
