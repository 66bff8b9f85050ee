"""Files to documents: plain text natively, other formats through registered extractors.

An extractor takes a file's bytes and gives text, segments and metadata; it runs in mapInArrow, so a
parser that only has a Python library plugs in. The first registered extractor that handles a path wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths
from .files import lossy_text, strict_text
from .work import bounded


@dataclass
class Extracted:
    """segments: (start, end, page, (x, y, width, height) or None) in bytes of text."""

    text: str
    segments: list[tuple[int, int, int, tuple[float, float, float, float] | None]] = field(default_factory=list)
    title: str | None = None
    page_count: int | None = None


@dataclass(frozen=True)
class Extractor:
    name: str
    extensions: tuple[str, ...]
    run: Callable[[bytes], Extracted]


class Registry:
    def __init__(self, *extractors: Extractor) -> None:
        self.extractors = list(extractors)

    def register(self, extractor: Extractor) -> None:
        self.extractors.append(extractor)

    def route(self, path: Column) -> Column:
        """Index of the first extractor that handles a path, or null."""
        out, ext = F.lit(None).cast("int"), F.lower(paths.extension_of(path))
        for k, e in reversed(list(enumerate(self.extractors))):
            out = F.when(ext.isin(*e.extensions), F.lit(k)).otherwise(out)
        return out


def words_to_text(pages: list[list[list[tuple[str, float, float, float, float]]]]) -> Extracted:
    """Text and segments of pages of lines of words (text, x, y, width, height): words end with a space, lines and pages with a line end."""
    text, size, segments = [], 0, []

    def add(part: str) -> None:
        nonlocal size
        text.append(part)
        size += len(part.encode())

    for number, lines in enumerate(pages, 1):
        for line in lines:
            for k, (word, *box) in enumerate(line):
                if k:
                    add(" ")
                start = size
                add(word)
                segments.append((start, size, number, tuple(box)))
            add("\n")
        if text and not text[-1].endswith("\n"):
            add("\n")
    return Extracted("".join(text), segments, None, len(pages))


def plain_documents(files: DataFrame, strict: bool = False) -> DataFrame:
    """Documents of plain text files, in built-in expressions. strict refuses invalid UTF-8."""
    text = strict_text(F.col("content")) if strict else lossy_text(F.col("content"))
    return files.select(
        "path", "file_type", text.alias("text"), F.lit(None).cast(f"array<{schema.SEGMENT}>").alias("source_map"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("int").alias("page_count"), F.when(text.isNull(), F.concat("path", F.lit(": invalid UTF-8"))).alias("error"),
    )


def extracted_documents(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Documents of other files, through the extractors of registry. A file that cannot be read has a null text and an error."""
    registry = registry or Registry()
    routed = files.select("path", "file_type", registry.route(F.col("path")).alias("route"), "content")
    extractors = registry.extractors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Made()
        for batch in batches:
            for path, kind, route, content in zip(*batch.columns, strict=True):
                row: dict = {"path": path.as_py(), "file_type": kind.as_py()}
                try:
                    if not route.is_valid:
                        raise LookupError("no extractor registered")
                    got = extractors[route.as_py()].run(content.as_py())
                    row |= {"text": got.text, "title": got.title, "page_count": got.page_count}
                    row["source_map"] = _segments(got.segments)
                except Exception as error:  # a broken file must not end the scan; it is reported
                    row["error"] = f"{row['path']}: {error}"
                made.add(row)
                if made.full():
                    yield made.batch()
        if made.rows:
            yield made.batch()

    return bounded(routed).mapInArrow(run, schema.DOCUMENTS)


#: Segments and bytes of texts after which a batch of documents goes out: they take far more room here than the contents they come from.
MADE_SEGMENTS, MADE_BYTES = 1 << 16, 1 << 20
_BOX = pa.struct([(f, pa.float32()) for f in ("x", "y", "width", "height")])
_ORIGIN = pa.struct([("origin_type", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("page", pa.int32()), ("bbox", _BOX)])
_SEGMENT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("origin", _ORIGIN)])
_MADE = pa.schema([("path", pa.string()), ("file_type", pa.string()), ("text", pa.string()), ("source_map", pa.list_(_SEGMENT)), ("title", pa.string()), ("page_count", pa.int32()), ("error", pa.string())])


def _segments(found: list[tuple[int, int, int, tuple[float, float, float, float] | None]]) -> pa.StructArray:
    """The segments of a document as a column, without an object for each."""
    n = len(found)
    starts, ends, pages, boxes = zip(*found, strict=True) if found else ((), (), (), ())
    sides = zip(*(box or (None,) * 4 for box in boxes), strict=True) if found else ((),) * 4
    box = pa.StructArray.from_arrays([pa.array(side, pa.float32()) for side in sides], fields=list(_BOX), mask=pa.array([not b for b in boxes], pa.bool_()))
    nothing = pa.nulls(n, pa.int32())
    origin = pa.StructArray.from_arrays([pa.array(["PdfPage"] * n, pa.string()), nothing, nothing, pa.array(pages, pa.int32()), box], fields=list(_ORIGIN))
    return pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), origin], fields=list(_SEGMENT))


class _Made:
    """Documents that wait to go out as a batch."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.segments = self.bytes = 0

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.segments += len(row.get("source_map") or ())
        self.bytes += len(row.get("text") or "")

    def full(self) -> bool:
        return self.segments >= MADE_SEGMENTS or self.bytes >= MADE_BYTES

    def batch(self) -> pa.RecordBatch:
        maps = [row.get("source_map") for row in self.rows]
        offsets, at = [], 0
        for m in maps:
            offsets.append(None if m is None else at)
            at += 0 if m is None else len(m)
        parts = [m for m in maps if m is not None]
        flat = pa.concat_arrays(parts) if parts else pa.array([], _SEGMENT)
        columns = {f.name: pa.array([row.get(f.name) for row in self.rows], f.type) for f in _MADE if f.name != "source_map"}
        columns["source_map"] = pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), flat)
        self.rows, self.segments, self.bytes = [], 0, 0
        return pa.RecordBatch.from_arrays([columns[f.name] for f in _MADE], schema=pa.schema([pa.field(f.name, columns[f.name].type) for f in _MADE]))


def documents(files: DataFrame, registry: Registry | None = None, strict: bool = False) -> DataFrame:
    """path, file_type, text, source_map, title, page_count, error of files (path, file_type, content).

    A file that cannot be read has a null text and an error; others go on. strict refuses invalid UTF-8.
    """
    plain = plain_documents(files.where(F.col("file_type") == paths.PLAIN_TEXT), strict)
    return plain.unionByName(extracted_documents(files.where(F.col("file_type") != paths.PLAIN_TEXT), registry))
