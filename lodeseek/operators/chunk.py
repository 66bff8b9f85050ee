"""Chunks of texts, with byte ranges and origins.

fixed_windows cuts by characters alone and is built-in expressions throughout. semantic_chunks cuts at the
largest boundary that fits: line breaks (longer runs first), sentences, white space, words, characters as they are read; it runs in an Arrow UDF.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IndexingConfig
from ..functions import source_map
from ..functions import text
from ..functions.text import clean
from ..sources.work import bounded, slices

_CHUNK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("line", pa.int32()), ("text", pa.string())]))
_EMPTY = "cast(array() as array<struct<start:bigint,end:bigint,line:int,text:string>>)"


def fixed_windows(docs: DataFrame, config: IndexingConfig = IndexingConfig(), keep: list[str] | None = None) -> DataFrame:
    """chunk_idx, byte_start, byte_end, line, chunk_text of windows of chunk_size characters, chunk_overlap shared by neighbours.

    A text is cut once into steps of the characters that two starts are apart; bytes and lines before each are running sums.
    """
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    size, overlap = config.chunk_size, config.chunk_overlap
    step = size - overlap

    def windows(parts: Column) -> Column:
        sums = lambda of: text.running_sums(F.transform(parts, of))
        places = F.struct(
            sums(lambda p: F.octet_length(p).cast("long")).alias("bytes"), sums(lambda p: F.regexp_count(p, F.lit("\n")).cast("long")).alias("lines"),
            # The last window is the first that reaches the end.
            F.greatest(F.lit(1), F.size(parts) - F.when(F.length(F.element_at(parts, -1)) <= overlap % step, overlap // step + 1).otherwise(overlap // step)).alias("n"),
        )

        def window(p: Column, k: Column) -> Column:
            raw = F.left(F.array_join(F.slice(parts, k + 1, F.lit(1 + -(-overlap // step))), ""), F.lit(size))
            return F.struct(F.get(p["bytes"], k).alias("start"), F.octet_length(raw).cast("long").alias("size"), (F.get(p["lines"], k) + 1).cast("int").alias("line"), raw.alias("raw"))

        return text.let(places, lambda p: F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda k: window(p, k)))

    cut = text.let(F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), windows)
    rows = docs.where(F.length("text") > 0).select(*[F.col(f"`{c}`") for c in keep], F.posexplode(cut).alias("chunk_idx", "c"))
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], "chunk_idx", F.col("c.start").alias("byte_start"), (F.col("c.start") + F.col("c.size")).alias("byte_end"), F.col("c.line").alias("line"), clean(F.col("c.raw")).alias("chunk_text"))
    return rows.where("chunk_text <> ''")


_BREAKS = re.compile(r"(?:\r\n|\n|\r)+")
# Sentence ends by the rules of Unicode's text segmentation (UAX 29), over its property classes. Marks and format signs belong to what they follow.
_E = r"[\p{SB=EX}\p{SB=FO}]*+"
_PARAGRAPH = r"(?:\r\n|[\p{SB=SE}\p{SB=CR}\p{SB=LF}])"
_BEHIND = rf"(?:\p{{SB=CL}}{_E})*+(?:\p{{SB=SP}}{_E})*+"
_ENDS = r"(?![\p{SB=SC}\p{SB=AT}\p{SB=ST}])"
# A full stop ends none in front of a digit, between letters and a capital, or where small letters go on.
_STOP = rf"\p{{SB=AT}}{_E}(?!\p{{SB=NU}})(?:(?<![\p{{SB=UP}}\p{{SB=LO}}][\p{{SB=EX}}\p{{SB=FO}}]*\p{{SB=AT}}[\p{{SB=EX}}\p{{SB=FO}}]*)|(?!\p{{SB=UP}}))"
_GOES_ON = r"(?![^\p{SB=LE}\p{SB=UP}\p{SB=LO}\p{SB=SE}\p{SB=CR}\p{SB=LF}\p{SB=AT}\p{SB=ST}]*+\p{SB=LO})"
_SENTENCES = regex.compile(rf"{_PARAGRAPH}|\p{{SB=ST}}{_E}{_BEHIND}(?:{_PARAGRAPH}|{_ENDS})|{_STOP}{_BEHIND}(?:{_PARAGRAPH}|{_ENDS}{_GOES_ON})")
# White space; words where none is; characters as they are read, with all marks and joiners. No boundary lies before a mark, but behind a control.
_SPACES = re.compile(r"\s+")
_WORD_BOUNDS = regex.compile(r"(?w)\b")
_CLINGS = regex.compile(r"(?<![\p{GCB=CN}\r\n])[\p{GCB=EX}\p{GCB=ZWJ}\p{GCB=SM}]")
_CLUSTERS = regex.compile(r"\X")


class _Levels:
    """Boundaries of each level of a text, from the largest units to the smallest, each found when it is first asked for."""

    def __init__(self, text: str) -> None:
        breaks: dict[int, list[int]] = {}  # the end of a break belongs to what precedes it
        for m in _BREAKS.finditer(text):
            breaks.setdefault(len(m[0].replace("\r\n", "\n")), []).append(m.end())
        self.known: list[list[int]] = [sorted(p for n, ends in breaks.items() if n >= size for p in ends) for size in sorted(breaks, reverse=True)]
        plain = text.isascii()  # no marks
        ends = lambda pattern: lambda: [m.end() for m in pattern.finditer(text) if plain or not _CLINGS.match(text, m.end())]
        self.later = [ends(p) for p in (_SENTENCES, _SPACES, _WORD_BOUNDS, _CLUSTERS)]

    def __iter__(self) -> Iterator[list[int]]:
        at = 0
        while at < len(self.known) or self.later:
            if at == len(self.known):
                self.known.append(self.later.pop(0)())
            yield self.known[at]
            at += 1


def split_semantic(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) in characters: at most size long, covering the text, neighbours sharing at most overlap.

    None begins or ends within a character as it is read (a letter and its accents, signs that are joined), unless that is longer than size.
    """
    levels, out, start, total = _Levels(text), [], 0, len(text)

    def reach(at: int) -> int:
        """End of a chunk from at: the last boundary within size of the largest level that has one."""
        if total - at <= size:
            return total
        for bounds in levels:
            k = bisect_right(bounds, at + size) - 1
            if k >= 0 and bounds[k] > at:
                return bounds[k]
        return at + size

    while start < total:
        end = reach(start)
        out.append((start, end))
        following = end
        for bounds in levels:  # the overlap begins at the earliest large boundary within its reach
            k = bisect_left(bounds, max(end - overlap, start + 1))
            if k < len(bounds) and bounds[k] < end:
                following = bounds[k]
                break
        # A start from which the next chunk would not pass this one's end is none.
        start = following if end < total and reach(following) > end else end
    return out


def semantic_chunks(docs: DataFrame, config: IndexingConfig = IndexingConfig(), keep: list[str] | None = None) -> DataFrame:
    """chunk_idx, byte_start, byte_end, line, chunk_text; blank chunks are left out, texts are trimmed, ranges are not."""
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    at = docs.columns.index("text")

    def of(text: str | None) -> list[dict]:
        out, last, size, line = [], 0, 0, 1
        for a, b in split_semantic(text or "", config.chunk_size, config.chunk_overlap):
            between, sign = (text[last:a], 1) if a >= last else (text[a:last], -1)
            size, line = size + sign * len(between.encode()), line + sign * between.count("\n")
            last, part = a, text[a:b]
            if part.strip():
                out.append({"start": size, "end": size + len(part.encode()), "line": line, "text": part.strip()})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, at):
                kept = [part.column(part.schema.names.index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([of(t.as_py()) for t in part.column(at)], _CHUNK)], [*keep, "chunks"])

    chunked = bounded(docs).mapInArrow(run, docs.select(*keep, F.expr(_EMPTY).alias("chunks")).schema)
    rows = chunked.select(*keep, F.posexplode("chunks").alias("chunk_idx", "c"))
    return rows.select(*keep, "chunk_idx", F.col("c.start").alias("byte_start"), F.col("c.end").alias("byte_end"), F.col("c.line").alias("line"), F.col("c.text").alias("chunk_text"))


def chunk_origin(segments: Column, start: Column, end: Column, line: Column) -> Column:
    """Origin of a chunk: of its range; where it begins in a gap, of its first segment; else its line."""
    plain = F.struct(
        F.lit("TextFile").alias("origin_type"), line.cast("int").alias("line"), F.lit(0).alias("col"), F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("struct<x:float,y:float,width:float,height:float>").alias("bbox"),
    )
    return F.coalesce(source_map.resolve_range(segments, start, end), plain)
