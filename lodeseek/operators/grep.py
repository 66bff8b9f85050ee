"""Exact search: every match of a pattern, with byte offsets, origin and context.

Text is searched line by line and other formats as a whole. Built-in expressions do the work:
a text that cannot match is dropped by one look, matching lines are picked before anything is
exploded, and offsets are running sums over the pieces between matches. Patterns that can match nothing
go through an Arrow UDF, since pieces do not tell where empty matches lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchQuery
from ..functions import patterns, paths, source_map, text
from ..sources.work import bounded

_FOUND = "array<struct<start:bigint,end:bigint,matched_text:string,chars:int,before:string>>"
_WITH_CONTEXT = "array<struct<start:bigint,end:bigint,matched_text:string,before:string,after:string>>"
_NEAR = 120


def _matches(subject: Column, java: str, near: bool) -> Column:
    """Matches in subject: byte range, text, characters before it and, if near, what stands within _NEAR characters on both sides.

    One fold over the text between matches, so the work is in proportion to the text, however many matches it has.
    """
    hits = F.regexp_extract_all(subject, F.lit(java), F.lit(0))
    # The text between matches; one piece more than there are matches.
    pieces = F.split(subject, java, -1)

    def of(both: Column) -> Column:
        piece, hit = lambda k: F.get(both["pieces"], k), lambda k: F.get(both["hits"], k)
        numbers = F.when(F.size(both["hits"]) > 0, F.sequence(F.lit(0), F.size(both["hits"]) - 1)).otherwise(F.expr("cast(array() as array<int>)"))

        def forward(state: Column, k: Column) -> tuple[Column, Column]:
            chars, at = state["chars"] + F.length(piece(k)), state["bytes"] + F.octet_length(piece(k))
            end = at + F.octet_length(hit(k))
            before = F.right(F.concat(state["tail"], F.right(piece(k), F.lit(_NEAR))), F.lit(_NEAR)) if near else F.lit("")
            tail = F.right(F.concat(before, F.right(hit(k), F.lit(_NEAR))), F.lit(_NEAR)) if near else F.lit("")
            found = F.struct(at.alias("start"), end.alias("end"), hit(k).alias("matched_text"), chars.alias("chars"), before.alias("before"))
            return F.struct((chars + F.length(hit(k))).alias("chars"), end.alias("bytes"), tail.alias("tail")), found

        start = F.struct(F.lit(0).alias("chars"), F.lit(0).cast("long").alias("bytes"), F.lit("").alias("tail"))
        found = text.scan(numbers, start, forward, _FOUND)
        if not near:
            return found

        def backward(head: Column, k: Column) -> tuple[Column, Column]:
            after = F.left(F.concat(F.left(piece(k + 1), F.lit(_NEAR)), head), F.lit(_NEAR))
            return F.left(F.concat(F.left(hit(k), F.lit(_NEAR)), after), F.lit(_NEAR)), after

        behind = F.reverse(text.scan(F.reverse(numbers), F.lit(""), backward, "array<string>"))
        joined = lambda m, after: F.struct(*[m[c].alias(c) for c in ("start", "end", "matched_text", "before")], after.alias("after"))
        return F.zip_with(found, behind, joined)

    return text.let(F.struct(hits.alias("hits"), pieces.alias("pieces")), of)


def _empty_matches(docs: DataFrame, column: str, query: SearchQuery, near: int | None = None) -> DataFrame:
    """docs with found: as _matches, for patterns that can match nothing; with all that stands before and after, or `near` characters."""
    import regex

    patterns.compile_pattern(query.pattern, query.is_regex, query.case_sensitive)
    body = query.pattern if query.is_regex else regex.escape(query.pattern).replace("\\ ", r"\s+")
    flags = regex.UNICODE | (0 if query.case_sensitive else regex.IGNORECASE)
    compiled = regex.compile(regex.sub(r"(?<!\\)\$", r"\\Z", body), flags)
    at = docs.columns.index(column)

    def of(subject: str | None) -> list[dict]:
        out, last, at, size = [], -1, 0, 0
        for m in compiled.finditer(subject or ""):
            a, b = m.span()
            if a == b == last:  # an empty match right behind another match does not count
                continue
            last = b
            size, at = size + len(subject[at:a].encode()), a
            before, after = (subject[:a], subject[b:]) if near is None else (subject[max(0, a - near) : a], subject[b : b + near])
            out.append({"start": size, "end": size + len(m[0].encode()), "matched_text": m[0], "before": before, "after": after})
        return out

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("matched_text", pa.string()), ("before", pa.string()), ("after", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([of(x.as_py()) for x in b.column(at)], kind)], [*b.schema.names, "found"])

    return bounded(docs).mapInArrow(run, docs.select("*", F.expr(f"cast(array() as {_WITH_CONTEXT})").alias("found")).schema)


def _result(keep: list[str], line: Column, column: Column, page: Column, box: Column, before: Column, after: Column, base: Column, kind: str) -> list[Column]:
    return [
        *[F.col(f"`{c}`") for c in keep], F.lit(kind).alias("file_type"), line.cast("int").alias("line"), column.cast("int").alias("col"),
        page.cast("int").alias("page"), box.alias("bbox"), (base + F.col("m.start")).cast("long").alias("start"), (base + F.col("m.end")).cast("long").alias("end"),
        F.col("m.matched_text").alias("matched_text"), before.alias("context_before"), after.alias("context_after"),
    ]


_BOX = "struct<x:float,y:float,width:float,height:float>"


def _each(may_have_none: bool) -> Column:
    """Matches as rows. Where every row is known to have one, the outer form keeps the optimizer from adding a
    filter on the array's size, which would search every line a second time."""
    return F.explode("found") if may_have_none else F.explode_outer("found")


def _line_hits(java: str, empty: bool) -> Column:
    """Lines of text that match (all that there are, if a pattern may match nothing): number, line, base (byte of its start)."""

    def of(lines: Column) -> Column:
        sizes = F.transform(lines, lambda x: F.octet_length(x).cast("long") + 1)
        # A line end at the very end of a text begins no line.
        count = F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        hit = numbers if empty else F.filter(numbers, lambda k: F.regexp_like(F.get(lines, k), F.lit(java)))
        placed = lambda bases: F.transform(hit, lambda k: F.struct((k + 1).alias("number"), F.get(lines, k).alias("line"), F.get(bases, k).alias("base")))
        return text.let(text.running_sums(sizes), placed)

    return text.let(F.split("text", "\n"), of)


def _plain_docs(docs: DataFrame, java: str, empty: bool) -> DataFrame:
    return docs if empty or patterns.spans_lines(java) else docs.where(F.regexp_like("text", F.lit(java)))


def grep_lines(docs: DataFrame, query: SearchQuery, keep: list[str] | None = None) -> DataFrame:
    """Matches in documents of lines (column text). col is a byte offset in the line, contexts are the rest of the line."""
    java = patterns.compile_pattern(query.pattern, query.is_regex, query.case_sensitive)
    keep = [c for c in docs.columns if c not in ("text", "file_type")] if keep is None else keep
    empty = patterns.may_be_empty(java)
    rows = _plain_docs(docs, java, empty).select(*[F.col(f"`{c}`") for c in keep], F.explode(_line_hits(java, empty)).alias("at"))
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], "at.*")
    nothing = F.lit(None)
    if empty:
        flat = _empty_matches(rows.withColumnsRenamed({"line": "__line"}), "__line", query).withColumn("m", _each(True))
        before, after = F.col("m.before"), F.col("m.after")
    else:
        flat = rows.withColumn("found", _matches(F.col("line"), java, near=False)).withColumn("m", _each(False))
        # From the line itself, and only where they are asked for.
        before, after = F.left("line", F.col("m.chars")), F.substring(F.col("line"), F.col("m.chars") + F.length("m.matched_text") + 1, F.length("line"))
    return flat.select(*_result(keep, F.col("number"), F.col("m.start"), nothing, nothing.cast(_BOX), before, F.rtrim(after, F.lit("\r\n")), F.col("base"), paths.PLAIN_TEXT))


def count_lines(docs: DataFrame, query: SearchQuery, keep: list[str] | None = None) -> DataFrame:
    """Documents of lines with a match and n_matches, counted without making the matches."""
    java = patterns.compile_pattern(query.pattern, query.is_regex, query.case_sensitive)
    keep = [c for c in docs.columns if c not in ("text", "file_type")] if keep is None else keep
    if patterns.may_be_empty(java):
        return grep_lines(docs, query, keep).groupBy(*keep).agg(F.count("*").alias("n_matches"))
    of_lines = F.aggregate(F.split("text", "\n"), F.lit(0).cast("long"), lambda n, line: n + F.regexp_count(line, F.lit(java)))
    return _plain_docs(docs, java, False).select(*[F.col(f"`{c}`") for c in keep], of_lines.alias("n_matches")).where("n_matches > 0")


def grep_whole(docs: DataFrame, query: SearchQuery, keep: list[str] | None = None) -> DataFrame:
    """Matches in extracted documents, each searched as one text, with the page and box of their segments."""
    java = patterns.compile_pattern(query.pattern, query.is_regex, query.case_sensitive)
    keep = [c for c in docs.columns if c not in ("text", "file_type", "source_map")] if keep is None else keep
    empty = patterns.may_be_empty(java)
    mapped = ["source_map"] if "source_map" in docs.columns else []
    if empty:
        rows = _empty_matches(docs, "text", query, _NEAR)
    else:
        rows = docs.where(F.regexp_like("text", F.lit(java))).withColumn("found", _matches(F.col("text"), java, near=True))
    flat = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *mapped])], "found").withColumn("m", _each(empty))
    origin = source_map.resolve_range(F.col("source_map"), F.col("m.start"), F.col("m.end")) if mapped else None
    page = F.lit(1) if origin is None else F.coalesce(origin["page"], F.lit(1))
    box = F.lit(None).cast(_BOX) if origin is None else origin["bbox"]
    nothing = F.lit(None)
    return flat.select(*_result(keep, nothing, nothing, page, box, text.context_before(F.col("m.before")), text.context_after(F.col("m.after")), F.lit(0), paths.PDF))


def grep(docs: DataFrame, query: SearchQuery) -> DataFrame:
    """Matches in a corpus (path, text, size_bytes, maybe source_map): size, then type, then text."""
    if query.max_file_size > 0:
        docs = docs.where(F.col("size_bytes") <= query.max_file_size)
    docs = docs.withColumn("file_type", paths.file_type(F.col("path"), query.supported_extensions)).where("file_type is not null")
    lines = grep_lines(docs.where(F.col("file_type") == paths.PLAIN_TEXT), query, keep=["path"])
    found = lines.unionByName(grep_whole(docs.where(F.col("file_type") == paths.PDF), query, keep=["path"]))
    return soft_cap(found, query.max_results) if query.max_results > 0 else found


def soft_cap(matches: DataFrame, most: int) -> DataFrame:
    """Matches of files, in order of path, up to the one that reaches `most`; no file is cut.

    Counts of files are ordered, not matches.
    """
    kept = cap_files(matches.groupBy("path").agg(F.count("*").alias("n_matches")), most)
    return matches.join(kept.select("path"), "path", "left_semi")


def cap_files(counts: DataFrame, most: int) -> DataFrame:
    """Of files (path, n_matches), in order of path, those up to the one that reaches `most`.

    At most `most` files count, as each has a match, so the first `most` of them, which each task picks for itself, are enough.
    """
    first = counts.orderBy("path").limit(most)
    before = F.sum("n_matches").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).select("path", "n_matches")


def by_file(matches: DataFrame) -> DataFrame:
    """path, file_type, n_matches, matches in order of place."""
    columns = [c for c in matches.columns if c not in ("path", "file_type")]
    order = F.struct("start", "end", *[c for c in columns if c not in ("start", "end")])
    return matches.groupBy("path", "file_type").agg(F.count("*").alias("n_matches"), F.sort_array(F.collect_list(order)).alias("matches"))


def stats(matches: DataFrame, considered: DataFrame | None = None) -> DataFrame:
    """files_scanned (files with a match), total_matches and, of a corpus, files_considered. matches: rows of matches, or of files with n_matches."""
    if "n_matches" in matches.columns:
        out = matches.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("n_matches"), F.lit(0)).alias("total_matches"))
    else:
        out = matches.agg(F.countDistinct("path").alias("files_scanned"), F.count("*").alias("total_matches"))
    return out if considered is None else out.crossJoin(considered.agg(F.count("*").alias("files_considered")))
