"""Metadata of documents: DOIs, dates, blank fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

#: Fixed value: a DOI, after an optional prefix.
DOI = r"(?i)\b(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
_CLOSERS = r"""[.,;:"')\]}>]+$"""


def _unwrapped(value: Column) -> Column:
    """Without closing punctuation at the end. That takes the second half of any brackets or quotes around too, so none stand in pairs."""
    return clean(F.regexp_replace(clean(value), _CLOSERS, ""))


def normalize_doi(value: Column) -> Column:
    """The bare DOI, or null. A prefix of the resolver counts in lower case only, "doi:" in any case."""
    bare = F.regexp_replace(clean(value), r"^https?://(dx\.)?doi\.org/", "")
    bare = _unwrapped(F.regexp_replace(bare, r"^(?i)doi:", ""))
    return F.when(F.startswith(bare, F.lit("10.")) & F.contains(bare, F.lit("/")), bare)


def find_doi(text: Column) -> Column:
    """The first DOI in a text, or null."""
    return F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(DOI), F.lit(1)), normalize_doi), lambda d: d.isNotNull()), F.lit(0))


def non_blank(value: Column) -> Column:
    return F.nullif(clean(value), F.lit(""))


def first_doi(fields: Iterable[Column]) -> Column:
    """Of fields in order of precedence."""
    return F.coalesce(*[find_doi(non_blank(f)) for f in fields])


def of_document(kind: Column, title: Column, author: Column, fields: Iterable[Column], created: Column, text: Column) -> Column:
    """title, author, doi and created_at of a document by its type.

    One with pages has them in its fields (the DOI in the first of `fields` that holds one, then in its text); plain text is read
    for a DOI; other types have nothing.
    """
    pages, plain = kind == "Pdf", kind == "PlainText"
    return F.struct(
        F.when(pages, non_blank(title)).alias("title"), F.when(pages, non_blank(author)).alias("author"),
        F.when(pages, first_doi([*fields, text])).when(plain, find_doi(text)).alias("doi"), F.when(pages, pdf_month(created)).alias("created_at"),
    )


def pdf_month(value: Column) -> Column:
    """YYYY-MM of "D:YYYYMMDDHHMMSS+HH'MM'", in its own offset; null if it is not a real date and offset."""
    pattern = r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})([+-])(\d{2})'(\d{2})'$"
    part = lambda k: F.regexp_extract(value, pattern, k)
    day = F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd"))
    offset = part(8).try_cast("int") * 60 + part(9).try_cast("int")
    clock = (part(4).try_cast("int") < 24) & (part(5).try_cast("int") < 60) & (part(6).try_cast("int") < 60)
    return F.when(day.isNotNull() & clock & (offset < 24 * 60), F.concat_ws("-", part(1), part(2)))
