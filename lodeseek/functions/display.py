"""Values as a result list shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import name_of
from .text import clean


def size_label(size: Column) -> Column:
    """B below 1024, then KB and MB with one decimal."""
    label = lambda unit, name: F.format_string(f"%.1f {name}", size.cast("double") / F.lit(float(unit)))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, label(1 << 10, "KB")).otherwise(label(1 << 20, "MB"))


def origin_label(origin_type: Column, line: Column, page: Column) -> Column:
    return F.when(origin_type == "TextFile", F.concat(F.lit("L"), line.cast("string"))).when(origin_type == "PdfPage", F.concat(F.lit("p."), page.cast("string"))).otherwise("")


def month_label(month: Column) -> Column:
    """YYYY-MM as "Jan 2024"; months past 12 run on into later years, as calendars count."""
    year, number = (F.regexp_extract(month, r"^(\d{4})-(\d{2})$", k) for k in (1, 2))
    date = F.add_months(F.make_date(year.try_cast("int"), F.lit(1), F.lit(1)), number.try_cast("int") - 1)
    return F.when(F.regexp_like(month, F.lit(r"^\d{4}-\d{2}$")), F.date_format(date, "MMM yyyy"))


def title_of(path: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(clean(title), F.lit("")), name_of(path))


#: Prefixes that a shown DOI goes without.
_DOI_PREFIXES = (r"^(?i)https?://(?:dx\.)?doi\.org/", r"^(?i)doi:\s*")


def bare_doi(doi: Column) -> Column:
    bare = clean(doi)
    for prefix in _DOI_PREFIXES:
        bare = F.regexp_replace(bare, prefix, "")
    return F.nullif(bare, F.lit(""))


def uri_component(text: Column) -> Column:
    """Percent-encoded, but for letters, digits and - _ . ! ~ * ' ( )."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in "!~'()":
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def doi_link(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), bare_doi(doi))


def scholar_link(doi: Column) -> Column:
    return F.concat(F.lit("https://scholar.google.com/scholar?q="), uri_component(bare_doi(doi)))


def display_name(model_code: Column) -> Column:
    return F.element_at(F.split(model_code, "/"), -1)


def engine_name(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin("sbert", "python"), "SBERT").when(low == "fastembed", "Fastembed").otherwise("Candle")
