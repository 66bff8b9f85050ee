"""Column functions and settings on the cases they are made for."""

import json

import pytest
from pyspark.sql import functions as F

from lodeseek import config
from lodeseek.functions import display, metadata, paths, source_map, text, vectors
from lodeseek.operators import chunk, preview
from lodeseek.sources import catalog


def value(spark, column, **columns):
    df = spark.range(1).select(*[(v if hasattr(v, "_jc") else F.lit(v)).alias(k) for k, v in columns.items()] or [F.lit(1)])
    return df.select(column.alias("v")).first().v


DOIS = ["10.1000/xyz123", "https://doi.org/10.1000/xyz123", "doi: 10.1000/xyz123", "(10.1000/xyz123)", "<https://dx.doi.org/10.1000/xyz123>.", "see DOI:10.1000/xyz123, and"]


@pytest.mark.parametrize("raw", DOIS)
def test_find_doi(spark, raw):
    assert value(spark, metadata.find_doi(F.col("t")), t=raw) == "10.1000/xyz123"


@pytest.mark.parametrize(("raw", "doi"), [(" doi:10.1000/x ", "10.1000/x"), ("http://dx.doi.org/10.1/a)", "10.1/a"), ("HTTPS://doi.org/10.1/a", None), ("(10.1/a", None), ("11.1/a", None), ("10.1", None), ("10.1/a(b)", "10.1/a(b"), ("", None)])
def test_normalize_doi(spark, raw, doi):
    assert value(spark, metadata.normalize_doi(F.col("t")), t=raw) == doi


def test_doi_precedence(spark):
    assert value(spark, metadata.first_doi([F.col("a"), F.col("b"), F.col("c")]), a="  ", b="none", c="10.1234/z") == "10.1234/z"


@pytest.mark.parametrize(("raw", "month"), [("D:20250407162857-03'00'", "2025-04"), ("free text", None), ("D:20250230000000+00'00'", None), ("D:20250407252857-03'00'", None), ("D:20250407162857-24'00'", None), ("D:20250407162857+23'59'", "2025-04")])
def test_pdf_month(spark, raw, month):
    assert value(spark, metadata.pdf_month(F.col("t")), t=raw) == month


def test_types(spark):
    kinds = {"a.TXT": "PlainText", "a.pdf": "Pdf", "Makefile": "PlainText", "x/DOCKERFILE": "PlainText", "makefile.rs": None, "a": None, ".txt": None, "a.b/c": None}
    for path, kind in kinds.items():
        assert value(spark, paths.file_type(F.col("p")), p=path) == kind
    assert value(spark, paths.file_type(F.col("p"), ("rs",)), p="a.rs") == "PlainText"


def test_paths(spark):
    cases = [(paths.sanitized, "../a\\./b//c", "a/b/c"), (paths.name_of, "a/b\\c.txt", "c.txt"), (paths.directory_of, "a/b\\c.txt", "a/b"), (paths.mime_type, "a.PDF", "application/octet-stream"), (paths.mime_type, "a.md", "text/plain"), (paths.language_hint, "A.RS", "rust"), (paths.language_hint, "a.zz", None)]
    for f, raw, expected in cases:
        assert value(spark, f(F.col("p")), p=raw) == expected
    assert value(spark, paths.relative(F.col("p"), "/r"), p="/r/a/b") == "a/b"
    assert value(spark, paths.relative(F.col("p"), "/r"), p="/rest/a") == "/rest/a"
    assert value(spark, paths.absolute(F.col("p"), "/r/"), p="a/b") == "/r/a/b"
    assert paths.is_under("/a/b/../b/c", "/a/b") and not paths.is_under("/a/bc", "/a/b")


def test_lines(spark):
    body = "line 1\nline 2\nline 3"
    for n, expected in ((1, (0, 6)), (2, (7, 13)), (3, (14, 20)), (4, (0, 0))):
        assert tuple(value(spark, text.line_range(F.col("t"), F.lit(n)), t=body)) == expected
    for byte, line in ((0, 1), (6, 1), (7, 2), (8, 2)):
        assert value(spark, text.line_of(F.col("t"), F.lit(byte)), t=body) == line
    assert [value(spark, text.compat_line_of(F.col("t"), F.lit(b)), t=body) for b in (0, 6, 7, 8)] == [1, 1, 1, 2]


def test_preview(spark):
    body = "é\U0001f600\nmatch"
    shown = value(spark, preview.highlight(F.col("t"), F.lit(7), F.lit(12), F.lit(0)), t=body)
    assert tuple(shown) == (2, 4, 9)
    none = F.lit(None).cast("long")
    assert tuple(value(spark, preview.highlight(F.col("t"), none, none, F.lit(0)), t=body)) == (0, 0, 0)
    assert tuple(value(spark, preview.highlight(F.col("t"), none, none, F.lit(2)), t=body)) == (2, 7, 12)
    assert value(spark, preview.opened(F.lit("Pdf"), F.lit("x"), F.lit("y"))).page == 1


SEGMENT = "struct('PdfPage' as origin_type, cast(null as int) as line, cast(null as int) as col, {p} as page, named_struct('x', float({x}), 'y', float(1), 'width', float(2), 'height', float(3)) as bbox)"


def segments(*rows):
    parts = [f"named_struct('start', bigint({a}), 'end', bigint({b}), 'origin', {SEGMENT.format(p=p, x=x)})" for a, b, p, x in rows]
    return F.expr(f"array({', '.join(parts)})")


def test_source_map(spark):
    m = segments((0, 5, 1, 0), (6, 9, 1, 4), (10, 14, 2, 9))
    at = lambda c: value(spark, c, m=m)
    assert at(source_map.resolve(F.col("m"), F.lit(7))).bbox.x == 4
    assert at(source_map.resolve(F.col("m"), F.lit(5))).page == 2
    both = at(source_map.resolve_range(F.col("m"), F.lit(3), F.lit(12)))
    assert (both.page, both.bbox.x, both.bbox.width) == (1, 0.0, 6.0)
    assert at(source_map.resolve_range(F.col("m"), F.lit(20), F.lit(22))).page == 2
    assert value(spark, source_map.resolve(F.col("m"), F.lit(1)), m=F.expr("slice(array(named_struct('start', bigint(0), 'end', bigint(1), 'origin', struct(1 as page))), 1, 0)")) is None


def test_display(spark):
    assert [value(spark, display.size_label(F.lit(n))) for n in (5, 1536, 5 << 20)] == ["5 B", "1.5 KB", "5.0 MB"]
    assert [value(spark, display.month_label(F.col("m")), m=m) for m in ("2024-02", "2024-13", "2024-2", "x")] == ["Feb 2024", "Jan 2025", None, None]
    assert value(spark, display.scholar_link(F.col("d")), d="doi: 10.1/a (b)+c~") == "https://scholar.google.com/scholar?q=10.1%2Fa%20(b)%2Bc~"
    assert value(spark, display.doi_link(F.col("d")), d="  ") is None
    assert value(spark, display.title_of(F.lit("a/b.txt"), F.lit("  "))) == "b.txt"
    assert [value(spark, display.engine_name(F.lit(n))) for n in ("python", "FastEmbed", "x")] == ["SBERT", "Fastembed", "Candle"]


def test_pooling(spark):
    tokens, mask = F.expr("array(array(1D,2D,3D),array(4D,5D,6D),array(9D,9D,9D))"), F.expr("array(1,1,0)")
    assert value(spark, vectors.pool_mean(tokens, mask)) == [2.5, 3.5, 4.5]
    assert value(spark, vectors.pool_max(F.expr("array(array(1D,10D,3D),array(4D,5D,6D),array(9D,90D,9D))"), mask)) == [4, 10, 6]
    assert value(spark, vectors.pool_cls(tokens)) == [1, 2, 3]
    assert value(spark, vectors.normalized(F.expr("array(3D,4D)"))) == [0.6, 0.8]


@pytest.mark.parametrize(("size", "overlap"), [(20, 5), (50, 0), (600, 128), (7, 6)])
def test_semantic_chunks(size, overlap):
    body = "First line here.\nSecond one is longer. It has two sentences!\n\nA paragraph; " + "word " * 60 + "x" * 90 + " é\U0001f600 end"
    spans = chunk.split_semantic(body, size, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(body)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert c <= b and b - c <= overlap and d > b and c > a
    assert all(0 < b - a <= size for a, b in spans)
    assert chunk.split_semantic("", size, overlap) == []


def test_chunk_rows(spark):
    body = "Fox one. Fox two.\n\nThird é fox runs over the lazy dog again and again."
    df = spark.createDataFrame([(1, body), (2, ""), (3, " \n "), (4, None)], "id long, text string")
    cfg = config.IndexingConfig(20, 5)
    for f in (chunk.semantic_chunks, chunk.fixed_windows):
        rows = f(df, cfg, keep=["id"]).collect()
        assert {r.id for r in rows} == {1}
        for r in rows:
            assert body.encode()[r.byte_start : r.byte_end].decode().strip() == r.chunk_text
    with pytest.raises(ValueError):
        config.IndexingConfig(5, 5)


def test_settings():
    s = config.load_settings(None)
    assert (s.max_file_size, s.max_results, s.semantic.chunk_size, s.semantic.worker_timeout_secs) == (10 << 20, 50, 600, 300)
    old = {"semantic": {"enabled": True, "engine": "SBERT", "model": "m", "dimension": 7, "custom_models": ["a/b", {"engine": "Candle", "model_id": "c"}]}}
    got = config.load_settings(json.dumps(old)).semantic
    assert got.selected == {"engine": "SBERT", "model": "m", "dimension": 7} and got.custom_models[0] == {"engine": "SBERT", "model_id": "a/b"}
    merged = json.loads(config.merge_settings(json.dumps({"max_results": 1, "extra": 2}), {"max_results": 9}))
    assert merged == {"max_results": 9, "extra": 2}
    assert got.device_for("Fastembed") == "cpu"
    assert config.remember_directory([str(k) for k in range(10)], "x") == [*map(str, range(1, 10)), "x"]


def test_catalogue(spark):
    rows = catalog.models(spark, "SBERT", cached=("thenlper/gte-small",)).collect()
    assert [r.model_id for r in rows][:2] == ["intfloat/e5-small-v2", "thenlper/gte-small"] and rows[0].is_default
    assert {r.preferred_batch_size for r in rows} == {32}
    assert value(spark, catalog.preferred_batch(F.lit("x-Q4"), F.lit(""))) is None
