"""Exact search on small texts and folders."""

import os

import pytest
from pyspark.sql import functions as F

from lodeseek.config import SearchQuery
from lodeseek.functions import patterns
from lodeseek.operators import grep, results
from lodeseek.plans import search
from lodeseek.sources import extract, files, ignore


def find(spark, text, query, whole=False):
    df = spark.createDataFrame([("f.txt", text)], "path string, text string")
    found = (grep.grep_whole if whole else grep.grep_lines)(df, query, keep=["path"])
    return found.orderBy("start", "end").collect()


def test_case(spark):
    assert len(find(spark, "Hello", SearchQuery("hello"))) == 1
    assert find(spark, "Hello", SearchQuery("hello", case_sensitive=True)) == []
    assert len(find(spark, "ÉTÉ", SearchQuery("été"))) == 1


def test_space_is_any_white_space(spark):
    assert len(find(spark, "hello   world\nhello\tworld", SearchQuery("hello world"))) == 2
    assert find(spark, "hello\nworld", SearchQuery("hello world")) == []
    assert len(find(spark, "hello\nworld", SearchQuery("hello world"), whole=True)) == 1


def test_lines_and_context(spark):
    (r,) = find(spark, "line 1\nmatch this\nline 3", SearchQuery("match"))
    assert (r.line, r.col, r.start, r.end) == (2, 0, 7, 12)
    (r,) = find(spark, "line 1\nline 2 (target)\r\nline 3", SearchQuery("target", context_lines=1))
    assert (r.context_before, r.context_after) == ("line 2 (", ")")
    assert [r.matched_text for r in find(spark, "user_123\nadmin_456\nguest", SearchQuery(r"\w+_\d+", is_regex=True))] == ["user_123", "admin_456"]


def test_whole_text_context(spark):
    (r,) = find(spark, "The quick brown fox jumps over the lazy dog", SearchQuery("fox"), whole=True)
    assert (r.context_before, r.context_after, r.page) == ("The quick brown ", " jumps over the lazy dog", 1)
    text = "é" * 200 + "\nfox\n" + "ü" * 200
    (r,) = find(spark, text, SearchQuery("fox"), whole=True)
    assert r.context_before == "é" * 119 + " " and r.context_after == " " + "ü" * 119


def test_offsets_slice_back(spark):
    text = "aé\U0001f600b xé\n\né b" * 5
    for r in find(spark, text, SearchQuery("[éb]", is_regex=True)):
        raw = text.encode()
        assert raw[r.start : r.end].decode() == r.matched_text
        line = raw.split(b"\n")[r.line - 1]
        assert line[r.col :].decode().startswith(r.matched_text) and line[: r.col].decode() == r.context_before


@pytest.mark.parametrize(("pattern", "text", "expected"), [("x*", "abxc", [(0, 0), (1, 1), (2, 3), (4, 4)]), ("^", "a\nb", [(0, 0), (2, 2)]), (r"b$", "ab\nb", [(1, 2), (3, 4)]), (r"\bb", "b ab", [(0, 1)])])
def test_anchors_and_empty_matches(spark, pattern, text, expected):
    assert [(r.start, r.end) for r in find(spark, text, SearchQuery(pattern, is_regex=True))] == expected


@pytest.mark.parametrize("pattern", [r"(a)\1", "(?=a)", "(?<!a)b", "a++", "(", "a{2}+", r"\k<x>", "(?>a)", "\\"])
def test_refused_patterns(pattern):
    with pytest.raises(patterns.PatternError):
        patterns.compile_pattern(pattern, is_regex=True)


def test_pattern_details(spark):
    assert len(find(spark, "a.b axb", SearchQuery("a.b"))) == 1
    assert len(find(spark, "a]b", SearchQuery("[]]", is_regex=True))) == 1
    assert len(find(spark, "ab12", SearchQuery(r"(?P<n>\d)", is_regex=True))) == 2
    assert not patterns.may_be_empty(patterns.compile_pattern("a+b", True)) and patterns.may_be_empty(patterns.compile_pattern("a*", True))


def test_soft_cap_keeps_whole_files(spark):
    rows = [(p, k, k + 1) for p, n in (("a", 3), ("b", 2), ("c", 4)) for k in range(n)]
    df = spark.createDataFrame(rows, "path string, start long, end long")
    assert {r.path for r in grep.soft_cap(df, 1).collect()} == {"a"}
    assert grep.soft_cap(df, 1).count() == 3
    assert {r.path for r in grep.soft_cap(df, 4).collect()} == {"a", "b"}


def test_collapse_and_navigation(spark):
    df = spark.createDataFrame([("a", k, k + 1) for k in range(7)] + [("b", 0, 1)], "path string, start long, end long")
    kinds = sorted((r.kind, r.path, r.total) for r in results.collapsed(df).where("kind <> 'match'").collect())
    assert kinds == [("expand", "a", 7), ("file", "a", 7), ("file", "b", 1)]
    assert results.collapsed(df).where("kind = 'match'").count() == 6
    assert [results.step(2, 3, 1), results.step(0, 3, -1), results.step(0, 0, 1)] == [0, 2, 0]


@pytest.fixture
def folder(tmp_path):
    made = {
        "a.txt": b"hello one\n", "sub/b.md": b"say hello\nHELLO\n", "big.txt": b"hello " * 50, "skip/c.txt": b"hello", ".hidden.txt": b"hello", "x.exe": b"hello",
        "bad.txt": b"\xffhello", "doc.pdf": b"one hello two", "broken.pdf": b"broken", ".gitignore": b"skip/\n*.log\n!keep.log\n", "y.log": b"hello", "keep.log": b"hello", "sub/Makefile": b"hello",
    }
    for name, content in made.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_bytes(content)
    return str(tmp_path)


def pdf_reader():
    def read(content):
        if content == b"broken":
            raise ValueError("not a document")
        words = content.decode().split()
        return extract.words_to_text([[[(w, 10.0 * k, 5.0, 8.0, 2.0) for k, w in enumerate(words)]]])

    return read


def names(rows, folder):
    return sorted(os.path.relpath(r.path.removeprefix("file:"), folder) for r in rows)


def test_folder_search(spark, folder):
    registry = extract.Registry(extract.Extractor("pdf", ("pdf",), pdf_reader()))
    matches, errors = search.search_folder(spark, SearchQuery("hello", root=folder, max_file_size=100), registry)
    assert names(matches.collect(), folder) == [".hidden.txt", "a.txt", "bad.txt", "doc.pdf", "keep.log", "sub/Makefile", "sub/b.md", "sub/b.md"]
    pdf = matches.where("page is not null").first()
    assert (pdf.page, pdf.bbox.x, pdf.bbox.width) == (1, 10.0, 8.0)
    assert [r.error.endswith("not a document") for r in errors.collect()] == [True]
    open_, errors = search.search_folder(spark, SearchQuery("hello", root=folder, respect_gitignore=False))
    assert {"skip/c.txt", "y.log", "big.txt"} <= set(names(open_.collect(), folder))
    assert sorted("no extractor" in r.error for r in errors.collect()) == [True, True]
    with pytest.raises(search.SearchError):
        search.search_folder(spark, SearchQuery("hello", root=" "))


def test_listing(spark, folder):
    found = files.scan(spark, folder, files.LISTING)
    listed = files.in_order(files.listing(found, 100)).collect()
    reasons = {os.path.basename(r.path): r.omit_reason for r in listed}
    assert reasons["x.exe"] == "UnsupportedExtension" and reasons["big.txt"] == "TooLarge" and reasons["a.txt"] is None
    assert ".hidden.txt" not in reasons and "y.log" not in reasons
    with pytest.raises(search.SearchError):
        search.validate_root(folder, found.where("false"))
    search.validate_root(folder, found)


def test_strict_and_head(spark):
    df = spark.createDataFrame([(bytearray(b"\xffabc"),), (bytearray("é".encode()),)], "content binary")
    rows = df.select(files.strict_text(F.col("content")).alias("s"), files.lossy_text(F.col("content")).alias("l"), files.head_text(F.col("content"), 1).alias("h")).collect()
    assert [r.s for r in rows] == [None, "é"] and rows[0].l == "�abc" and rows[1].h == "�"


@pytest.mark.parametrize(("rules", "path", "expected"), [("*.log", "a/b.log", True), ("/a", "a/x", True), ("/a", "b/a", False), ("a/", "a", False), ("a/", "x/a/y", True), ("**/t/*.c", "t/x.c", True), ("a/**", "a/b/c", True), ("*.c\n!k.c", "k.c", False), ("d/\n!d/k", "d/k", True), ("#x\n\\#y", "#y", True), ("x[0-9]", "x7", True), ("x?", "x/", False)])
def test_ignore_rules(spark, rules, path, expected):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(ignore.ignored(F.col("p"), ignore.parse(rules)).alias("x")).first().x is expected


def test_streaming_rows_and_cancel(spark):
    assert len(list(search.stream_rows(spark.range(5)))) == 5
    with search.cancellable(spark) as stop:
        assert not stop.is_set()
