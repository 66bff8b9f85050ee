"""Long documents and ordinary checkouts: work in proportion to the input, contents read once and for wanted files only."""

import re
import time

import pytest
from pyspark.sql import functions as F

from lodeseek import schema
from lodeseek.config import IndexingConfig, SearchQuery
from lodeseek.functions import text as t
from lodeseek.operators import chunk, embed, grep, index, knn, preview
from lodeseek.plans import search
from lodeseek.sources import catalog, extract, files


def one(spark, text):
    return spark.createDataFrame([("f.txt", text)], "path string, text string")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000])
def test_running_sums(spark, n):
    df = spark.createDataFrame([(list(range(n)),)], "x array<long>")
    assert df.select(t.running_sums(F.col("x"))).first()[0] == [sum(range(k)) for k in range(n)]


def test_many_hits_in_lines(spark):
    """10 MB with 100,000 lines that match."""
    lines = [f"line {k} é with an error in it " + "x" * 70 for k in range(100_000)]
    began = time.time()
    found = grep.grep_lines(one(spark, "\n".join(lines)), SearchQuery("error"), keep=["path"]).select("line", "col", "start", "end", F.length("context_before").alias("before"), F.length("context_after").alias("after"))
    rows = {r.line: r for r in found.collect()}
    assert time.time() - began < 60 and len(rows) == 100_000
    at = 0
    for k, line in enumerate(lines[:500]):
        r, col = rows[k + 1], len(line[: line.index("error")].encode())
        assert (r.col, r.start, r.end, r.before, r.after) == (col, at + col, at + col + 5, line.index("error"), len(line) - line.index("error") - 5)
        at += len(line.encode()) + 1


def test_many_hits_in_one_text(spark):
    """A text of 10 MB with 20,000 matches, as of a document with pages."""
    text = "".join(f"w{k} some words behind it and a key\n" + "y" * 480 for k in range(20_000))
    began = time.time()
    found = grep.grep_whole(one(spark, text), SearchQuery("a key"), keep=["path"]).orderBy("start").collect()
    assert time.time() - began < 60 and len(found) == 20_000
    for r, m in list(zip(found, re.finditer("a key", text), strict=True))[:3] + list(zip(found, re.finditer("a key", text), strict=True))[-3:]:
        assert (r.start, r.end) == m.span()
        assert r.context_before == text[max(0, m.start() - 120) : m.start()].lstrip().replace("\n", " ")
        assert r.context_after == text[m.end() : m.end() + 120].rstrip().replace("\n", " ")


def test_many_matches_in_one_line(spark):
    line = '{"key": 1}, ' * 20_000
    found = grep.grep_lines(one(spark, line), SearchQuery("key"), keep=["path"])
    assert found.agg(F.count("*"), F.max("col")).first() == (20_000, 12 * 19_999 + 2)
    assert grep.count_lines(one(spark, line + "\nkey"), SearchQuery("key"), keep=["path"]).first() == ("f.txt", 20_001)


def test_chunks_of_a_long_text(spark):
    """4 MB: ranges and lines of all windows, with other sizes too."""
    text = "".join(f"é line {k} of text\n" for k in range(200_000))
    began = time.time()
    rows = chunk.fixed_windows(one(spark, text), keep=["path"]).orderBy("chunk_idx").collect()
    assert time.time() - began < 60 and len(rows) == (len(text) - 128 - 1) // 472 + 1
    for r in rows[:: len(rows) // 7]:
        head = text[: r.chunk_idx * 472]
        assert (r.byte_start, r.line, r.chunk_text) == (len(head.encode()), head.count("\n") + 1, text[len(head) : len(head) + 600].strip())
    for size, overlap in ((10, 9), (10, 0), (7, 3), (5, 4), (600, 128)):
        config = IndexingConfig(chunk_size=size, chunk_overlap=overlap)
        for n in (1, 4, 5, 6, 7, 9, 10, 11, 20, 23):
            short = "".join(chr(97 + k % 26) for k in range(n))
            got = [(r.byte_start, r.byte_end, r.chunk_text) for r in chunk.fixed_windows(one(spark, short), config, keep=["path"]).orderBy("chunk_idx").collect()]
            starts = range(0, max(n - overlap, 1), size - overlap)
            assert got == [(a, min(a + size, n), short[a : a + size]) for a in starts]


@pytest.fixture
def checkout(tmp_path):
    root = tmp_path / "repo"
    made = {"a.txt": b"hello", ".git/objects/pack/big.pack": b"\0" * (70 << 20), ".git/config": b"hello", ".git/notes.txt": b"hello", ".github/workflows/.x/ci.md": b"hello", "node/.cache/in.txt": b"hello", "_skip.md": b"hello", ".gitignore": b"build/\n" + b"# long\n" * 200_000 + b"*.csv\n", "build/o.txt": b"hello", "b c%20é.txt": b"hello", "t.csv": b"hello"}
    for name, content in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def test_checkout_with_large_hidden_files(spark, checkout):
    """A .git over 64 MiB, hidden files in hidden folders, an ignore file over 1 MiB, names with spaces and signs."""
    matches, errors = search.search_folder(spark, SearchQuery("hello", root=checkout, max_results=50))
    assert sorted(r.path.removeprefix("file:").removeprefix(checkout + "/") for r in matches.collect()) == [".git/notes.txt", ".github/workflows/.x/ci.md", "_skip.md", "a.txt", "b c%20é.txt", "node/.cache/in.txt"]
    assert errors.count() == 0
    shown = files.scan(spark, checkout, files.LISTING).collect()
    assert {r.relative for r in shown} == {"a.txt", "_skip.md", "b c%20é.txt"}


def test_contents_of_wanted_files_only(spark, checkout):
    """Types and ignore rules prune the names, which are listed in tasks, before contents, which tasks read: nothing else reads files."""
    found = files.scan(spark, checkout)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "binaryFile" not in plan and "MapInPandas" not in plan
    named = {r.relative: r.size_bytes for r in files.names(spark, checkout).collect()}
    assert set(named) == {"a.txt", ".git/notes.txt", ".github/workflows/.x/ci.md", "node/.cache/in.txt", "_skip.md", "b c%20é.txt"} and set(named.values()) == {5}
    assert files.scan(spark, checkout).agg(F.sum(F.length("content"))).first()[0] == 5 * found.count()


def test_extraction_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    (tmp_path / "docs").mkdir()
    for k in range(3):
        (tmp_path / "docs" / f"{k}.pdf").write_bytes(b"one hello two")

    def read(content):
        import uuid

        (calls / uuid.uuid4().hex).write_text("x")
        return extract.Extracted(content.decode())

    matches, _ = search.search_folder(spark, SearchQuery("hello", root=str(tmp_path / "docs"), max_results=2), extract.Registry(extract.Extractor("x", ("pdf",), read)))
    assert matches.count() == 2 and matches.select("path").distinct().count() == 2
    assert len(list(calls.iterdir())) == 3


def test_words_of_many_documents_in_one_batch(spark):
    """Segments go out as they are made: a batch of 60 documents with 5000 words each held them all, over 300 MB."""

    def titled(content):
        words = content.decode().split()
        got = extract.words_to_text([[[(w, 1.0, 2.0, 3.0, 4.0) for w in words]]])
        got.title = open("/proc/self/statm").read().split()[1]  # resident pages of this worker
        return got

    docs = spark.range(60, numPartitions=1).select(F.concat(F.lit("d"), "id", F.lit(".pdf")).alias("path"), F.lit("Pdf").alias("file_type"), F.repeat(F.lit("word "), 5000).cast("binary").alias("content"))
    docs = docs.withColumn("content", F.when(F.col("path") != "d7.pdf", F.col("content")))
    found = extract.extracted_documents(docs, extract.Registry(extract.Extractor("x", ("pdf",), titled))).select("path", "title", "error", F.size("source_map").alias("n"), F.col("source_map")[4999].alias("last"), "page_count").collect()
    assert len(found) == 60 and [r.path for r in found if r.error] == ["d7.pdf"]
    good = [r for r in found if not r.error]
    assert {(r.n, r.last.start, r.last.end, r.last.origin.page, r.last.origin.bbox.height, r.last.origin.line, r.page_count) for r in good} == {(5000, 24995, 24999, 1, 4.0, None, 1)}
    assert (max(int(r.title) for r in good) - min(int(r.title) for r in good)) * 4096 < 150e6


def test_chunks_of_a_batch_go_out_as_they_are_made(spark, monkeypatch):
    """What a worker holds as objects is in proportion to a slice, not to its batch: 40 texts of 100 kB came out as one batch of chunks."""
    import pyarrow as pa

    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    taken, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a, **b: taken.append(run) or real(self, run, *a, **b))
    chunk.semantic_chunks(docs, keep=["doc_id"])
    texts = ["some words é " * 7700, None, "", *["some words é " * 7700] * 39, "y" * 3_000_000]
    out = list(taken[0](iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])])))
    assert [k for b in out for k in b.column(0).to_pylist()] == list(range(len(texts)))
    assert len(out) == 6 and all(b.num_rows == 1 or b.column(1).nbytes < 2 << 20 for b in out)
    assert [[c["text"] for c in x or []] for b in out for x in b.column(1).to_pylist()][:3] == [[texts[0][a:z].strip() for a, z in chunk.split_semantic(texts[0], 600, 128)], [], []]


def test_zero_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert [(r.id, r.score) for r in knn.top_k(df, [1.0, 0.0], 0, ["id"]).collect()] == [(2, 1.0), (3, 0.0), (1, None)]
    assert [r.score for r in knn.top_k(df, [0.0, 0.0], 2, ["id"]).collect()] == [None, None]
    from lodeseek.functions import vectors

    assert [r[0] for r in df.select(vectors.normalized(F.col("embedding"))).collect()] == [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id long, query array<double>")
    got = sorted(map(tuple, knn.top_k_each(df.repartition(3), asked, 2, ["id"]).collect()))
    assert got == [(7, 2, 1.0, 0), (7, 3, 0.0, 1), (8, 1, None, 0), (8, 2, None, 1)]


def test_hits_by_file_in_rank_order(spark):
    hits = spark.createDataFrame([("b", 0, 0.5), ("a", 1, 0.9), ("b", 1, 0.95), ("c", 0, None), ("a", 0, 0.1)], "path string, chunk_idx int, score double")
    got = search.by_file(hits).collect()
    assert [(r["rank"], r.path, r.best_score, r.n) for r in got] == [(0, "b", 0.95, 2), (1, "a", 0.9, 2), (2, "c", None, 1)]
    assert [(m.chunk_idx, m.score) for m in got[0].matches] == [(1, 0.95), (0, 0.5)]


def test_index_of_a_folder(spark, checkout, tmp_path):
    path = f"file://{tmp_path}/index"
    made = search.build_index(spark, checkout, path, embed.HashingEmbedder(16))
    assert made["failed_files"] == 0 and made["errors"] == {} and made["build_duration_ms"] > 0
    found = {r.file_path for r in index.open_index(spark, path).chunks.collect()}
    assert found == {"a.txt", ".git/notes.txt", ".github/workflows/.x/ci.md", "node/.cache/in.txt", "_skip.md", "b c%20é.txt"}
    for bad in (None, " ", checkout + "/none", checkout + "/a.txt"):
        with pytest.raises(search.SearchError):
            search.build_index(spark, bad, path, embed.HashingEmbedder(16))
    with pytest.raises(search.state.NotReady):
        search.search_index(spark, SearchQuery("x"), path, None)
    with pytest.raises(search.state.NotReady):
        search.search_index(spark, SearchQuery("x"), path, embed.HashingEmbedder(16), building=True)


def test_change_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    texts = [(f"/r/{k}.txt", "PlainText", f"text number {k}", None, None) for k in range(60)]
    docs = spark.createDataFrame(texts, f"path string, file_type string, text string, source_map array<{schema.SEGMENT}>, error string")
    before = index.build(spark, path, docs, embed.HashingEmbedder(8), "/r", bucket_rows=5)
    reader = index.open_index(spark, path)
    after = index.remove_file(spark, path, "7.txt")
    moved = {b for b in before["parts"] if after["parts"].get(b) != before["parts"][b]}
    assert before["buckets"] == 12 and len(moved) == 1
    assert index.open_index(spark, path).chunks.count() == 59
    for k in range(8, 14):
        index.remove_file(spark, path, f"{k}.txt")
    assert {r.file_path for r in index.open_index(spark, path).chunks.collect()} == {f"{k}.txt" for k in range(60) if not 7 <= k <= 13}
    rebuilt = f"file://{tmp_path}/again"
    index.build(spark, rebuilt, docs, embed.HashingEmbedder(8), "/r", bucket_rows=5)
    reader = index.open_index(spark, rebuilt)
    index.build(spark, rebuilt, docs.limit(3), embed.HashingEmbedder(8), "/r", bucket_rows=5)
    assert reader.chunks.count() == 60 and index.open_index(spark, rebuilt).chunks.count() == 3

    class Broken(embed.HashingEmbedder):
        def embed(self, texts):
            raise embed.FatalEmbedError("gone")

    with pytest.raises(Exception, match="gone"):
        index.build(spark, rebuilt, docs, Broken(8), "/r")
    assert not [n for n in index.Folder(spark, rebuilt).names() if n.startswith("staging")]


def test_confinement_follows_links(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    root.mkdir()
    outside.mkdir()
    (outside / "secret.txt").write_text("s")
    (root / "in.txt").write_text("inside")
    (root / "x.exe").write_text("x")
    (root / "d.pdf").write_text("p")
    (root / "link").symlink_to(outside)
    assert files.confined(spark, f"{root}/in.txt", str(root)) and files.confined(spark, f"{root}/new/file.txt", str(root))
    assert not files.confined(spark, f"{root}/link/secret.txt", str(root)) and not files.confined(spark, f"{root}/../outside/secret.txt", str(root))
    shown = preview.open_file(spark, f"{root}/in.txt", str(root)).first()
    assert (shown.kind, shown.content, shown.highlight_line, shown.error) == ("Text", "inside", 0, None)
    assert preview.open_file(spark, f"{root}/d.pdf", str(root)).first().page == 1
    with pytest.raises(PermissionError):
        preview.open_file(spark, f"{root}/link/secret.txt", str(root))
    with pytest.raises(ValueError, match="unsupported"):
        preview.open_file(spark, f"{root}/x.exe", str(root))


def test_engines_and_pooling(spark):
    engines = embed.Engines()
    assert engines.load({"engine": "Fastembed", "model": "m", "dimension": 12}).dimension == 12
    with pytest.raises(LookupError):
        engines.load({"engine": "SBERT", "model": "m", "dimension": 12})
    engines.register("SBERT", lambda model, dimension, device: embed.HashingEmbedder(3, model))
    with pytest.raises(ValueError, match="dimension"):
        engines.load({"engine": "SBERT", "model": "m", "dimension": 12})
    asked = ['{"pooling_mode_cls_token": true}', '{"pooling_mode_max_tokens": true}', '{"pooling_mode_mean_tokens": true}', "[1]", "not json", None, '{"pooling_mode_cls_token": "yes"}']
    assert [embed.pooling(x) for x in asked] == ["cls", "max", "mean", "mean", "mean", "mean", "mean"]
    from lodeseek.functions import vectors

    tokens, mask = F.array(*[F.array(*map(F.lit, v)) for v in ([1.0, 9.0], [3.0, 5.0], [8.0, 8.0])]), F.array(F.lit(1), F.lit(1), F.lit(0))
    row = spark.range(1).select(*[vectors.pooled(tokens, mask, how).alias(how) for how in ("cls", "max", "mean")]).first()
    assert (row.cls, row["max"], row["mean"]) == ([1.0, 9.0], [3.0, 9.0], [2.0, 7.0])
    listed = catalog.models(spark, "Fastembed", ("B",), [("A", "one", 3), ("B", "quantized", 4), ("AllMiniLML6V2", "x", 384)]).collect()
    assert [(r.model_id, r.is_cached, r.is_recommended, r.preferred_batch_size) for r in listed] == [("AllMiniLML6V2", False, True, 32), ("B", True, False, None), ("A", False, False, 32)]


def test_pages_preview(spark):
    box = F.struct(F.lit(1.0).alias("x"))
    assert spark.range(1).select(preview.of_pages(F.lit(3), box).alias("p")).first().p == ("Pdf", 3, (1.0,))


def test_stream_of_files(spark):
    docs = spark.createDataFrame([("b.txt", "x y x"), ("a.txt", "x"), ("c.txt", "none")], "path string, text string")
    got = list(search.stream_files(grep.grep_lines(docs, SearchQuery("x"), keep=["path"])))
    assert [(r.path, r.n_matches, [m.start for m in r.matches]) for r in got] == [("a.txt", 1, [0]), ("b.txt", 2, [0, 4])]


def test_embedders_with_their_own_calls(spark):
    class Own(embed.HashingEmbedder):
        def embed_passages(self, texts):
            return [[float(len(t)), 0.0] for t in texts]

        def embed_queries(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    rows = embed.embed_passages(spark.createDataFrame([("abc",)], "chunk_text string"), Own(2, passage_prefix="p: ")).collect()
    assert [r.embedding for r in rows] == [[3.0, 0.0]] and embed.embed_query(Own(2, query_prefix="q: "), "four") == [4.0, 1.0]
