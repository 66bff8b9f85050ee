"""Index upkeep at the cost of the change, folders walked in tasks, capped searches, many questions, rebuilds behind searches."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from lodeseek import schema
from lodeseek.config import SEMANTIC, SearchQuery
from lodeseek.operators import embed, index, knn, layout
from lodeseek.operators.store import Folder
from lodeseek.plans import queries, search
from lodeseek.sources import files, walk

EMBEDDER = embed.HashingEmbedder(4)
META = {"engine": "Fastembed", "model_id": "hashing", "dimension": 4, "root_path": "/r"}


def rows(spark, texts):
    """Index rows of {file: [chunk texts]}."""
    flat = [(f, k, 0, len(t), "TextFile", None, 1, 0, None, None, None, None, t, [float(len(t) % 5 + 1), 1.0, 0.0, float(k % 3)]) for f, chunks in texts.items() for k, t in enumerate(chunks)]
    return spark.createDataFrame(flat, schema.INDEX)


def contents(spark, path):
    return sorted((r.file_path, r.chunk_idx, r.chunk_text) for r in index.open_index(spark, path).chunks.collect())


def expected(texts):
    return sorted((f, k, t) for f, chunks in texts.items() for k, t in enumerate(chunks))


def names(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "file_path string")


def stored(folder):
    return [os.path.join(d, f) for d, _, found in os.walk(folder) for f in found if f.endswith(".parquet")]


@pytest.mark.parametrize("buckets", [1, 2, 3, 5, 8, 13])
def test_a_bucket_more_splits_one_bucket(spark, buckets):
    paths = spark.range(3000).select(F.concat(F.lit("f"), "id").alias("p"))
    got = paths.select(layout.bucket_of(F.col("p"), buckets).alias("a"), layout.bucket_of(F.col("p"), buckets + 1).alias("b")).collect()
    assert {r.a for r in got} == set(range(buckets))
    moved = {(r.a, r.b) for r in got if r.a != r.b}
    assert moved == {(layout.split_from(buckets, buckets), buckets)}


def test_files_of_a_build(spark, tmp_path):
    path = f"{tmp_path}/index"
    many = rows(spark, {f"{k}.txt": ["a", "b"] for k in range(400)}).repartition(16)
    index.create(spark, path, many, META, bucket_rows=40)
    meta = index.open_index(spark, path).meta
    assert meta["buckets"] == 20 and len(stored(f"{path}/rows")) <= 2 * meta["buckets"]


def test_a_change_writes_what_changed(spark, tmp_path):
    path = f"{tmp_path}/index"
    texts = {f"{k}.txt": [f"text {k}", "more"] for k in range(300)}
    index.create(spark, path, rows(spark, texts), META, bucket_rows=60)
    before = {f: os.path.getmtime(f) for f in stored(path)}
    reader = index.open_index(spark, path)
    index.apply_changes(spark, path, rows(spark, {"7.txt": ["new"]}), names(spark, ["9.txt"]), names(spark, ["7.txt"]))
    after = stored(path)
    assert all(os.path.getmtime(f) == t for f, t in before.items() if f in after) and set(before) <= set(after)
    assert 1 <= len(set(after) - set(before)) <= 3  # the new row, and a tombstone in one or two buckets
    assert reader.chunks.count() == 600  # a reader of the old version is not disturbed
    texts["7.txt"] = ["new"]
    del texts["9.txt"]
    assert contents(spark, path) == expected(texts)
    status = index.status(spark, path)
    assert (status["indexed_files"], status["total_chunks"]) == (299, 597)


def test_many_buckets_are_written_and_listed_by_the_cores(spark, tmp_path):
    """A change of small rows in many buckets is not left to one task, and folders are not listed in a task each."""
    path = f"{tmp_path}/index"
    few, many = (layout._dealt(spark.range(1000).select(F.col("id").alias("bucket")), n, "bucket") for n in (1, 200))
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (1, 16)
    index.create(spark, path, rows(spark, {f"{k}.txt": ["a", "b"] for k in range(400)}), META, bucket_rows=20)
    index.apply_changes(spark, path, rows(spark, {f"{k}.txt": ["c"] for k in range(100)}), names(spark, []), names(spark, [f"{k}.txt" for k in range(100)]))
    meta = index.open_index(spark, path).meta
    assert contents(spark, path) == expected({f"{k}.txt": ["c"] if k < 100 else ["a", "b"] for k in range(400)}) and meta["total_chunks"] == 700
    folder = Folder(spark, path)
    assert all(p["bytes"] == folder.size(p["path"]) for e in meta["parts"].values() for p in [*e["parts"], *e["deleted"]])
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 16
    with pytest.raises(index.IndexError_, match="dimension of x.txt is not 4"):
        index.apply_changes(spark, path, rows(spark, {"x.txt": ["c"]}).withColumn("embedding", F.slice("embedding", 1, 3)), names(spark, []), names(spark, ["x.txt"]))


def test_an_index_grows_and_stays_right(spark, tmp_path):
    path, rng = f"{tmp_path}/index", random.Random(3)
    texts = {f"{k}.txt": [f"first {k}"] for k in range(12)}
    index.create(spark, path, rows(spark, texts), META, bucket_rows=8)
    first = index.open_index(spark, path).meta["buckets"]
    for step in range(9):
        new = {f"{rng.randrange(120)}.txt": [f"step {step} {j}" for j in range(rng.randint(1, 3))] for _ in range(10)}
        gone = [p for p in rng.sample(sorted(texts), 3) if p not in new]
        index.apply_changes(spark, path, rows(spark, new), names(spark, [*gone, "none.txt"]), names(spark, new))
        texts = {p: t for p, t in {**texts, **new}.items() if p not in gone}
        meta = index.open_index(spark, path).meta
        assert (meta["indexed_files"], meta["total_chunks"]) == (len(texts), sum(map(len, texts.values())))
    assert contents(spark, path) == expected(texts)
    assert meta["buckets"] >= meta["total_chunks"] / 8 > 2 * first
    assert max(len(e["parts"]) for e in meta["parts"].values()) <= layout.MOST_PARTS + 1
    assert all(sum(p["rows"] for p in e["parts"]) == e["rows"] + e["dead"] for e in meta["parts"].values())
    # What no kept version uses is gone: the files are those of the last few versions.
    used = {p["path"] for e in meta["parts"].values() for p in [*e["parts"], *e["deleted"]]}
    folders = {os.path.relpath(os.path.dirname(f), path) for f in stored(path)}
    assert used <= folders and len(folders) <= 3 * len(used) + 10


def test_rows_of_files_are_counted_once_without_tombstones(spark, tmp_path):
    path = f"{tmp_path}/index"
    index.create(spark, path, rows(spark, {"a.txt": ["x"]}), META)
    index.apply_changes(spark, path, rows(spark, {"a.txt": ["x", "y"]}), names(spark, []), names(spark, []))  # rows come beside the old ones
    assert index.status(spark, path)["indexed_files"] == 1 and index.status(spark, path)["total_chunks"] == 3


def test_small_parts():
    parts = lambda *sizes: [{"rows": n} for n in sizes]
    assert [p["rows"] for p in layout.small_parts(parts(1000, 1, 2, 3, 50))] == [1, 2, 3]
    assert [p["rows"] for p in layout.small_parts(parts(5, 6, 7))] == [5, 6, 7]


def test_an_empty_index_can_grow(spark, tmp_path):
    path = f"{tmp_path}/index"
    index.create(spark, path, rows(spark, {}), META)
    assert contents(spark, path) == [] and index.status(spark, path)["total_chunks"] == 0
    index.apply_changes(spark, path, rows(spark, {"a.txt": ["x"]}), names(spark, []), names(spark, ["a.txt"]))
    assert contents(spark, path) == [("a.txt", 0, "x")]


def test_rows_of_reads_few_buckets(spark, tmp_path):
    path = f"{tmp_path}/index"
    index.create(spark, path, rows(spark, {f"{k}.txt": ["a"] for k in range(200)}), META, bucket_rows=10)
    some = index.open_index(spark, path).rows_of(["3.txt", "4.txt", "none.txt"])
    assert sorted(r.file_path for r in some.collect()) == ["3.txt", "4.txt"]
    assert len(some.inputFiles()) <= 3


# many questions


def test_many_questions_without_the_driver(spark, monkeypatch):
    rng = random.Random(1)
    vectors = [(f"f{k % 7}", k, [rng.choice((0.0, 1.0, 2.0)) for _ in range(3)]) for k in range(200)]
    df = spark.createDataFrame(vectors, "file string, at int, embedding array<float>").repartition(5)
    questions = [(q, [rng.choice((0.0, 1.0)) for _ in range(3)]) for q in range(40)]
    asked = spark.createDataFrame(questions, "query_id long, query array<double>")
    want = {}
    for q, x in questions:
        one = knn.top_k(df, x, 6, ["file", "at"])
        want[q] = [(r.file, r["at"], r.score and round(r.score, 9)) for r in one.collect()] if q < 4 else None
    got = {}
    for r in knn.top_k_each(df, asked, 6, ["file", "at"], block=7, at_once=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.file, r["at"], r.score and round(r.score, 9)))
    assert set(got) == set(range(40)) and all(len(v) == 6 for v in got.values())
    assert all(got[q] == v for q, v in want.items() if v)
    assert knn.top_k_each(df.limit(0), asked, 6, ["file", "at"]).count() == 0 and knn.top_k_each(df, asked.limit(0), 6, ["file", "at"]).count() == 0


def test_all_hits_by_file(spark):
    hits = spark.createDataFrame([(f"p{k % 9}", k, (k * 37 % 101) / 7) for k in range(300)], "path string, chunk_idx int, score double").repartition(6)
    one, many = search.by_file(hits).collect(), search.by_file(hits, few=False).collect()
    assert one == many and [r["rank"] for r in many] == list(range(9))


# folders


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    def put(name, text="hit here\n"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    for k in range(40):
        put(f"a/{k // 10}/f{k:02d}.txt")
    for k in range(30):
        put(f"big/deep{k}/x.txt")
    put(".gitignore", "big/\n*.log\n!keep.log\n")
    put("a/.ignore", "f03.txt\n/1/f1[0-4].txt\n")
    put("a/1/.gitignore", "!f12.txt\n")
    for name in (".hid/den.txt", "_under.txt", "x.log", "keep.log", "b c%20é.txt", "empty.txt"):
        put(name)
    (root / "link.txt").symlink_to(root / "keep.log")
    (root / "linked").symlink_to(root / "a")
    return str(root)


KEPT = {f"a/{k // 10}/f{k:02d}.txt" for k in range(40)} - {"a/0/f03.txt", "a/1/f10.txt", "a/1/f11.txt", "a/1/f13.txt", "a/1/f14.txt"}
KEPT |= {".hid/den.txt", "_under.txt", "keep.log", "b c%20é.txt", "empty.txt", ".gitignore", "a/.ignore", "a/1/.gitignore"}


@pytest.mark.parametrize("budget", [20_000, 1, 7])
def test_walk(spark, tree, budget):
    found = walk.listed(spark, tree, budget=budget).collect()
    assert {r.relative for r in found} == KEPT and len(found) == len(KEPT)
    assert {r.size_bytes for r in found if r.relative.endswith(".txt")} == {9}
    shown = {r.relative for r in walk.listed(spark, tree, hidden=False, ignore_files=False, budget=budget).collect()}
    assert shown == {r for r in shown if not any(p.startswith(".") for p in r.split("/"))} and "big/deep3/x.txt" in shown and "a/0/f03.txt" in shown


def test_ignored_folders_are_never_listed(tree, monkeypatch):
    listed, entries = [], walk.entries
    monkeypatch.setattr(walk, "entries", lambda fs, path: listed.append(path) or entries(fs, path))
    list(walk.Walker(tree, True, True).walk([("", [])], 1 << 30))
    assert any(p.endswith("/a/1/") for p in listed) and not any("/big" in p for p in listed)


def test_many_folders_are_dealt_to_few_tasks():
    assert [walk.tasks_of(n, 12) for n in (1, 40, 100, 190_000, 650_000)] == [1, 40, 48, 48, 159]


def test_folder_source(spark, tree):
    spark.dataSource.register(walk.FolderSource)
    for partitions in (1, 3, 64):
        found = [r.relative for r in spark.read.format("folder").option("partitions", partitions).load(tree).collect()]
        assert sorted(found) == sorted(KEPT)


def test_contents_are_read_in_tasks(spark, tree):
    read = files.scan(spark, tree, files.Walk(supported_only=False))
    got = {r.relative: bytes(r.content) for r in read.collect()}
    assert set(got) == KEPT and got["b c%20é.txt"] == b"hit here\n"
    kinds = {r.relative for r in files.scan(spark, tree).collect()}
    assert kinds == {k for k in KEPT if k.endswith((".txt", ".log"))}


def test_files_are_written_in_tasks(spark, tmp_path):
    """A file for each row and nothing else, made by the tasks; a folder of documents keeps both of two with one id."""
    rows = spark.createDataFrame([(f"d{k % 3}/f{k}.txt", f"é {k}\n".encode()) for k in range(50)] + [("empty.txt", b"")], "relative string, content binary").repartition(4)
    assert walk.write_files(rows, f"file://{tmp_path}/out") == walk.write_files(rows, f"file://{tmp_path}/out") == 51
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out"): open(os.path.join(d, f), "rb").read() for d, _, names_ in os.walk(tmp_path / "out") for f in names_}
    assert found == {r.relative: bytes(r.content) for r in rows.collect()}
    spark.createDataFrame([(2, "a station"), (2, "b"), (1003, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/sf/documents.parquet")
    root = queries._folder(spark, f"{tmp_path}/sf").removeprefix("file://")
    assert sorted(f for _, _, names_ in os.walk(root) for f in names_ if f.endswith((".txt", ".crc", "_SUCCESS")) and "gitignore" not in f) == ["part-1.txt", "part-1.txt", "part-2.txt"]
    assert sorted(tuple(r) for r in queries.folder_listing(spark, f"{tmp_path}/sf").collect()) == [(2, 2), (2, 10), (1003, 1)]


def test_a_capped_search_reads_few_files(spark, tmp_path, monkeypatch):
    for k in range(60):
        (tmp_path / f"f{k:02d}.txt").write_text("hit\n" * (k % 3))
    monkeypatch.setattr(search, "FIRST_FILES", 8)
    query = SearchQuery("hit", root=str(tmp_path), max_results=5)
    listed = files.names(spark, str(tmp_path))
    kept, _, looked_at = search._capped(listed, str(tmp_path), query, None)
    assert [k[-7:] for k in kept] == ["f01.txt", "f02.txt", "f04.txt", "f05.txt"] and looked_at == 8
    found, errors = search.search_folder(spark, query)
    assert sorted({r.path[-7:] for r in found.collect()}) == ["f01.txt", "f02.txt", "f04.txt", "f05.txt"] and errors.count() == 0
    every, _ = search.search_folder(spark, SearchQuery("hit", root=str(tmp_path), max_results=1000))
    assert every.count() == 60
    none, _ = search.search_folder(spark, SearchQuery("absent", root=str(tmp_path), max_results=3))
    assert none.count() == 0


# rebuilds


def test_old_rows_answer_while_a_new_index_is_built(spark, tmp_path):
    old, new, path = tmp_path / "old", tmp_path / "new", f"{tmp_path}/index"
    for folder, word in ((old, "alpha"), (new, "alpha beta")):
        folder.mkdir()
        (folder / f"{folder.name}.txt").write_text(word)
    search.build_index(spark, str(old), path, EMBEDDER)
    go, begun = threading.Event(), []

    def rebuild():
        begun.append(1)
        assert go.wait(60)
        search.build_index(spark, str(new), path, EMBEDDER)

    rebuilds = search.Rebuilds()
    ask = lambda: [r.path for r in search.search_index(spark, SearchQuery("alpha", mode=SEMANTIC, root=str(new), max_results=5), path, EMBEDDER, rebuild=rebuild, rebuilds=rebuilds).collect()]
    assert ask() == [str(old / "old.txt")] and ask() == [str(old / "old.txt")]
    assert rebuilds.goes_on(path)
    go.set()
    rebuilds.wait(path, 120)
    assert ask() == [str(new / "new.txt")] and len(begun) == 1 and not rebuilds.goes_on(path)

    def broken():
        raise ValueError("no")

    assert rebuilds.start(spark, path, broken)
    with pytest.raises(ValueError, match="no"):
        rebuilds.wait(path, 60)
    assert ask() == [str(new / "new.txt")] and Folder(spark, path).exists("CURRENT")


# events


def test_polls_tell_what_changed(spark, tmp_path):
    from lodeseek.streaming import source

    root, state = tmp_path / "watched", str(tmp_path / "state")
    root.mkdir()
    (root / "a.txt").write_text("one")
    (root / "b.txt").write_text("two")
    (root / "c.exe").write_text("not searched")
    read = lambda: sorted((os.path.basename(r.path), r.exists) for r in spark.read.schema(schema.EVENTS).parquet(f"{state}/events").collect())
    assert source.poll(spark, str(root), state) == 2 and read() == [("a.txt", True), ("b.txt", True)]
    assert source.poll(spark, str(root), state) == 0
    (root / "a.txt").write_text("longer now")
    (root / "b.txt").unlink()
    (root / "d.txt").write_text("new")
    assert source.poll(spark, str(root), state) == 3
    assert read()[2:] == [("b.txt", False), ("b.txt", True), ("d.txt", True)]


def test_a_burst_is_indexed_once(spark, tmp_path):
    """Ten events of a path in several batches, half a second apart at most, are one change; the other path's is its own."""
    import time

    from lodeseek.streaming import watch

    path, events = f"{tmp_path}/index", str(tmp_path / "events")
    index.create(spark, path, rows(spark, {"a.txt": ["old"]}), META)
    asked = []

    def read(changed):
        found = sorted(r.path for r in changed.collect())
        asked.append(found)
        return spark.createDataFrame([(p, "PlainText", "new text", None, None) for p in found], f"path string, file_type string, text string, source_map array<{schema.SEGMENT}>, error string")

    def put(name, exists=True):
        spark.createDataFrame([(name, exists, exists)], "path string, exists boolean, is_file boolean").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(events)

    put("/r/b.txt")
    query = watch.watch(spark, events, path, read, EMBEDDER, "/r", str(tmp_path / "cp"), settle=4000)
    try:
        for _ in range(10):
            put("/r/a.txt")
            time.sleep(0.3)
        for _ in range(240):
            if sum(len(a) for a in asked) >= 2 and index.status(spark, path)["indexed_files"] == 2:
                break
            time.sleep(0.5)
        time.sleep(6)
    finally:
        query.stop()
    assert sorted(p for a in asked for p in a) == ["/r/a.txt", "/r/b.txt"]
    assert contents(spark, path) == [("a.txt", 0, "new text"), ("b.txt", 0, "new text")]


# large files


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_a_file_in_parts_gives_the_same_rows(spark, tmp_path, monkeypatch, size):
    rng = random.Random(size)
    texts = ["", "\n", "hit", "\n\nhit\n", "é hit\r\nno\nhit hit\n" * 9, "x" * 300 + "hit\n" + "y" * 90, "a\n" * 40 + "hit"]
    texts += ["".join(rng.choices(["hit", " ", "\n", "é", "字", "\r\n", "word"], k=60)) for _ in range(6)]
    for k, t in enumerate(texts):
        (tmp_path / f"{k:02d}.txt").write_bytes(t.encode() + (b"\xff hit\n" if k % 3 == 0 else b""))
    for query in (SearchQuery("hit", root=str(tmp_path)), SearchQuery("hit", root=str(tmp_path), max_results=7), SearchQuery("^|hit$", is_regex=True, root=str(tmp_path))):
        whole = sorted(map(str, search.search_folder(spark, query)[0].collect()))
        with monkeypatch.context() as m:
            m.setattr(files, "SPLIT_BYTES", size)
            parts = search.search_folder(spark, query)[0]
            assert sorted(map(str, parts.collect())) == whole and whole


def test_parts_have_a_bound(spark, tmp_path):
    """40 MB of lines in parts of 1 MB: rows of one part each, lines numbered over all."""
    with open(tmp_path / "big.log", "w") as f:
        for k in range(40):
            f.write("".join(f"line {k * 10_000 + j} of a large file, {'needle' if j == 77 else 'nothing'} here and more words behind it to fill the row up to a hundred signs\n" for j in range(10_000)))
    found = files.names(spark, str(tmp_path))
    parts = walk.line_parts(found, str(tmp_path), 1 << 20)
    sizes = [r.n for r in parts.select(F.length("content").alias("n")).collect()]
    assert len(sizes) > 35 and max(sizes) < (1 << 20) + 300 and sum(sizes) == os.path.getsize(tmp_path / "big.log")
    rows_ = search._line_matches(parts.select("path", "file_type", files.lossy_text(F.col("content")).alias("text"), "byte_base", "line_base"), SearchQuery("needle")).collect()
    assert sorted(r.line for r in rows_) == [k * 10_000 + 78 for k in range(40)]
    with open(tmp_path / "big.log", "rb") as f:
        for r in rows_[::9]:
            f.seek(r.start)
            assert f.read(r.end - r.start) == b"needle"
