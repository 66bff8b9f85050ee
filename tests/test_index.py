"""The index: build, open, search, change, and a stream of events."""

import pytest
from pyspark.sql import functions as F

from lodeseek import schema
from lodeseek.config import SEMANTIC, IndexingConfig, SearchQuery
from lodeseek.operators import embed, index, knn
from lodeseek.operators.store import Folder
from lodeseek.plans import search
from lodeseek.streaming import watch

EMBEDDER = embed.HashingEmbedder(32)
TEXTS = {"/r/a.txt": "alpha beta gamma", "/r/b.md": "delta epsilon " * 80, "/r/c.txt": "alpha alpha zeta", "/r/empty.txt": ""}


def documents(spark, texts):
    rows = [(p, "PlainText", t, None, None if t is not None else "unreadable") for p, t in texts.items()]
    return spark.createDataFrame(rows, f"path string, file_type string, text string, source_map array<{schema.SEGMENT}>, error string")


def contents(spark, path):
    return sorted((r.file_path, r.chunk_idx, r.chunk_text) for r in index.open_index(spark, path).chunks.collect())


@pytest.fixture
def built(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index.build(spark, path, documents(spark, TEXTS), EMBEDDER, "/r")
    return path


def test_build_and_status(spark, built):
    status = index.status(spark, built)
    assert status["indexed_files"] == 3 and status["total_chunks"] >= 4 and status["dimension"] == 32 and status["db_size_bytes"] > 0
    assert index.usable(status, "/r") and not index.usable(status, "/x") and not index.usable(None, "/r")
    row = index.open_index(spark, built).chunks.where("file_path = 'a.txt'").first()
    assert (row.origin_type, row.line, row.col, row.byte_start, row.byte_end) == ("TextFile", 1, 0, 0, 16)


def test_open_validation(spark, built, tmp_path):
    with pytest.raises(index.IndexError_, match="no index"):
        index.open_index(spark, f"file://{tmp_path}/none")
    with pytest.raises(index.IndexError_, match="model"):
        index.open_index(spark, built, model_id="other")
    with pytest.raises(index.IndexError_, match="dimension"):
        index.open_index(spark, built, dimension=3)
    folder = Folder(spark, built)
    for bad in ('{"schema_version": 2}', "{}", '{"schema_version": "x"}'):
        folder.write(folder.read("CURRENT") + ".json", bad)
        with pytest.raises(index.IndexError_, match="schema version"):
            index.open_index(spark, built)


def test_search(spark, built):
    rows = search.search_index(spark, SearchQuery("alpha zeta", mode=SEMANTIC, max_results=2), built, EMBEDDER).collect()
    assert rows[0].path == "/r/c.txt" and rows[0].score > rows[1].score and len(rows) == 2
    assert search.search_index(spark, SearchQuery("alpha", supported_extensions=("md",)), built, EMBEDDER).count() >= 1
    with pytest.raises(ValueError, match="dimension"):
        knn.check_dimension(3, [1.0])


def test_change(spark, built):
    index.remove_file(spark, built, "c.txt")
    assert {r[0] for r in contents(spark, built)} == {"a.txt", "b.md"}
    before = contents(spark, built)
    wrong = index.open_index(spark, built).chunks.where("file_path = 'a.txt'").withColumn("embedding", F.expr("array(float(1))"))
    with pytest.raises(index.IndexError_):
        index.apply_changes(spark, built, wrong, wrong.limit(0), wrong)
    assert contents(spark, built) == before
    index.drop(spark, built)
    with pytest.raises(index.IndexError_):
        index.read_meta(spark, built)


def test_embed_errors(spark):
    class Broken(embed.HashingEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("cannot embed")
            return super().embed(texts)

    class Short(embed.HashingEmbedder):
        def embed(self, texts):
            return super().embed(texts)[:-1]

    docs = documents(spark, {"/r/good.txt": "fine", "/r/bad.txt": "bad one"}).repartition(2, "path")
    rows, failed = index.good_rows(index.prepare(docs, Broken(8, batch=1), IndexingConfig(), "/r"))
    assert [r.file_path for r in rows.collect()] == ["good.txt"] and [r.error for r in failed.collect()] == ["cannot embed"]
    short = index.prepare(docs, Short(8), IndexingConfig(), "/r")
    assert short.where("embed_error is null").count() == 0


def test_prefixes():
    assert embed.prefixes('{"prompts": {"search_query": "q: ", "doc": "d: ", "x": "y"}}') == {"query_prefix": "q: ", "passage_prefix": "d: "}
    assert embed.prefixes("not json") == embed.prefixes("{}") == {}


def test_classify(spark):
    rows = [("a.txt", True, True, 1), ("b.exe", True, True, 1), ("gone.zz", False, False, 1), ("dir", True, False, 1), ("c.txt", True, True, 1), ("c.txt", False, False, 2)]
    df = spark.createDataFrame(rows, "path string, exists boolean, is_file boolean, t int").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    assert sorted(map(tuple, watch.classify(df).collect())) == [("a.txt", "changed"), ("c.txt", "removed"), ("gone.zz", "removed")]


def test_stream_equals_rebuild(spark, built, tmp_path):
    now = dict(TEXTS)
    events, path = str(tmp_path / "events"), built
    batches = [
        ({"/r/a.txt": "alpha new words", "/r/d.txt": "fresh file"}, ["/r/c.txt"]),
        ({"/r/b.md": "short now", "/r/d.txt": ""}, []),
        ({"/r/moved.txt": "alpha new words"}, ["/r/a.txt"]),
    ]

    def read(paths):
        wanted = {r.path for r in paths.collect()}
        return documents(spark, {p: now.get(p) for p in wanted})

    for n, (changed, removed) in enumerate(batches):
        now = {p: t for p, t in {**now, **changed}.items() if p not in removed}
        rows = [(p, True, True, n) for p in changed] + [(p, False, False, n) for p in removed]
        df = spark.createDataFrame(rows, "path string, exists boolean, is_file boolean, t int").withColumn("ts", F.timestamp_seconds("t")).drop("t")
        df.coalesce(1).write.mode("append").parquet(events)
        watch.watch(spark, events, path, read, EMBEDDER, "/r", str(tmp_path / "cp"), once=True).awaitTermination(120)
    fresh = f"file://{tmp_path}/fresh"
    index.build(spark, fresh, documents(spark, now), EMBEDDER, "/r")
    assert contents(spark, path) == contents(spark, fresh)
    meta = index.read_meta(spark, path)
    index.apply_changes(spark, path, spark.createDataFrame([], schema.INDEX), spark.createDataFrame([("b.md",)], "file_path string"), spark.createDataFrame([], "file_path string"), batch=meta["batch"])
    assert contents(spark, path) == contents(spark, fresh)  # a batch that comes again changes nothing


def test_unreadable_file_keeps_its_rows(spark, built):
    before = contents(spark, built)
    df = spark.createDataFrame([("/r/a.txt", True, True)], "path string, exists boolean, is_file boolean").withColumn("ts", F.current_timestamp())
    watch.apply_batch(spark, built, df, lambda p: documents(spark, {"/r/a.txt": None}), EMBEDDER, "/r")
    assert contents(spark, built) == before


def test_progress(spark, tmp_path):
    import time

    from lodeseek.streaming.progress import Progress

    seen = []
    follower = Progress(on_rows=seen.append)
    spark.streams.addListener(follower)
    try:
        spark.createDataFrame([("a", True, True)], "path string, exists boolean, is_file boolean").withColumn("ts", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema.EVENTS).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(lambda df, n: df.count()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        for _ in range(50):
            if any(e["kind"] == "done" for e in follower.events):
                break
            time.sleep(0.2)
        assert {"started", "progress", "done"} <= {e["kind"] for e in follower.events} and seen == [1]
    finally:
        spark.streams.removeListener(follower)


def test_catch_up(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size_bytes long, modified long")
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, size_bytes long, modified long")
    assert sorted(map(tuple, watch.catch_up(old, new).collect())) == [("b", "changed"), ("c", "removed"), ("d", "changed")]
