"""Exact top-k by cells: the rows of a scan, with most cells unread where vectors are clustered."""

import numpy as np
import pytest

from lodeseek import schema
from lodeseek.config import SEMANTIC, SearchQuery
from lodeseek.operators import cells, embed, index, knn
from lodeseek.plans import search


def made(spark, path, vectors, n=None):
    rows = [(f"f{k % 9}.txt", k, 0, 1, "TextFile", None, 1, 0, None, None, None, None, f"text {k}", [float(x) for x in v]) for k, v in enumerate(vectors)]
    index.create(spark, path, spark.createDataFrame(rows, schema.INDEX), {"engine": "Fastembed", "model_id": "hashing", "dimension": len(vectors[0]) if len(vectors) else 4, "root_path": "/r"}, bucket_rows=100)


def scanned(spark, path, query, k):
    return [tuple(r) for r in knn.top_k(index.open_index(spark, path).chunks, query, k, cells.KEYS).collect()]


@pytest.mark.parametrize("kind", ["clusters", "plain", "copies and zeros"])
def test_cells_give_the_rows_of_a_scan(spark, tmp_path, kind):
    rng, path = np.random.default_rng(4), f"{tmp_path}/index"
    x = rng.normal(size=(500, 6))
    if kind == "clusters":
        x = rng.normal(size=(20, 6))[np.repeat(np.arange(20), 25)] + 0.02 * x
    if kind == "copies and zeros":
        x = x[rng.integers(0, 30, 500)]
        x[::7] = 0
    made(spark, path, x)
    described = cells.make(spark, path, cell_rows=25)
    assert sum(c["n"] for c in described["cells"]) == 500
    queries = [x[3] + 0.001, -x[5], rng.normal(size=6), np.zeros(6)]
    for query in queries:
        for k in (1, 10, 40):
            found, read = cells.top_k(spark, path, described, [float(v) for v in query], k)
            assert [tuple(r) for r in found] == scanned(spark, path, [float(v) for v in query], k)
            if kind == "clusters" and query is queries[0] and k <= 10:
                assert read <= len(described["cells"]) // 4
    found, _ = cells.top_k(spark, path, described, [1.0] * 6, 600)
    assert [tuple(r) for r in found] == scanned(spark, path, [1.0] * 6, 600)


def test_search_uses_the_cells_of_its_version_only(spark, tmp_path, monkeypatch):
    path, embedder = f"{tmp_path}/index", embed.HashingEmbedder(8)
    made(spark, path, embedder.embed([f"word{k % 11} text {k}" for k in range(60)]))
    ask = lambda: [tuple(r) for r in search.search_index(spark, SearchQuery("word3 text", mode=SEMANTIC, max_results=5), path, embedder).collect()]
    before, used = ask(), []
    cells.make(spark, path, cell_rows=10)
    top_k = cells.top_k
    monkeypatch.setattr(cells, "top_k", lambda *a: used.append(1) or top_k(*a))
    assert ask() == before and len(used) == 1
    index.remove_file(spark, path, "f3.txt")
    after = ask()
    assert len(used) == 1 and not any("f3.txt" in r[0] for r in after)
    cells.make(spark, path, cell_rows=10)
    assert ask() == after and len(used) == 2


def test_cells_of_an_empty_index(spark, tmp_path):
    path = f"{tmp_path}/index"
    made(spark, path, [])
    described = cells.make(spark, path)
    assert described["cells"] == [] and cells.top_k(spark, path, described, [1.0, 0.0, 0.0, 0.0], 3) == ([], 0)
