"""Nearest neighbours, ranked search and spelling variants, against plain versions on small and odd tables."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from lodeseek.llm import neighbours, queries, ranked, spelling
from lodeseek.llm.shared import write_shared

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# nearest neighbours


def exact_neighbours(rows, asked, k):
    out = {}
    for q, x in asked:
        scores = [(-float(np.dot(np.array(x, float), np.array(y, float))), i) for i, y in rows if i != q and len(y) == len(x)]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found_neighbours(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_op11_has_recall_over_nine_tenths(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = exact_neighbours(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = found_neighbours(queries.op11_nearest_neighbours(spark, sf_dir))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = dict(rows)
    for q, best in got.items():
        for i, score in best:
            assert score == pytest.approx(float(np.dot(np.array(vectors[q], float), np.array(vectors[i], float))), rel=1e-12)


@pytest.mark.parametrize("kind", ["clusters", "plain", "lengths", "copies"])
def test_graph_recall(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] + 0.2 * x
    if kind == "lengths":
        x *= rng.lognormal(0, 0.7, size=(3000, 1))
    if kind == "copies":
        x[:1200] = x[0]
    ids = rng.permutation(3000).astype(np.int64)
    shard = neighbours.Graph({k: v.tobytes() for k, v in neighbours.graph(ids, x).items()} | {"dim": 24})
    asked = np.arange(0, 3000, 30)
    hits = 0
    for q, (found, _) in zip(asked, shard.search(ids[asked], x[asked], 10), strict=True):
        scores = x @ x[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:10]
        hits += len(set(ids[order].tolist()) & set(found.tolist()))
    assert hits >= 0.9 * 10 * len(asked)


def test_every_node_is_in_reach():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(300, 4)) + 40 * k for k in range(4)])  # far apart
    made = neighbours.graph(np.arange(1200), x)
    layer = made["neighbours"][: 1200 * 2 * neighbours.LINKS].reshape(1200, -1)
    assert len(neighbours._lost(layer)) == 0
    assert made["layers"][0] == 1200


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]),
            (9, [1.0, 2.0, 3.0]), (10, [3.0, 1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (21, [-1.0, 4.0]), (40, [2.0, 2.0]), (40, [0.0, 1.0])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<float>, rank string, score int")
    good = [(0, [1, 0]), (1, [1, 0]), (2, [1, 0]), (9, [1, 2, 3]), (10, [3, 1, 0]), (20, [0.5, 0.5]), (21, [-1, 4]), (40, [2, 2]), (40, [0, 1])]
    got = found_neighbours(neighbours.nearest(df, df.where("vec_id in (0, 20, 10, 3, 5)"), k=4, shard=4))
    assert got == exact_neighbours(good, [(0, [1, 0]), (20, [0.5, 0.5]), (10, [3, 1, 0])], 4)
    # Two vectors of one id ask apart.
    two = neighbours.nearest(df, df.where("vec_id = 40"), k=2).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in two) == [(1, 21, 4.0), (1, 21, 6.0), (2, 0, 2.0), (2, 20, 0.5)]
    empty = df.limit(0)
    assert neighbours.nearest(empty, empty).count() == 0 and neighbours.nearest(df, empty).count() == 0 and neighbours.nearest(empty, df.where("vec_id = 0")).count() == 0


def test_queries_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = write_shared(neighbours.build_index(df, shard=100), "test-graphs")
    assert index.count() == 3
    got = found_neighbours(neighbours.search(index, df.where("vec_id % 10 = 0"), 5, block=500))
    assert got.keys() == {i for i in range(0, 300, 10)}
    want = exact_neighbours(rows, rows[::10], 5)
    assert sum([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want) >= 29


# ranked search


def plain_ranked(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    bags = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(w for _, b in bags for w in set(b))
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            tf, score = Counter(bag), 0
            for w in terms(text):
                if tf[w]:
                    m = 75 + 25 * len(bag) * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def as_rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


RANKED = ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("shard_bytes, block", [(4 << 20, 4 << 20), (2000, 300)])
def test_ranked_as_by_definition(spark, shard_bytes, block, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(ranked, "CLUSTER", 4)
    letters = ["w%d" % int(rng.paretovariate(0.7)) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (None, None), (300, ""), (301, "-- !! \x7f"), (302, "Éa éA ÄB über9 W1w2"), (7, docs[7][1]), (303, "w3 " * 30_000)]
    items = [(i, " ".join(rng.choice(letters) for _ in range(8))) for i in range(12)] + [(50, docs[7][1]), (51, "éA W1W2 Über9"), (52, None), (53, "?"), (None, "w3 w3 w9"), (1, "w2"), (1, "w2")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    index = ranked.write_index(df, shard_bytes=shard_bytes)
    got = ranked.search(index, asked, 9, block=block)
    assert got.columns == RANKED
    assert as_rows(got, RANKED) == sorted(plain_ranked(docs, items, 9), key=str)


def test_ranked_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.ranked(docs.limit(0), items).count() == 0
    assert ranked.ranked(docs, items.limit(0)).count() == 0


def test_bisection_brings_like_documents_together():
    rng = np.random.default_rng(0)
    topic = rng.permutation(np.repeat(np.arange(4), 100))
    doc = np.repeat(np.arange(400), 12)
    term = np.concatenate([t * 40 + np.sort(rng.choice(40, 12, replace=False)) for t in topic])
    order, clusters = ranked.bisected(doc, term, 400, leaf=50, rounds=20)
    assert sorted(order.tolist()) == list(range(400)) and clusters[-1] == 400
    pure = [np.bincount(topic[order[a:b]], minlength=4).max() / (b - a) for a, b in zip(clusters[:-1], clusters[1:], strict=True)]
    assert np.mean(pure) > 0.95


def test_clusters_below_the_floor_are_not_visited():
    texts = ["zeta zeta zeta", *["zeta " + "filler " * 30] * 5, *["other words here"] * 30]
    b = ranked._shard(pa.array(range(len(texts)), pa.int64()), pa.array(texts))
    row = {n: b.column(n)[0].as_py() if n != "terms" else b.column(n)[0].values for n in b.schema.names}
    row["clusters"] = np.arange(len(texts) + 1, dtype="<i4").tobytes()  # each document by itself
    shard = ranked.Shard(row, pa.array(["zeta"]), np.array([1000]), len(texts), 300)
    visited, scores = [], shard.scores
    shard.scores = lambda rows, times, clusters: visited.extend(clusters.tolist()) or scores(rows, times, clusters)
    positions, _ = shard.best(np.array([0]), np.array([1]), 1, 0, False)
    assert shard.ids[positions].tolist() == [0] and len(visited) == 1


# spelling


def edits(w, v):
    if abs(len(w) - len(v)) > 1 or w == v:
        return False
    if len(w) == len(v):
        return sum(a != b for a, b in zip(w, v, strict=True)) == 1
    long, short = max(w, v, key=len), min(w, v, key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_words(docs, dropped):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if dropped and h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    forms, out = {}, []
    for w, n in words.items():
        near = [v for v in words if edits(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = (best if best and words[best] >= 10 * n else None, len(near))
    for w, n in words.items():
        root, form = w, forms[w][0]
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, form, root, n, forms[w][1], words[form] if form else None))
    return sorted(out, key=str)


SPELLED = ["word", "form", "root", "n", "n_near", "form_n"]


def odd_documents():
    rng = random.Random(8)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 10))) for _ in range(250)]
    docs = [(i, " ".join(w for w in base for _ in range(int(rng.paretovariate(0.6)) % 60))) for i in range(6)]
    docs += [(None, None), (7, ""), (8, "short a b c"), (9, "aaaaaaaa aaaaaaaaa aaaaaaa " * 3), (9, "aaaaaaaa aaaaaaaaa aaaaaaa " * 3), (10, ("a" * 500 + " ") * 25 + ("a" * 501 + " ") * 2)]
    docs += [(11, "Straße×÷ßþ1ABCDEFGÀ àbcdefgh ÀBCDEFGH " * 2), (None, "abababab, abababab abababa abababa")]
    return docs


@pytest.mark.parametrize("bucket", [40_000, 60, 7])
@pytest.mark.parametrize("dropped", [0, 31, 3])
def test_variants_as_by_definition(spark, bucket, dropped):
    docs = odd_documents()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string")
    got = spelling.variants(df, bucket=bucket, dropped=dropped)
    assert got.columns == SPELLED
    assert as_rows(got, SPELLED) == plain_variants(plain_words(docs, dropped))


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(600)})
    root = spelling.automaton(words)
    assert root.count == len(words)
    states, futures = {}, {}

    def future(state):
        if id(state) not in states:
            states[id(state)] = (state.final, *[(c, future(child)) for c, (child, _) in sorted(state.arcs.items())])
            futures.setdefault(states[id(state)], []).append(id(state))
        return states[id(state)]

    future(root)
    assert all(len(same) == 1 for same in futures.values())
    for w in words:
        for half in range(len(w) + 1):
            found = list(spelling.near(root, w, half))
            assert len(found) == len(set(found))
            assert {words[k] for k in found} == {v for v in words if v.startswith(w[:half]) and edits(w[half:], v[half:])}


def test_long_chains_of_forms(spark):
    words = [("abcdefg" + "x" * k, 10**k * 2) for k in range(9)]
    vocabulary = write_shared(spark.createDataFrame(words, "word string, n long"), "test-words")
    rows = spelling.rooted(write_shared(spelling.forms(vocabulary), "test-forms")).collect()
    assert {r["root"] for r in rows} == {"abcdefgxxxxxxxx"}
