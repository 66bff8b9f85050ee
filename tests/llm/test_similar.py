"""Near-dedup of the pipeline against Jaccard similarities of all pairs."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodeseek.llm import shared, similar, simhash, tokenizing


def shingle_set(text):
    words = simhash._WORD.findall((text or "").translate(simhash._LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)} - {()}


def kept_ids(texts):
    """The smallest id of each group of texts that similarities of 0.8 or more connect."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}


def planted():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    line = rng.choices(words, k=40)
    texts = []
    for k in range(60):
        base = rng.choices(words, k=rng.randint(5, 400)) + line * (k % 3 == 0)
        texts.append(base)
        for _ in range(40 if k == 7 else rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [rng.choice(words)]
            texts.append(copy)
    rng.shuffle(texts)
    return {k: " ".join(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize(("block", "common"), [(2048, 8), (8, 1)])
def test_near_copies_by_brute_force(spark, monkeypatch, block, common):
    monkeypatch.setattr(similar, "COMMON", common)
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    fps = {d: simhash.fingerprint(t) for d, t in texts.items()}
    sets = {d: shingle_set(t) for d, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert sum((fps[a] ^ fps[b]).bit_count() > simhash.DISTANCE for a, b in near) > 50
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs, block=block).collect()]
    assert sorted(kept) == sorted(kept_ids(texts))


def test_near_copies_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == kept_ids(texts)


def test_crowded_key_keeps_what_its_forest_missed():
    """A forest of candidates may join two true groups by a pair that is none; the second look tests across."""
    group = similar._Group(np.full(4, 90), [bytes(16)] * 4)
    assert len(group.forest()) == 3
    assert sorted(group.across(np.array([1, 1, 2, 2]))) == [(2, 0), (2, 1), (3, 0), (3, 1)]


def test_sketches_lose_no_similar_pair():
    """Sets of any size and width of sketch: all pairs of similarity 0.8 or more are candidates, most others are not."""
    rng = random.Random(4)
    universe = [rng.getrandbits(64) for _ in range(6000)]
    sets = []
    for _ in range(25):
        base = rng.sample(universe, rng.choice((3, 40, 62, 66, 120, 130, 500, 1030)))
        for _ in range(4):
            gone = rng.randrange(0, 1 + len(base) // 6)
            sets.append(np.unique(np.array(base[gone:] + rng.sample(universe, rng.randrange(0, 1 + len(base) // 8)), np.uint64)))
    group = similar._Group(np.array([len(x) for x in sets]), [similar.sketch(x) for x in sets])
    good = wrong = 0
    for k, one in enumerate(sets):
        found = set(group.near(k, np.arange(len(sets)) != k).tolist())
        alike = {j for j, other in enumerate(sets) if j != k and similar.similar(one, other)}
        assert alike <= found
        good, wrong = good + len(alike), wrong + len(found - alike)
    assert good > 50 and wrong < good


def met_under_one_key(sets, labels):
    rows = [np.ones(len(sets), np.int64), np.zeros(len(sets), np.int32), np.arange(len(sets)), [len(x) for x in sets]]
    arrays = [pa.array(x) for x in rows] + [pa.array([similar.sketch(x) for x in sets]), pa.array(labels)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "cell", "sid", "size", "sketch", "label"])


def crowd(n, alike):
    """A set, so many copies of it that are similar, and others at 0.75 or a little over 0.8 to it and little to each other."""
    rng = random.Random(5)
    universe = [rng.getrandbits(64) for _ in range(100_000)]
    base, sets = universe[:400], []
    for k in range(n):
        gone = 5 if k < alike else rng.choice((40, 46, 57))
        sets.append(np.unique(np.array(base[gone:] + rng.sample(universe[400:], gone), np.uint64)))
    return [np.unique(np.array(base, np.uint64)), *sets]


@pytest.mark.parametrize("held", [similar.HELD, 40_000])
def test_crowded_key_gives_no_more_rows_than_sets(monkeypatch, held):
    """Pairs that sizes and sketches can't tell grow with the square of a group; clusters and links of labels do not, and none is lost."""
    monkeypatch.setattr(similar, "HELD", held)
    sets = crowd(400, 150)
    labels = np.array([0] * 151 + list(range(151, len(sets))))  # SimHash has joined the close copies
    alike = {(a, b) for b in range(len(sets)) for a in range(b) if similar.similar(sets[a], sets[b])}
    assert len(similar._Group(np.array([len(x) for x in sets]), [similar.sketch(x) for x in sets]).across(labels)) > 10 * len(sets)
    rows = similar._open(met_under_one_key(sets, labels), np.array([0]), np.array([len(sets)]))
    if held > 40_000:
        assert rows.num_rows <= len(sets)
    links = set()
    for name in rows.column(0).unique().to_pylist():
        which = rows.filter(pa.array([x == name for x in rows.column(0).to_pylist()]))
        sids, named = which.column(2).to_pylist(), np.array(which.column(3).to_pylist())
        assert sum(len(sets[k]) for k in sids) <= held + 1000
        found = similar.joining([sets[k] for k in sids], named)
        assert len(found) < len(sids)
        links |= {tuple(sorted((sids[a], sids[b]))) for a, b in found}
    assert links and links <= alike

    def groups(pairs):
        label = labels.copy()
        for _ in range(20):
            for a, b in pairs:
                label[label == max(label[a], label[b])] = min(label[a], label[b])
        return label.tolist()

    assert groups(links) == groups(alike)


def test_simhash_finds_near_copies_by_itself(spark, monkeypatch):
    """Links come from fingerprints first: without the rest, close copies are found and nothing else goes."""
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    whole = kept_ids(texts)
    monkeypatch.setattr(similar, "links", lambda *_: spark.createDataFrame([], "a long, b long"))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    copies = len(texts) - len({frozenset(shingle_set(t)) for t in texts.values()})
    assert whole < kept and len(texts) - len(kept) > copies + 10


def test_sets_that_meet_under_many_keys_are_named_once():
    """Near copies share most of their keys; sets that sizes connect have one name under all of them, apart from others."""
    meets = [[(7, 100), (8, 110), (9, 300)], [(7, 100), (8, 110)], [(5, 100)], [(8, 110), (7, 100), (9, 300), (6, 310)]]
    rows = [(key, 0, sid, size) for key, met in enumerate(meets) for sid, size in sorted(met, key=lambda x: x[1])]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["key", "cell", "sid", "size"])
    begin = np.array([k for k, r in enumerate(rows) if not k or rows[k - 1][0] != r[0]])
    found = similar._several(batch, begin, np.append(begin[1:], len(rows)))
    named = {}
    for name, sid in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        named.setdefault(name, set()).add(sid)
    assert sorted(map(sorted, named.values())) == [[6, 9], [7, 8]]


def test_written_tables_leave_no_shuffle_files(spark):
    """Else they stay until the driver collects its garbage, and count as disk."""
    kept = lambda: sum(b.isShuffle() for b in blocks())

    def blocks():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return [found.apply(k) for k in range(found.size())]

    before = kept()
    written = shared.write_shared(spark.range(1000).repartition(3, "id"), "shuffled")
    assert len(written.collect()) == 1000
    for _ in range(50):
        if kept() <= before:
            break
        time.sleep(0.1)
    assert kept() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_near_dedup_frees_tokens_of_work_before():
    """A worker of a former packing would hold its tokens all through near-dedup."""
    tokenizing.encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    similar._forget()
    assert tokenizing.encoder.cache_info().currsize == 0
