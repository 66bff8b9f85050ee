"""SimHash near-duplicates: Pigeonring chains pick candidates, Hamming distance confirms, components group.

A fingerprint has 64 bits; two link at DISTANCE = 4 or fewer differing bits. It is cut into 5
segments in a ring. If the segments' differences add up to 4 or fewer, then from some segment on
every chain of l consecutive segments has at most l * 4 / 5 differing bits in all: none in its
first segment, at most 1 in two, 2 in three, 3 in four. So the first segment together with a
neighbour of the second (itself or one bit flipped) is an equality key: a fingerprint is indexed
by its 5 exact pairs of segments and looks itself up under 5 * 14 pairs. Whatever meets under a
key is pruned by the longer chains before the whole distance is taken.

Copies first collapse to one row for each distinct fingerprint. Rows are then dealt by key and
sorted, and each task walks through its keys in Arrow batches. Of a key's links it emits a
spanning forest, not all pairs: a search takes an unvisited fingerprint, links all unvisited ones
in reach and goes on from those, so no component is lost and at most one row per fingerprint comes
out. A key with more than BLOCK fingerprints is split into blocks, and each pair of blocks is a cell
dealt by itself, so no task gets an unbounded group. Components come from rounds of large-star and
small-star over the links, each round written to the shared folder; nothing about all documents
is collected.

Defined results: null and empty texts, and texts without words, have fingerprint zero and are
linked like any other; repeated rows get the same group; a null doc_id is grouped but never a
group's id (a group of nulls alone has component_id null); ties cannot arise, as the smallest id
is taken; columns of the input named fingerprint or component_id are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .shared import bounded, by_size, forget, only, trimmed, without, write_shared

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
#: Segments of the ring, as (lowest bit, width).
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of one key that one task may hold; beyond, pairs of blocks are dealt.
BLOCK = 2048
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """The SimHash of 4-word shingles, repeats counted; bit i is set if over half of their hashes have it."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall((text or "").translate(_LOWER) if text and not text.islower() else text or "")
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxh64_intdigest(" ".join(words).encode(), SEED)]
    else:
        joined = " ".join(words).encode()
        ends = np.cumsum(np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - SHINGLE].tolist()]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(every: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(every), 1 << 16):  # bounded memory for long texts
        counts += np.unpackbits(every[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(every), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed 64-bit long (the same bits)."""
    kept = without(docs, [name])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, at):
            fps = np.array([fingerprint(t.as_py()) for t in b.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], [*b.schema.names, name])

    return bounded(kept).mapInArrow(run, kept.select("*", F.lit(0).cast("long").alias(name)).schema)


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(lo)) & np.uint64((1 << w) - 1) for lo, w in SEGMENTS]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact keys (side 0) and looked-up keys (side 1) of each fingerprint."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            b = whole.slice(at, 4096)
            signed = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            seg = _segments(signed.view(np.uint64))
            keys, sides = [], []
            for i in range(len(SEGMENTS)):
                width = SEGMENTS[(i + 1) % len(SEGMENTS)][1]
                head, tail = (np.uint64(i) << np.uint64(13)) | seg[i], seg[(i + 1) % len(SEGMENTS)]
                exact = (head << np.uint64(13)) | tail
                keys += [exact, exact] + [exact ^ np.uint64(1 << j) for j in range(width)]
                sides += [0] + [1] * (width + 1)
            n = len(signed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.repeat(np.array(sides, np.int8), n)), pa.array(np.tile(signed, len(sides)))],
                ["key", "side", "fp"],
            )


def _near(one: np.ndarray, many: np.ndarray, i: int) -> np.ndarray:
    """Which of many one links to under a key of segment i: the chains' budgets, then the whole distance."""
    seen = one ^ many
    where = np.arange(len(many))
    total = np.zeros(len(many), np.int64)
    for length in range(1, len(SEGMENTS)):
        lo, w = SEGMENTS[(i + length - 1) % len(SEGMENTS)]
        total = total + np.bitwise_count((seen >> np.uint64(lo)) & np.uint64((1 << w) - 1))
        ok = total * len(SEGMENTS) <= length * DISTANCE
        where, seen, total = where[ok], seen[ok], total[ok]
    return where[np.bitwise_count(seen) <= DISTANCE]


def _forest(index: np.ndarray, probe: np.ndarray, i: int) -> list[tuple[int, int]]:
    """Links that connect all that links under one key connect. index, probe: distinct fingerprints."""
    nodes = np.unique(np.concatenate([index, probe]))
    is_index, is_probe = np.isin(nodes, index), np.isin(nodes, probe)
    open_ = np.ones(len(nodes), bool)
    links = []
    for start in range(len(nodes)):
        if not open_[start]:
            continue
        open_[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            rest = np.flatnonzero(open_ & (is_probe if is_index[at] else False) | open_ & (is_index if is_probe[at] else False))
            if len(rest):
                for k in rest[_near(nodes[at], nodes[rest], i)].tolist():
                    links.append((int(nodes[at]), int(nodes[k])))
                    open_[k] = False
                    todo.append(k)
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, side, fp) sorted by key and cell -> links (a, b)."""

    def of(rows: tuple[np.ndarray, ...]) -> list[tuple[int, int]]:
        key, cell, side, fp = rows
        if not len(key):
            return []
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        n_index = np.add.reduceat((side == 0).astype(np.int64), begin)
        links = []
        for b, e in zip(*(x[(n_index > 0) & (end - begin - n_index > 0) & (end - begin > 2)].tolist() for x in (begin, end)), strict=True):
            s, f = side[b:e], fp[b:e]
            index, probe = np.unique(f[s == 0]), np.unique(f[s == 1])
            if len(index) > 1 or len(probe) > 1:
                links += _forest(index, probe, int(key[b]) >> 26)
        return links

    left: tuple[np.ndarray, ...] = tuple(np.array([], t) for t in (np.int64, np.int32, np.int8, np.uint64))
    for b in batches:
        got = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        rows = tuple(np.concatenate([x, y.astype(x.dtype) if k < 3 else y.astype(np.int64).view(np.uint64)]) for k, (x, y) in enumerate(zip(left, got, strict=True)))
        if not len(rows[0]):
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = len(same) if same.all() else len(same) - int(np.argmin(same[::-1]))
        cut = 0 if same.all() else cut
        yield _as_links(of(tuple(x[:cut] for x in rows)))
        left = tuple(x[cut:] for x in rows)
    yield _as_links(of(left))


def _as_links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a < b) that connect all fingerprints (distinct longs, column fp) within DISTANCE; equal links once."""
    keyed = fps.select("fp").mapInArrow(_keys, "key long, side byte, fp long")
    exact = fps.select("fp").mapInArrow(_exact_keys, "key long")
    hot = write_shared(_hot(exact, block), "simhash-hot")
    cells = F.lit(0)
    if not hot.isEmpty():
        keyed = keyed.join(hot, "key", "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        # An indexed row of block x meets the looked-up rows of every block y in cell (x, y).
        cell = F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: mine * F.col("blocks") + y)).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x * F.col("blocks") + mine)
        )
        keyed = keyed.select("key", "side", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(cell)).alias("cell"))
        cells = F.col("cell")
    dealt = keyed.select("key", cells.alias("cell"), "side", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return bounded(dealt).mapInArrow(trimmed(_links), "a long, b long").distinct()


def _hot(exact: DataFrame, block: int) -> DataFrame:
    """(key, blocks) of keys under which more than `block` fingerprints are indexed or look themselves up.

    Those that look up a key are indexed under it or under a key one bit apart. If they are over 2 * block, one of
    these 14 keys has over block / 14, so only such keys, which are few, are spread to their neighbours.
    """
    counts = exact.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block / 14)
    reached = F.array(F.col("key"), *[F.col("key").bitwiseXOR(F.lit(1 << j)) for j in range(13)])
    looked_up = counts.select(F.explode(reached).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
    return looked_up.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))


def _exact_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seg = _segments(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        keys = [(((np.uint64(i) << np.uint64(13)) | seg[i]) << np.uint64(13)) | seg[(i + 1) % len(seg)] for i in range(len(seg))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64))], ["key"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b): label is the smallest node of its component.

    Alternates large-star and small-star until the edges are stars; each round is written.
    """
    edges = write_shared(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        # Large-star: larger neighbours of u go to the smallest of u and its neighbours.
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        # Small-star: u (the larger end) and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        before, edges = edges, write_shared(small.select("e.u", "e.v").where("u <> v").distinct(), "components")
        forget(before)
        seen = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())


def groups(fingerprinted: DataFrame, doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(fp, component_id, least) of every distinct fingerprint: the smallest doc_id of its component and of itself."""
    reps = write_shared(fingerprinted.groupBy("fp").agg(F.min(doc_id).alias("least")), "simhash-reps")
    return _with_ids(reps, components(links(reps, block)))


def _with_ids(reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(fp, component_id, least, label) of reps (fp, least), given labels (node, label) of those that are linked."""
    joined = reps.join(labels, reps["fp"] == labels["node"], "left").select("fp", "least", "label")
    ids = joined.where("label is not null").groupBy("label").agg(F.min("least").alias("component_id"))
    linked = joined.join(ids, "label", "left")
    return write_shared(linked.select("fp", F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), "least", "label"), "simhash-groups")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row of docs."""
    stored = write_shared(with_fingerprint(docs.select(doc_id, text), text).select(doc_id, "fp"), "simhash")
    found = stored.join(groups(stored, doc_id, block).select("fp", "component_id"), "fp")
    return found.select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _set_pairs(reps: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) of sets (__sid, __fp) that connect all whose fingerprints are within DISTANCE: a forest of them."""
    fps = write_shared(reps.groupBy(F.col("__fp").alias("fp")).agg(F.min("__sid").alias("first"), F.count("*").alias("n")), "similar-fps")
    same = reps.join(fps.where("n > 1"), reps["__fp"] == fps["fp"]).where("__sid <> first").select(F.col("first").alias("a"), F.col("__sid").alias("b"))
    end = lambda c: fps.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    linked = links(fps.select("fp"), block).where("a <> b").join(end("a"), "a").join(end("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return write_shared(linked.union(same), "similar-pairs")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = similar.BLOCK) -> DataFrame:
    """docs with one row of each group that pairs of similarity 0.8 or more connect, found by SimHash and a prefix filter (see similar): the one of the smallest doc_id. Of rows equal in doc_id and set of shingles, and of a group of null ids, one stays: the first by hash of its text."""
    clash = {c: f"{c}_of_input" for c in docs.columns if c.lower() in ("__sid", "__size", "__fp", "__sketch", "__keys", "__row")}
    if clash:
        back = {new: old for old, new in clash.items()}
        return drop_near_duplicates(docs.withColumnsRenamed(clash), text, doc_id, block).withColumnsRenamed(back)
    common, ranks, hot = similar.common(docs, text, block)
    # Rows have a number from here on, as written, so the choice among them is made without their texts.
    stored = write_shared(similar.with_set(docs, common, ranks, majority, text).withColumn("__row", F.monotonically_increasing_id()), "similar-docs")
    ids = write_shared(stored.groupBy("__sid").agg(F.min(doc_id).alias("least"), F.min("__row").alias("__row")), "similar-reps")
    reps = only(stored.select("__row", "__sid", "__size", "__fp", "__sketch", "__keys"), ids.select("__row"), "__row")
    near = similar.confirmed(_set_pairs(reps.select("__sid", "__fp"), block), stored, reps, text)
    labels = components(near.union(similar.links(stored, reps, hot, components(near), text)))
    reps = ids
    found = _with_ids(reps.select(F.col("__sid").alias("fp"), "least"), labels)
    # The set under which a component's document is kept; for groups of null ids, the component's label.
    keep = found.where(F.col("least").eqNullSafe(F.col("component_id"))).groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("fp").alias("sid"), F.min("component_id").alias("keep"))
    # Ids are keys too, so copies of one text are spread.
    named = lambda id_: [F.coalesce(id_.cast("string"), F.lit("")).alias("id"), F.isnull(id_).alias("no_id")]
    rows = stored.select(F.col("__sid").alias("sid"), *named(F.col(f"`{doc_id}`")), F.struct(F.xxhash64(text), "__row").alias("row"))
    keys = ["sid", "id", "no_id"]
    chosen = rows.join(keep.select("sid", *named(F.col("keep"))), keys).groupBy(*keys).agg(F.min("row").alias("row")).select(F.col("row.__row").alias("__row"))
    return only(stored, write_shared(chosen, "similar-kept"), "__row").select(*[F.col(f"`{c}`") for c in docs.columns])
