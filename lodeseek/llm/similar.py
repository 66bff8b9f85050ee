"""Pairs of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, none missed.

A text is the set of its distinct shingles, as 64-bit hashes; a text of fewer words is one shingle, one without words
has none. Two sets of similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each, in whatever order
all sets are sorted (prefix filter). Hashes give the order; shingles that a sample of one row in 8 shows to be common
come last, the commonest at the end, so few sets meet under them. The sample decides on work, not on results.

SimHash comes first: fingerprints within a few bits, found as in simhash, are candidates, confirmed on whole sets. That
joins most near copies and their groups get labels. But a similarity of 0.8 does not bound the bits, so the prefix filter
finds the rest, for which only pairs of different labels count.

Sets are dealt by their keys, as key, id and size alone, since most keys have one set only, or sets of sizes too far apart.
Sets under a key that sizes connect, from one to the next, have a name, by which equal ones of several keys become one, as near copies
meet under most of their keys. Those left get their sketch: bit b of it is the parity of the number of hashes ending in b, in twice as many bits as a set has
hashes or more. Sketches differ in at most |A xor B| <= (|A| + |B|) / 9 bits, which with the sizes prunes nearly all that is not
similar. Under a name, sets that candidates connect and that have several labels make a cluster; of it those go on that are in
candidates of different labels. Equal clusters are one, too. A cluster meets with its whole sets in one task, which
gives a link for each label that it joins to another. So no table has more rows than sets under keys, however large a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, by_size, forget, give_back, only, trimmed, without, write_shared
from .tokenizing import encoder

SHINGLE = 5
#: One row in SAMPLE is looked at for common shingles: those in COMMON rows of the sample or more, MOST of them at most.
SAMPLE, COMMON, MOST = 8, 3, 1 << 20
#: Sets of one key that one task is to hold; a commoner key is dealt as pairs of blocks.
BLOCK = 2048
#: Hashes of a cluster that one task is to hold; a larger one is dealt as pairs of blocks.
HELD = 1 << 20
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = found = xxh64_intdigest(word, SHINGLE)
        return found


_words = _Hashes()


def _forget() -> None:
    """Frees the words of a worker, which may go on to other work, and the tokens of work before."""
    _words.clear()
    encoder.cache_clear()
    give_back()


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of text."""
    # On bytes, lower() and split() know ASCII only, as the words of simhash do.
    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        return np.array([_words[b" ".join(words)]] if words else [], np.uint64)
    if len(_words) > 1 << 17:
        _words.clear()
    each = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    mixed = each[:n] * _FACTORS[0]
    for k in range(1, SHINGLE):
        mixed += each[k : k + n] * _FACTORS[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _FACTORS[1]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 5 * both >= 4 * (len(one) + len(other) - both)


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the numbers of hashes that end in each value: twice as many bits as hashes, up to the next power of two, 64 at least."""
    bits = max(64, 1 << max(0, 2 * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(parities: bytes, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(parities, np.uint64).reshape(-1, words), axis=0)


def prefix(hashes: np.ndarray, late: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The hashes under which a set is dealt; late: sorted hashes that come last, in the order of ranks."""
    n = len(hashes)
    if not n:
        return hashes
    if len(late):
        at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
        rank = np.where(late[at] == hashes, ranks[at], 0)
        if rank.any():
            hashes = hashes[np.lexsort((hashes, rank))]
    return hashes[: n + (-4 * n // 5) + 1]


def common(docs: DataFrame, text: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Common shingles, sorted, with their ranks (1: least common), and (key, blocks) of those to deal in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                found = [shingles(t.as_py()) for t in b.column(0).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])
        _forget()

    sample = docs.select(text).where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SAMPLE)) == 0)
    counts = bounded(sample).mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "key").limit(MOST).toArrow()
    keys, n = top["key"].to_numpy().astype(np.int64), top["n"].to_numpy()
    hot = n * SAMPLE > block
    order = np.argsort(keys.view(np.uint64))
    blocks = list(zip(keys[hot].tolist(), (-(-n[hot] * SAMPLE // block)).tolist(), strict=True))
    return keys.view(np.uint64)[order], (len(keys) - np.arange(len(keys)))[order], blocks


def with_set(docs: DataFrame, last: np.ndarray, ranks: np.ndarray, simhash: Callable[[np.ndarray], int], text: str = "text") -> DataFrame:
    """docs with __sid (hash of the set), __size, __fp (simhash of its hashes), __sketch and __keys (its prefix)."""
    from xxhash import xxh64_intdigest

    kept = without(docs, ["__sid", "__size", "__fp", "__sketch", "__keys"])
    at = kept.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((last, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = shared.value
        for b in by_size(batches, at):
            sids, sizes, fps, sketches, keys = [], [], [], [], []
            for t in b.column(at):
                hashes = shingles(t.as_py())
                sids.append(xxh64_intdigest(hashes.tobytes(), SHINGLE))
                sizes.append(len(hashes))
                fps.append(simhash(hashes))
                sketches.append(sketch(hashes))
                keys.append(prefix(hashes, late, rank).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.array([], np.int64), *keys])))
            sid, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sids, fps))
            yield pa.RecordBatch.from_arrays([*b.columns, sid, pa.array(sizes, pa.int32()), fp, pa.array(sketches, pa.binary()), lists], [*b.schema.names, "__sid", "__size", "__fp", "__sketch", "__keys"])
        _forget()

    empty = [F.lit(0).cast("long").alias("__sid"), F.lit(0).alias("__size"), F.lit(0).cast("long").alias("__fp"), F.lit(b"").alias("__sketch"), F.expr("cast(array() as array<bigint>)").alias("__keys")]
    return bounded(kept).mapInArrow(run, kept.select("*", *empty).schema)


class _Group:
    """Sets that meet under a key, compared by size and sketch."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes]) -> None:
        self.sizes, self.sketches = sizes, sketches
        self.words = np.array([len(x) // 8 for x in sketches])
        # By width: the sets with such a sketch and those with twice as many bits, folded. Similar sets differ by no more.
        self.tables = {}
        for w in np.unique(self.words).tolist():
            own, wide = np.flatnonzero(self.words == w), np.flatnonzero(self.words == 2 * w)
            rows = [np.frombuffer(sketches[k], np.uint64) for k in own] + [_folded(sketches[k], w) for k in wide]
            self.tables[w] = np.concatenate([own, wide]), len(own), np.stack(rows)

    def near(self, k: int, among: np.ndarray) -> np.ndarray:
        """Those of among (a mask) that sizes and sketches let be similar to k, in order."""
        one, found = int(self.sizes[k]), []
        for w in (int(self.words[k]), int(self.words[k]) // 2):
            if w not in self.tables:
                continue
            which, own, rows = self.tables[w]
            if w < self.words[k]:
                which, rows = which[:own], rows[:own]
            many = self.sizes[which]
            fits = among[which] & (5 * np.minimum(one, many) >= 4 * np.maximum(one, many))
            which, rows, many = which[fits], rows[fits], many[fits]
            differ = np.bitwise_count(rows ^ _folded(self.sketches[k], w)).sum(axis=1, dtype=np.int64)
            found.append(which[9 * differ <= one + many])
        return np.sort(np.concatenate(found))

    def forest(self) -> list[tuple[int, int]]:
        open_, links = np.ones(len(self.sizes), bool), []
        for start in range(len(self.sizes)):
            todo = [start] if open_[start] else []
            open_[start] = False
            while todo and open_.any():
                k = todo.pop()
                found = self.near(k, open_).tolist()
                open_[found] = False
                links += [(k, x) for x in found]
                todo += found[::-1]
        return links

    def looked_up(self, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Sets, each with candidates of other labels among those before it. Sets of the commonest label are only looked up.

        labels may change on the way.
        """
        names, counts = np.unique(labels, return_counts=True)
        done = labels == names[np.argmax(counts)]
        for k in np.flatnonzero(~done).tolist():
            found = self.near(k, done & (labels != labels[k]))
            if len(found):
                yield k, found
            done[k] = True

    def across(self, labels: np.ndarray) -> list[tuple[int, int]]:
        """Candidates with different labels."""
        return [(k, x) for k, found in self.looked_up(labels) for x in found.tolist()]

    def clusters(self, labels: np.ndarray) -> list[np.ndarray]:
        """Sets that are in candidates of different labels, apart where no candidates connect them."""
        root = np.arange(len(self.sizes))
        for k, x in self.forest():
            root[x] = root[k]
        found = []
        order = np.argsort(root, kind="stable")
        for which in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            if len(which) > 1 and (labels[which] != labels[which[0]]).any():
                part = self if len(which) == len(root) else _Group(self.sizes[which], [self.sketches[k] for k in which.tolist()])
                touched = np.zeros(len(which), bool)
                for k, others in part.looked_up(labels[which]):
                    touched[k] = touched[others] = True
                if touched.any():
                    found.append(which[touched])
        return found


def _walk(of: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls of on whole groups, with where each begins and ends: rows with equal first two columns (key, cell), by which they are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that is open

        def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.concat_batches(parts)
            key, cell = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
            return of(rows, begin, np.append(begin[1:], len(key)))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, cell = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if held and (held[-1].column(0)[-1].as_py() != key[0] or held[-1].column(1)[-1].as_py() != cell[0]):
                yield close(held)
                held = []
            same = (key == key[-1]) & (cell == cell[-1])
            cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if cut:
                yield close([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield close(held)

    return trimmed(run)


def _several(rows: pa.RecordBatch, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows (key, sid) of sets that sizes let be similar to the next or the last of their group, in order of sizes; key: a hash of all such sets from one to the next."""
    sid, sizes = rows.column(2).to_numpy(zero_copy_only=False), rows.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
    beside = 5 * sizes[:-1] >= 4 * sizes[1:]
    beside[begin[1:] - 1] = False
    first = np.flatnonzero(np.append(True, ~beside))
    mixed = sid.view(np.uint64) * _FACTORS[0]
    mixed ^= mixed >> np.uint64(32)
    name = np.add.reduceat(mixed * _FACTORS[1], first) * _FACTORS[2]
    many = np.diff(first, append=len(sid))
    name, some = np.repeat(name.view(np.int64), many), np.repeat(many > 1, many)
    return pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(sid[some])], ["key", "sid"])


def _blocks(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """All of a cluster, or pairs of blocks of it, each of about `most` hashes."""
    ends = np.cumsum(sizes)
    block = ends // max(1, most // 2)
    blocks = [np.flatnonzero(block == k) for k in np.unique(block)]
    if ends[-1] <= most or len(blocks) < 3:
        return [np.arange(len(sizes))]
    return [np.concatenate([x, y]) for k, x in enumerate(blocks) for y in blocks[k + 1 :]]


def _open(rows: pa.RecordBatch, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Clusters of each group, as rows (cluster, part, sid, label)."""
    from xxhash import xxh64_intdigest

    sid, sizes, labels = (rows.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 5))
    sizes, names, which = sizes.astype(np.int64), [], []
    some = np.minimum.reduceat(labels, begin) < np.maximum.reduceat(labels, begin)
    for b, e in zip(begin[some].tolist(), end[some].tolist(), strict=True):
        for cluster in _Group(sizes[b:e], rows.column(4).slice(b, e - b).to_pylist()).clusters(labels[b:e]):
            cluster = cluster[np.argsort(sid[b:e][cluster])] + b
            for part in _blocks(sizes[cluster], HELD):
                part = cluster[part]
                names.append(np.full(len(part), xxh64_intdigest(np.sort(sid[part]).tobytes(), SHINGLE), np.uint64))
                which.append(part)
    at = np.concatenate([np.zeros(0, np.int64), *which])
    name = np.concatenate([np.zeros(0, np.uint64), *names]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.zeros(len(at), np.int32)), pa.array(sid[at]), pa.array(labels[at])], ["key", "cell", "sid", "label"])


def joining(sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Similar pairs that connect all labels (changed on the way) that similar pairs of sets connect."""
    group = _Group(np.array([len(x) for x in sets]), [sketch(x) for x in sets])
    found = []
    for k, others in group.looked_up(labels):
        # Of each other label, the first set that is similar.
        parts = [sets[x] for x in others.tolist()]
        at = np.minimum(np.searchsorted(sets[k], every := np.concatenate(parts)), len(sets[k]) - 1)
        ends = np.cumsum([len(x) for x in parts])
        both = np.diff(np.append(0, np.cumsum(sets[k][at] == every))[ends], prepend=0)
        good = others[5 * both >= 4 * (len(sets[k]) + np.diff(ends, prepend=0) - both)]
        if len(good):
            names, first = np.unique(labels[good], return_index=True)
            found += [(k, x) for x in good[first].tolist()]
            labels[np.isin(labels, names)] = labels[k]
    return found


def _joined(rows: pa.RecordBatch, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) of each cluster."""
    sid, labels, links = rows.column(2).to_numpy(zero_copy_only=False), rows.column(3).to_numpy(zero_copy_only=False), []
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(4).slice(b, e - b)]
        links += [(b + k, b + x) for k, x in joining(sets, labels[b:e].copy())]
    pairs = sid[np.array(links, np.int64).reshape(-1, 2)]
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])


def _sets(ids: DataFrame, stored: DataFrame, reps: DataFrame, text: str) -> DataFrame:
    """(sid, hashes) of the sets in ids (__sid), written."""
    rows = write_shared(only(reps.select("__sid", "__row"), write_shared(ids.distinct(), "similar-ids"), "__sid").select("__row"), "similar-rows")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["sid", "hashes"])
        _forget()

    texts = only(stored.select("__row", "__sid", text), rows, "__row").select("__sid", text)
    return write_shared(bounded(texts).mapInArrow(hashed, "sid long, hashes binary"), "similar-sets")


def confirmed(pairs: DataFrame, stored: DataFrame, reps: DataFrame, text: str = "text") -> DataFrame:
    """Those of pairs (a, b) of sets whose similarity is 0.8 or more, written."""

    @trimmed
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in two)) for two in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("__sid")), stored, reps, text)
    one, other = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))
    found = write_shared(bounded(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y")).mapInArrow(confirm, "a long, b long"), "similar-links")
    forget(sets)
    return found


def links(stored: DataFrame, reps: DataFrame, hot: list[tuple[int, int]], labels: DataFrame, text: str = "text") -> DataFrame:
    """Pairs (a, b) of set ids, all similar, that together with labels (node, label) connect all sets that similar pairs connect.

    stored: rows with __row, __sid and text; reps: (__row, __sid, __size, __sketch, __keys) of the distinct sets.
    """
    spark = stored.sparkSession
    keyed = reps.select(F.explode("__keys").alias("key"), F.lit(0).alias("cell"), F.col("__sid").alias("sid"), F.col("__size").alias("size"))
    if hot:
        blocks = spark.createDataFrame(hot, "key long, blocks int")
        mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
        # Block x and block y >= x meet in cell (x, y).
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.least(y, mine) * F.col("blocks") + F.greatest(y, mine))
        keyed = keyed.join(F.broadcast(blocks), "key", "left")
        keyed = keyed.select("key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(cells)).alias("cell"), "sid", "size")
    dealt = lambda rows, *order: bounded(rows).repartition("key", "cell").sortWithinPartitions("key", "cell", *order, "sid")
    # A set stands under few keys, so rows are even by sid, as the join wants them, too.
    several = dealt(keyed, "size").mapInArrow(_walk(_several), "key long, sid long").repartition("sid").distinct()
    named = reps.select(F.col("__sid").alias("sid"), F.col("__size").alias("size"), F.col("__sketch").alias("sketch")).join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    met = several.join(named, "sid").select("key", F.lit(0).alias("cell"), "sid", "size", "sketch", F.coalesce("label", "sid").alias("label"))
    left = write_shared(dealt(met).mapInArrow(_walk(_open), "key long, cell int, sid long, label long").distinct(), "similar-open")
    sets = _sets(left.select(F.col("sid").alias("__sid")), stored, reps, text)
    whole = dealt(left.join(sets, "sid").select("key", "cell", "sid", "label", "hashes"))
    found = write_shared(whole.mapInArrow(_walk(_joined), "a long, b long").distinct(), "similar-links")
    forget(sets)
    forget(left)
    return found
