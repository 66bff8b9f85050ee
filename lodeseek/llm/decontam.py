"""Benchmark decontamination: an FM-index per training shard, searched for benchmark windows.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A
window is 8 consecutive words of an item, or the whole item if it has fewer.

A task gathers documents until they make a shard and indexes its words. Only words of the
benchmark can occur in a window, so runs of them shorter than the shortest window are left out and
others are set apart by separators; this loses no occurrence. Over the rest it builds the suffix
array (prefix doubling), its Burrows-Wheeler transform and a wavelet matrix of the transform. All
windows are searched backwards at once, two ranks a step; occurrences are located by walking back to
a sampled suffix position (every SAMPLE-th of a run, and each run's start). Occurrences become hit
words and, where they touch or overlap, one removal span.

The benchmark goes to the executors in blocks of about BLOCK_BYTES, one pass over the documents for each; items longer than
that are cut, with a window's overlap. Windows are made in the tasks. Several blocks are done one after another, each writing what
it found to the shared folder by a digest of the text, and documents get what all blocks found by a join on that digest. So the
driver and a worker hold one block at a time, however large the benchmark; passes grow with it.

Defined results: null texts, of documents and of items, have no words; items without id or words
are left out; items that share an id are one item; repeated rows get equal results; columns of the
input with names of the result's are replaced; empty tables give no hits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, by_size, shared_dir, trimmed, without, write_shared

WINDOW = 8
#: Words of a shard, about; documents are whole.
SHARD_WORDS = 2_000_000
SAMPLE = 16
BLOCK_BYTES = 4 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PLACED = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = ["n_words", "n_hit", "item_ids", "spans"]
_TYPES = "n_words long, n_hit long, item_ids array<long>, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # of bytes, lower() changes A-Z only


class Windows:
    """Windows of items as rows of word numbers (from 1; 0 pads at the front), and which items have them."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                mine = np.lib.stride_tricks.sliding_window_view(ids, window) if len(ids) >= window else np.pad(ids, (window - len(ids), 0))[None]
                rows.append(mine)
                owners.append(np.full(len(mine), item, np.int64))
        self.rows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.rows > 0).sum(axis=1)
        owned = np.unique(np.stack([which.reshape(-1).astype(np.int64), np.concatenate(owners)], axis=1), axis=0)
        self.items, self.first = owned[:, 1], np.searchsorted(owned[:, 0], np.arange(len(self.rows) + 1))
        self.shortest = int(self.lengths.min()) if len(self.rows) else 0


#: In a worker: windows of the block at hand.
_HELD: dict[str, Windows] = {}


def _windows(token: str, sent: Broadcast, window: int) -> Windows:
    """Of the items sent, made once in each worker."""
    if token not in _HELD:
        _HELD.clear()
        _HELD[token] = Windows(sent.value, window)
    return _HELD[token]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; symbols: non-negative. The end of the text sorts first."""
    n = len(symbols)
    rank, step = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 2) + behind
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Of runs of words (numbers from 1), with separators (0) between; a search never crosses one."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        """text ends with a separator. sigma: the largest number."""
        separators = text == 0
        n = len(text)
        # Each separator sorts by its place, so no two suffixes share more than a run.
        unlike = np.where(separators, np.cumsum(separators) - 1, text + int(separators.sum()))
        order = suffix_array(unlike)
        self.bwt = text[order - 1]
        run_start = np.maximum.accumulate(np.where(np.concatenate([[True], separators[:-1]]), np.arange(n), 0))
        sampled = (order - run_start[order]) % SAMPLE == 0
        self.sampled, self.sample_of, self.samples = sampled, np.cumsum(sampled) - 1, order[sampled]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.levels = max(1, sigma.bit_length())
        self.ones, self.zeros, rows = [], [], self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (rows >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(n - self.ones[-1][-1]))
            rows = np.concatenate([rows[bit == 0], rows[bit == 1]])

    def ranks(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often symbol is among the first so many of the transform, for each of ends."""
        at = [np.zeros(len(symbol), np.int64), *ends]
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            counts = [self.ones[k][x] for x in at]
            at = [np.where(one, self.zeros[k] + c, x - c) for x, c in zip(at, counts, strict=True)]
        return [x - at[0] for x in at[1:]]

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, row of the index) of each occurrence."""
        which = np.arange(len(windows.rows))
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.bwt), np.int64)
        for column in range(windows.rows.shape[1] - 1, -1, -1):
            symbol = windows.rows[which, column]
            a, b = self.ranks(symbol, low, high)
            step = symbol > 0  # padding: the window is already whole
            low, high = np.where(step, self.before[symbol] + a, low), np.where(step, self.before[symbol] + b, high)
            there = high > low
            which, low, high = which[there], low[there], high[there]
        counts = high - low
        inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(which, counts), np.repeat(low, counts) + inner

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the index."""
        out, todo, rows, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.samples[self.sample_of[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            symbol = self.bwt[rows]
            rows, steps = self.before[symbol] + self.ranks(symbol, rows)[0], steps + 1
        return out


def occurrences(numbers: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of all occurrences in numbers (0: not a word of the benchmark, or between documents)."""
    none = np.zeros(0, np.int64)
    if not windows.shortest or not len(numbers):
        return none, none
    known = np.concatenate([[False], numbers > 0, [False]])
    begin, end = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(~known[1:] & known[:-1])
    long_enough = end - begin >= windows.shortest
    begin, end = begin[long_enough], end[long_enough]
    if not len(begin):
        return none, none
    size = end - begin + 1  # and a separator
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    text = np.append(numbers, 0)[place]
    text[np.cumsum(size) - 1] = 0
    index = FMIndex(text, len(windows.vocabulary))
    which, rows = index.search(windows)
    return which, place[index.locate(rows)]


def _results(texts: list[str | None], numbers: list[np.ndarray], windows: Windows) -> list[tuple[int, int, list[int], list[dict[str, int]]]]:
    """Of each document of a shard: n_words, n_hit, item_ids, spans."""
    sizes = np.array([len(x) + 1 for x in numbers])
    first = np.cumsum(sizes) - sizes
    joined = np.concatenate([y for x in numbers for y in (x, np.zeros(1, np.int64))]) if numbers else np.zeros(0, np.int64)
    which, at = occurrences(joined, windows)
    change = np.zeros(len(joined) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + windows.lengths[which], -1)
    hit = np.cumsum(change)[:-1] > 0
    owned = windows.first[which + 1] - windows.first[which]
    inner = np.arange(int(owned.sum())) - np.repeat(np.cumsum(owned) - owned, owned)
    doc = np.repeat(np.searchsorted(first, at, "right") - 1, owned)
    item = windows.items[np.repeat(windows.first[which], owned) + inner] if len(which) else np.zeros(0, np.int64)
    found: dict[int, set[int]] = {}
    for d, i in set(zip(doc.tolist(), item.tolist(), strict=True)):
        found.setdefault(d, set()).add(i)
    out = []
    for d, (text, x) in enumerate(zip(texts, numbers, strict=True)):
        if d not in found:
            out.append((len(x), 0, [], []))
            continue
        mine = np.concatenate([[False], hit[first[d] : first[d] + len(x)], [False]])
        begin, end = np.flatnonzero(mine[1:] & ~mine[:-1]), np.flatnonzero(~mine[1:] & mine[:-1])
        placed = [m.span() for m in _PLACED.finditer(text or "")]
        spans = [{"start": placed[a][0], "end": placed[b - 1][1]} for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        out.append((len(x), int(mine.sum()), sorted(found[d]), spans))
    return out


def _pass(docs: DataFrame, items: list[tuple[int, str]], text: str, keep: list[str], window: int, shard_words: int) -> DataFrame:
    sent, token = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    at = docs.columns.index(text)
    kept = [docs.columns.index(c) for c in keep]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        texts: list[str | None] = []
        numbers: list[np.ndarray] = []
        windows = _windows(token, sent, window)
        get = windows.vocabulary.get

        def out() -> Iterator[pa.RecordBatch]:
            done = 0
            found = _results(texts, numbers, windows)
            for b in parts:
                mine = found[done : done + b.num_rows]
                done += b.num_rows
                columns = [pa.array([r[k] for r in mine], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), _SPANS))]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], *columns], [*keep, *RESULT])
            parts.clear()
            texts.clear()
            numbers.clear()

        size = 0
        for b in by_size(batches, at):
            parts.append(b)
            for t in b.column(at).to_pylist():
                ids = [get(w, 0) for w in words_of(t)]
                numbers.append(np.array(ids, np.int64))
                texts.append(t)
                size += len(ids)
            if size >= shard_words:
                yield from out()
                size = 0
        yield from out()

    fields = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    added = docs.sparkSession.createDataFrame([], _TYPES).schema
    return bounded(docs).mapInArrow(run, type(fields)(fields.fields + added.fields))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (columns keep, all by default) with n_words, n_hit, item_ids (ascending) and removal spans (code points, end exclusive).

    benchmark: item_id, text.
    """
    docs = without(docs, RESULT)
    keep = docs.columns if keep is None else keep
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size, longest = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size // block_bytes))
    if blocks == 1:
        return _pass(docs, sorted((r[0], r[1]) for r in items.collect()), text, keep, window, shard_words)
    pieces = items if longest <= block_bytes else bounded(items).mapInArrow(_cut(block_bytes, window), "item_id long, text string")
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")
    path = f"{shared_dir(docs.sparkSession)}/benchmark-{uuid.uuid4().hex}"
    pieces.withColumn("block", part).write.partitionBy("block").parquet(path)
    stored, found = docs.sparkSession.read.schema("item_id long, text string, block int").parquet(path), []
    digest = F.md5(F.col(text).cast("binary"))
    for k in range(blocks):
        rows = sorted((r[0], r[1]) for r in stored.where(F.col("block") == k).select("item_id", "text").collect())
        if rows:
            mine = _pass(docs.select(text), rows, text, [text], window, shard_words).where(F.size("item_ids") > 0)
            found.append(write_shared(mine.select(digest.alias("digest"), "item_ids", "spans").dropDuplicates(["digest"]), "leaks"))
    return _merged(docs, found, digest, text, keep)


def _cut(most: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (item_id, text) whose texts have most bytes or less, about, and all windows of the longer ones among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(text.encode()) <= most:
                    rows.append((item, text))
                    continue
                words = words_of(text)
                ends = np.cumsum([len(w) + 1 for w in words])
                lo = 0
                while lo < len(words):
                    before = int(ends[lo - 1]) if lo else 0
                    hi = max(lo + window, int(np.searchsorted(ends, before + most, "right")))
                    rows.append((item, b" ".join(words[lo:hi]).decode("utf-8", "surrogatepass")))
                    if hi >= len(words):
                        break
                    lo = hi - window + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["item_id", "text"])

    return run


def _merged(docs: DataFrame, found: list[DataFrame], digest: F.Column, text: str, keep: list[str]) -> DataFrame:
    """Results of several blocks as one: spans that overlap become one, and hit words are counted in them."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def add(done: F.Column, s: F.Column) -> F.Column:
        top = F.try_element_at(done, F.lit(-1))
        joins = s["start"] <= top["end"]
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end"))))
        return F.when(joins, longer).otherwise(F.concat(done, F.array(s)))

    # A text has one row of each block at most.
    each = reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], f"digest string, {_TYPES.split(', ', 2)[2]}")
    merged = each.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    merged = merged.select(F.col("digest").alias("__leaks_digest"), F.col("item_ids").alias("__leaks_items"), F.aggregate("spans", empty, add).alias("__leaks_spans"))
    joined = docs.withColumn("__leaks_key", digest).join(merged, F.col("__leaks_key") == F.col("__leaks_digest"), "left")
    spans = F.coalesce("__leaks_spans", empty)
    words = lambda t: F.regexp_count(t, F.lit(_PLACED.pattern)).cast("long")
    covered = F.transform(spans, lambda s: words(F.substring(F.col(text), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    hits = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.coalesce("__leaks_items", F.expr("cast(array() as array<bigint>)"))
    return joined.select(*[F.col(f"`{c}`") for c in keep], words(F.coalesce(F.col(text), F.lit(""))).alias("n_words"), hits.alias("n_hit"), ids.alias("item_ids"), spans.alias("spans"))


def cut_spans(text: F.Column, spans: F.Column) -> F.Column:
    """text without its spans (ascending, apart); null stays null."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda z: F.substring(text, (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int")))
    return F.when(text.isNotNull(), F.array_join(pieces, ""))
