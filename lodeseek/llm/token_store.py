"""Token ids as compressed binary shards: Re-Pair grammars with random access.

Documents are dealt by range of doc_id and sorted, and each task cuts its range into shards of
about SHARD tokens (whole documents). In a shard, frequent pairs of neighbouring ids are replaced
by new symbols, round after round until no pair is frequent (a round replaces many pairs at once, left
to right where they overlap), never across documents. The shard stores each rule's two symbols and its expansion's
length, so any document, or any part of it, is decoded without the rest.

File format. A store is a Parquet table of shards: part and shard (their order is that of doc_id),
n_docs, n_tokens, and blob:

    magic "LSRP", version, n_docs, n_rules, n_symbols, n_alphabet, bytes of a symbol   7 x u32
    doc_id i64 x n_docs, null u8 x n_docs (1: the id is null)
    tokens u32 x n_docs, symbols u32 x n_docs (of each document)
    alphabet u32 x n_alphabet (the ids that symbols 0, 1, ... stand for), length u32 x n_rules
    left, right symbol x n_rules
    symbol x n_symbols

all little-endian, a symbol in 2, 3 or 4 bytes as the shard's symbols need. Spark commits whole Parquet files, so a lost executor leaves no half shard.

Defined results: a null or empty text is its end id alone; equal doc_ids are in order of their
texts' hashes; null doc_ids come first; other columns are ignored; an empty table is an empty store.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, by_size
from .tokenizing import encoder

MAGIC = b"LSRP"
#: Tokens of a shard, about.
SHARD = 2_000_000
#: A pair is replaced from so many occurrences on; a rule takes about as much room as it saves there.
LEAST = 8
_HEAD = struct.Struct("<4s6I")


class Grammar(NamedTuple):
    """symbols of all documents, how many each document has, and the rules; symbols under len(alphabet) are ids of the alphabet."""

    symbols: np.ndarray
    per_doc: np.ndarray
    alphabet: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray


def _sorted(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """keys (64-bit numbers of so many bits) sorted, and where each was; those alike in any order."""
    room = max(len(keys) - 1, 1).bit_length()
    if bits + room > 64:
        places = np.argsort(keys)
        return keys[places], places
    # Key and place fit into one number, and to sort numbers is some times faster than to sort places by keys.
    both = keys << np.uint64(room)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return both >> np.uint64(room), (both & np.uint64((1 << room) - 1)).view(np.int64)


def compress(ids: np.ndarray, tokens: np.ndarray, least: int = LEAST) -> Grammar:
    """Re-Pair of the documents in ids (tokens of each, one at least): rounds go on until no pair occurs `least` times.

    All pairs that are frequent enough are replaced in one round; where two overlap, the first of them. What a round leaves is less
    frequent, so the next one looks at pairs with a new symbol only.
    """
    alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    local = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint32)
    local[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    seq, last = local[ids], np.zeros(len(ids), bool)
    last[np.cumsum(tokens) - 1] = True  # of a document
    left, right, size = [], [], np.ones(len(alphabet), np.uint32)
    where = np.flatnonzero(~last)
    while len(where):
        wide = max(len(size) - 1, 1).bit_length()
        shift, low = np.uint64(wide), np.uint64((1 << wide) - 1)
        keys = seq[where].astype(np.uint64)
        keys <<= shift
        keys |= seq[where + 1]
        ordered, places = _sorted(keys, 2 * wide)
        cuts = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True))
        often = np.diff(cuts, prepend=-1)
        pairs = ordered[cuts[often >= least]]
        if not len(pairs):
            break
        at = np.full(len(keys), -1, np.int32)
        at[places[np.repeat(often >= least, often)]] = np.repeat(np.arange(len(pairs), dtype=np.int32), often[often >= least])
        hit = at >= 0
        where, at = where[hit], at[hit]
        # Of a run of overlapping matches every other one is replaced.
        begins = np.append(True, np.diff(where) > 1)
        order = np.arange(len(where))
        taken = (order - np.maximum.accumulate(np.where(begins, order, 0))) & 1 == 0
        where, at = where[taken], at[taken]
        used = np.bincount(at, minlength=len(pairs)) > 1
        where, at = where[used[at]], at[used[at]]
        a, b = (pairs[used] >> shift).astype(np.uint32), (pairs[used] & low).astype(np.uint32)
        seq[where] = (len(size) - 1 + np.cumsum(used)).astype(np.uint32)[at]
        left, right, size = [*left, a], [*right, b], np.append(size, size[a] + size[b])
        last[where] = last[where + 1]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, last = seq[keep], last[keep]
        fresh, beside = where - np.arange(len(where)), np.zeros(len(seq) + 1, bool)
        beside[fresh] = beside[fresh - 1] = True  # before the first symbol is the spare place at the end
        where = np.flatnonzero(beside[:-1] & ~last)
    join = lambda x: np.concatenate([np.zeros(0, np.uint32), *x])
    return Grammar(seq, np.diff(np.flatnonzero(last) + 1, prepend=0), alphabet, join(left), join(right), size[len(alphabet) :])


def unfold(alphabet: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each symbol, where its ids begin in a table and how many there are; and the table. Rules unfold level by level."""
    terminals = len(alphabet)
    size = np.concatenate([np.ones(terminals, np.int64), length.astype(np.int64)])
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint32)
    place, current = begin, np.arange(len(size))
    while len(current):
        leaf = current < terminals
        out[place[leaf]] = alphabet[current[leaf]]
        rule, at = current[~leaf] - terminals, place[~leaf]
        a, b = left[rule].astype(np.int64), right[rule].astype(np.int64)
        place, current = np.concatenate([at, at + size[a]]), np.concatenate([a, b])
    return begin, size, out


def expand(symbols: np.ndarray, rules: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of symbols: each takes as many places as its expansion is long and copies them from the table."""
    begin, size, ids = rules
    spans = size[symbols]
    return ids[np.repeat(begin[symbols] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))]


def _packed(symbols: np.ndarray, width: int) -> bytes:
    """The low bytes of symbols."""
    return np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.reshape(-1).view("<u4")


def to_blob(doc_ids: list[int | None], tokens: np.ndarray, ids: np.ndarray) -> bytes:
    g = compress(ids, tokens)
    width = next(w for w in (2, 3, 4) if len(g.alphabet) + len(g.left) <= 1 << (8 * w))
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [
        _HEAD.pack(MAGIC, 2, len(doc_ids), len(g.left), len(g.symbols), len(g.alphabet), width),
        known, np.array([d is None for d in doc_ids], "u1"), tokens.astype("<u4"), g.per_doc.astype("<u4"), g.alphabet.astype("<u4"),
        g.length.astype("<u4"), _packed(g.left, width), _packed(g.right, width), _packed(g.symbols, width),
    ]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Shard:
    """A blob, opened. decode(k) gives document k without decoding others."""

    def __init__(self, blob: bytes) -> None:
        magic, version, docs, rules, count, terminals, width = _HEAD.unpack_from(blob)
        if magic != MAGIC or version != 2:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(blob, kind, n, at)
            at += got.nbytes
            return got

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.tokens, per_doc = take("<u4", docs), take("<u4", docs)
        self.alphabet, self.length = take("<u4", terminals), take("<u4", rules)
        self.left, self.right, self.symbols = (_unpacked(take("u1", n * width), width) for n in (rules, rules, count))
        self.ends = np.cumsum(per_doc, dtype=np.int64)
        self.rules = unfold(self.alphabet, self.left, self.right, self.length)

    def decode(self, k: int) -> np.ndarray:
        return expand(self.symbols[(self.ends[k - 1] if k else 0) : self.ends[k]], self.rules)

    def decode_all(self) -> np.ndarray:
        return expand(self.symbols, self.rules)

    def decode_range(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k: only symbols whose expansion reaches into the range are unfolded."""
        symbols = self.symbols[(self.ends[k - 1] if k else 0) : self.ends[k]]
        ends = np.cumsum(self.rules[1][symbols])
        first, after = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        begin = int(ends[first - 1]) if first else 0
        return expand(symbols[first:after], self.rules)[start - begin : max(start, stop) - begin]


def shards(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = False, shard: int = SHARD) -> DataFrame:
    """The store's rows (part, shard, n_docs, n_tokens, blob) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        tokens: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal number
            sizes, joined = np.concatenate(tokens), np.concatenate(ids)
            row = [[part], [number], [len(names)], [len(joined)], [to_blob(names, sizes, joined)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names.clear()
            ids.clear()
            tokens.clear()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "shard", "n_docs", "n_tokens", "blob"])

        size = 0
        for b in by_size(batches, 1):
            found, counts = encoder(tokenizer, spaced).encode(b.column(1), end_id)
            ends, doc_ids, lo = np.cumsum(counts), b.column(0).to_pylist(), 0
            while lo < len(counts):  # documents up to the one that fills the shard
                begin = int(ends[lo - 1]) if lo else 0
                hi = min(int(np.searchsorted(ends, begin + shard - size)) + 1, len(counts))
                names += doc_ids[lo:hi]
                ids.append(found[begin : ends[hi - 1]])
                tokens.append(counts[lo:hi])
                size, lo = size + int(ends[hi - 1]) - begin, hi
                if size >= shard:
                    yield out()
                    size = 0
        if names:
            yield out()

    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return bounded(dealt).mapInArrow(run, "part int, shard int, n_docs long, n_tokens long, blob binary")


def read_documents(store: DataFrame) -> DataFrame:
    """Each document of a store: part, shard, doc_id, start (ids before it in its shard), n_tokens, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                opened = Shard(blob.as_py())
                ids = opened.decode_all().astype("<u4")
                ends = np.cumsum(opened.tokens, dtype=np.int64)
                for lo in range(0, len(ends), 1024):
                    hi = min(lo + 1024, len(ends))
                    starts = ends[lo:hi] - opened.tokens[lo:hi]
                    raw = pa.py_buffer(ids[starts[0] : ends[hi - 1]].tobytes())
                    offsets = pa.py_buffer((4 * np.append(starts, ends[hi - 1]) - 4 * starts[0]).astype("<i4").tobytes())
                    body = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, offsets, raw])
                    arrays = [pa.array([part] * (hi - lo), pa.int32()), pa.array([number] * (hi - lo), pa.int32()), pa.array(opened.doc_ids[lo:hi], pa.int64()), pa.array(starts), pa.array(opened.tokens[lo:hi].astype(np.int64)), body]
                    yield pa.RecordBatch.from_arrays(arrays, ["part", "shard", "doc_id", "start", "n_tokens", "ids"])

    return store.select("part", "shard", "blob").mapInArrow(run, "part int, shard int, doc_id long, start long, n_tokens long, ids binary")


def shard_starts(store: DataFrame) -> DataFrame:
    """part, shard, before: ids of all shards before it. Parts (as many as tasks wrote) are summed first."""
    sizes = store.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_part"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("before_shard"))
    return sizes.join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("before_shard")).alias("before"))
