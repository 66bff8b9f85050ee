"""Packing documents into sequences of a fixed number of tokens, balanced by attention cost.

A document's tokens are cut into full sequences and one rest. Rests gather in a pool; when the
pool is full, or the partition ends, its rests go into as few sequences as hold them: in descending
order each is given to the sequence of lowest cost among those with room for it. The cost of a piece
is LINEAR * n + QUADRATIC * n^2, as attention within a document costs. A rest that fits nowhere is
cut: the lowest-cost sequence with any room takes what it can. So under one sequence of padding is
left for each pool, and one pool for each partition at least.

Pools are bounded and nothing is shuffled: a task needs its partition's documents only, one batch
at a time. Sequence ids are unique: the partition's number and a count within it.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; a null
doc_id is kept as it is; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import bounded, by_size, give_back, trimmed
from .tokenizing import encoder

LENGTH = 1024
#: Rests that one pool holds.
POOL = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_FIELDS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
_OUT_BYTES = 4 << 20


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], size: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (which, start, length, sequence, offset) of rests, each under size, and the number of sequences."""
    count = -(-sum(lengths) // size)
    room, spent = np.full(count, size, np.int64), np.zeros(count)
    todo = [(-n, k, 0) for k, n in enumerate(lengths)]
    heapq.heapify(todo)
    pieces = []
    while todo:
        n, which, start = heapq.heappop(todo)
        n = -n
        fits = room >= n
        if not fits.any():
            fits = room > 0
        s = int(np.where(fits, spent, np.inf).argmin())
        take = min(n, int(room[s]))
        pieces.append((which, start, take, s, size - int(room[s])))
        room[s] -= take
        spent[s] += cost(take)
        if take < n:
            heapq.heappush(todo, (take - n, which, start + take))
    return pieces, count


def pack(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = True, size: int = LENGTH, pool: int = POOL, pieces: int = 0, together: int = 3 << 20, lean: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of docs (doc_id, text).

    ids are little-endian unsigned 32-bit integers. tokenizer: path of a tokenizers file, on each executor. pieces: how many a worker keeps; together: bytes of texts that it encodes at once, about; lean: give back what is free after each batch of pieces, for more time.
    """
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The library is loaded at the first batch, as most of a small cluster's tasks may be empty.
        part, made, waiting, held = TaskContext.get().partitionId() << 40, 0, 0, []
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal made, held
            pieces, count = assign([len(ids) // 4 for _, _, _, ids in held], size)
            for which, start, n, s, offset in pieces:
                doc, at, total, ids = held[which]
                rows.append((doc, at + start, n, total, part | (made + s), offset, ids[4 * start : 4 * (start + n)]))
            made += count
            held = []

        def out() -> pa.RecordBatch:
            nonlocal waiting
            columns = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
            arrays = [pa.array(c, pa.int64() if k < 6 else pa.binary()) for k, c in enumerate(columns)]
            rows.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays(arrays, _FIELDS)

        for b in by_size(batches, 1, together):
            ids, counts = encoder(tokenizer, spaced, pieces=pieces).encode(b.column(1), end_id)
            raw = ids.astype("<u4", copy=False).tobytes()
            ends = np.cumsum(counts)
            for doc, begin, total in zip(b.column(0).to_pylist(), (ends - counts).tolist(), counts.tolist(), strict=True):
                full = total // size
                for k in range(full):
                    at = 4 * (begin + k * size)
                    rows.append((doc, k * size, size, total, part | made, 0, raw[at : at + 4 * size]))
                    made += 1
                waiting += 4 * full * size
                if total > full * size:
                    held.append((doc, full * size, total, raw[4 * (begin + full * size) : 4 * (begin + total)]))
                if len(held) >= pool:
                    waiting += sum(len(h[3]) for h in held)
                    flush()
                if waiting > _OUT_BYTES:
                    yield out()
                    if lean:
                        give_back()
        flush()
        yield out()

    return bounded(docs.select(docs["doc_id"].cast("long"), "text")).mapInArrow(run, _SCHEMA)
