"""Packing of token streams into windows by multiway Karmarkar-Karp differencing.

Each task reads its documents in order and closes a block when their left-over pieces fill
BLOCK_WINDOWS windows. A document gives full windows of its own and a rest, cut into items of at
most ITEM tokens. The items of a block are differenced: the two partial partitions with the largest
spread are merged, largest part against smallest, until one partition into k near-equal windows is
left; k starts at the least count that could hold the tokens and rises while a window exceeds the
capacity. Nothing is shuffled, and memory is bounded by one block and one document.

Defined results: a null or empty text is the end id alone; every id is in exactly one piece;
repeated rows are packed each for itself; texts of any length are encoded whole, their first ids fill
sequences of their own; rests of equal size go in the order of their task; an empty table gives no piece.
Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import small_batches, with_ids

CAPACITY = 2048
ITEM = 512
BLOCK_WINDOWS = 128
END_ID = 1


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k parts of near-equal sums, by the differencing method."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]  # spread, tie, (sum, members) from the largest sum
    if k > 1:
        heapq.heapify(heap)
        while len(heap) > 1:
            _, tie, a = heapq.heappop(heap)
            _, _, b = heapq.heappop(heap)
            over = len(a) + len(b) - k
            if over <= 0:
                merged = a + b
            else:
                met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[-over:], reversed(b[-over:]), strict=True)]
                merged = a[:-over] + b[:-over] + met
            merged.sort(key=lambda x: -x[0])
            low = merged[-1][0] if len(merged) == k else 0
            heapq.heappush(heap, (low - merged[0][0], tie, merged))
        parts = [x[1] for x in heap[0][2]] if heap else []
    else:
        parts = [heap[0][2][0][1]] if heap else []
        for x in heap[1:]:
            parts[0] = (parts[0], x[2][0][1])
    out = []
    for p in parts:
        members, stack = [], [p]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                members.append(x)
        out.append(sorted(members))
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Parts of at most capacity each; their count rises until that holds."""
    k = -(-sum(sizes) // capacity)
    while True:
        parts = difference(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += 1


def _task(encode: Callable[[list[str]], list[np.ndarray]], rows: Iterator[tuple], capacity: int, item: int, block: int) -> Iterator[tuple]:
    """(doc_id, start, length, ids, doc_tokens, sequence, offset) of one task's rows."""
    sequence, items, held = 0, [], 0

    def close():
        nonlocal sequence, items, held
        for part in windows([len(x[2]) for x in items], capacity):
            offset = 0
            for i in part:
                d, start, ids, total = items[i]
                yield d, start, len(ids), ids.tobytes(), total, sequence, offset
                offset += len(ids)
            sequence += 1
        items, held = [], 0

    for doc_ids, texts in rows:
        for d, ids in zip(doc_ids, encode(texts), strict=True):
            ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
            n = len(ids)
            full = n // capacity * capacity
            for a in range(0, full, capacity):
                yield d, a, capacity, ids[a : a + capacity].tobytes(), n, sequence, 0
                sequence += 1
            for a in range(full, n, item):
                items.append((d, a, ids[a : a + item], n))
            held += n - full
            if held >= block * capacity:
                yield from close()
    if items:
        yield from close()


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, item: int = ITEM, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per piece; ids holds its token ids as little-endian unsigned 32-bit numbers.

    sequence_id has the task's partition in its high bits. Which partition a row is in follows from
    the files alone if docs are read from files, so a task that runs again gives the same pieces.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        from parlance.llm.wordbpe import WordIds

        words = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, WordIds(tokenizer))
        base = TaskContext.get().partitionId() << 32
        rows = ((b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]) for b in batches)
        out, size = [], 0
        for r in _task(words.encode, rows, capacity, item, block):
            out.append((*r[:5], base + r[5], r[6]))
            size += r[2]
            if size > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    return with_ids(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
    )


_loaded: dict = {}


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
