"""Fill-in-the-middle transformation of whole texts.

A byte automaton is given as a table over six classes of bytes. It tells where units (runs of A-Z
and a-z, or any other single code point) and code points begin, passes over UTF-8 continuation
bytes, and recognises the sentinels `<P>`, `<S>` and `<M>`. Whatever state it starts in, two bytes
settle the state it is in; `compiled` proves that from the table, and so the transition at a byte
follows from three classes. One scan of a whole batch yields the transition at each byte; their
counts give units, code points and sentinels of each text. A second pass locates the two cuts among
the transitions that begin a unit.

Defined results: null text is empty; an empty text, a text that holds a sentinel and a row without
doc_id stay plain; rows that share a doc_id get the same draws, repeated rows equal results; cuts may
coincide (the middle is empty then) and may lie at either end; texts of any length are cut whole, in
linear time; an empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import small_batches, with_ids

OTHER, LETTER, NAME, OPEN, CLOSE, MORE = range(6)
GAP, WORD, OPENED, NAMED = range(4)
UNIT, POINT, SENTINEL = 1, 2, 4

#: Class of each byte; lead bytes of longer characters are like other characters of one byte.
CLASSES = bytes(
    OPEN if b == ord("<") else CLOSE if b == ord(">") else NAME if chr(b) in "PSM" else LETTER if chr(b).isalpha() and b < 128 else MORE if 128 <= b < 192 else OTHER
    for b in range(256)
)
#: State after each class, and what the transition emits, by state.
#           OTHER LETTER NAME  OPEN    CLOSE MORE
STEP = [
    [GAP, WORD, WORD, OPENED, GAP, GAP],  # in a gap
    [GAP, WORD, WORD, OPENED, GAP, GAP],  # in a word
    [GAP, WORD, NAMED, OPENED, GAP, GAP],  # after <
    [GAP, WORD, WORD, OPENED, GAP, GAP],  # after < and a sentinel's letter
]
_new, _on = UNIT | POINT, POINT
EMIT = [
    [_new, _new, _new, _new, _new, 0],
    [_new, _on, _on, _new, _new, 0],
    [_new, _new, _new, _new, _new, 0],
    [_new, _on, _on, _new, _new | SENTINEL, 0],
]


def compiled(step: list[list[int]], emit: list[list[int]], start: int = GAP, rest: int = OTHER) -> np.ndarray:
    """What is emitted at a byte, by 36 * its class two before + 6 * the class before + its own.

    rest is a class that leads from the start back to it, so it may stand for what is before a text.
    """
    n, states = len(step[0]), range(len(step))
    if step[start][rest] != start:
        raise ValueError("the class before a text must keep the start state")
    out = np.zeros(n**3, np.uint8)
    for a in range(n):
        for b in range(n):
            reached = {step[step[s][a]][b] for s in states}
            if len(reached) != 1:
                raise ValueError("two bytes must settle the state")
            s = reached.pop()
            out[(a * n + b) * n : (a * n + b) * n + n] = emit[s]
    return out


TRANSITIONS = compiled(STEP, EMIT)


def transitions(data: bytes, starts: np.ndarray) -> np.ndarray:
    """What the automaton emits at each byte of texts laid end to end; starts says where each begins."""
    own = np.frombuffer(data.translate(CLASSES), np.uint8)
    before = np.zeros(len(own) + 2, np.uint8)
    before[2:] = own
    one, two = before[1:-1].copy(), before[:-2].copy()
    starts = starts[starts < len(own)]
    one[starts] = two[starts] = OTHER
    second = starts + 1
    second = second[second < len(own)]
    two[second] = OTHER
    key = two * np.uint8(36) + one * np.uint8(6) + own
    return TRANSITIONS[key]


def draws(doc_id: int, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers that seed and doc_id decide."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()[:16])


def _parts(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins and the last ends."""
    column = column.cast(pa.binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    return bytes(held.slice(int(ends[0]), int(ends[-1] - ends[0]))) if held else b"", ends - ends[0]


def transform(docs: DataFrame, rate: int = 90, spm: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of each document.

    rate documents in a hundred are transformed, spm in a hundred of these with the suffix first.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, at = _parts(batch.column(1))
            found = transitions(data, at[:-1])
            units = np.flatnonzero(found & UNIT)
            first = np.searchsorted(units, at)
            marked = np.diff(np.searchsorted(np.flatnonzero(found & SENTINEL), at))
            rows, out = [], []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                a, b = int(at[i]), int(at[i + 1])
                n = int(first[i + 1] - first[i])
                h = None if doc_id is None else draws(doc_id, seed)
                if n == 0 or marked[i] or h is None or h[2] % 100 >= rate:
                    rows.append((n, "plain", None, None))
                    out.append(data[a:b])
                    continue
                low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                low, high = (int(units[first[i] + c]) if c < n else b for c in (low, high))
                chars = [int(np.count_nonzero(found[x:y] & POINT)) for x, y in ((a, low), (low, high))]
                prefix, middle, suffix = data[a:low], data[low:high], data[high:b]
                form = "spm" if h[3] % 100 < spm else "psm"
                rows.append((n, form, *chars))
                out.append(b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle) if form == "spm" else (b"<P>", prefix, b"<S>", suffix, b"<M>", middle)))
            n, form, prefix, middle = zip(*rows, strict=True) if rows else ((),) * 4
            texts = pa.array(out, pa.binary())
            texts = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers())
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, long), pa.array(form, pa.string()), pa.array(prefix, long), pa.array(middle, long), texts], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = with_ids(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed; it held no sentinel, so the output's three stand where they were put."""
    p = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(p[1], p[3], p[2])).when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(output)


def digest(out: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
