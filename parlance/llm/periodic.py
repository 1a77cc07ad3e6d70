"""Periodic runs of words.

A run is a stretch of consecutive words with smallest period q, at least twice q long, that neither
neighbour extends. Each run is found from the longest Lyndon word that starts at one of its places,
in one of two opposite orders of the words. These Lyndon words come from a stack of suffixes that is
scanned from right to left: the word at i reaches to the next suffix that is smaller. Suffixes are
compared by their longest common extension: some words directly, then, if all are equal, by rolling
hashes in a galloping and binary search. A Lyndon word whose neighbourhood repeats is extended to
both sides in the same way, and what comes out is verified word by word. There is no suffix array.

Defined results: null and empty texts have no words and no runs; runs that overlap are all given, by
start and period; repeated rows are searched each for itself; a row without doc_id is like any other,
a change that needs the id leaves it alone; texts of any length are searched whole, in some n log n
steps; an empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import small_batches, with_ids

#: Words compared one by one before hashes are used.
DIRECT = 8
LEAST = 12
MOD, BASE = (1 << 61) - 1, 0x1B8F_3C5A_96E2_47D1


class Extensions:
    """Longest common extensions between places of a sequence of numbers."""

    def __init__(self, a: list[int]):
        self.a, self.n = a, len(a)
        self.sums: list[int] = []
        self.powers: list[int] = []
        #: By distance: the place of the last long extension to the right, and its length.
        self.last: dict[int, tuple[int, int]] = {}

    def _hash(self) -> None:
        self.sums, self.powers = [0], [1]
        h, p = 0, 1
        for x in self.a:
            h = (h * BASE + x + 1) % MOD
            p = p * BASE % MOD
            self.sums.append(h)
            self.powers.append(p)

    def _search(self, equal: Callable[[int], bool], known: int, most: int) -> int:
        """The largest length up to most with equal(length), known being one."""
        step = known
        while known + step <= most and equal(known + step):
            known += step
            step *= 2
        high = min(most, known + step)  # beyond it, or at it, something differs
        while known < high:
            mid = (known + high + 1) // 2
            if equal(mid):
                known = mid
            else:
                high = mid - 1
        return known

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        a, most = self.a, self.n - j
        for k in range(min(DIRECT, most)):
            if a[i + k] != a[j + k]:
                return k
        if most <= DIRECT:
            return most
        at, length = self.last.get(j - i, (-1, 0))
        if i <= at <= i + DIRECT:  # what is before it is equal, so that one goes on from here
            length += at - i
        else:
            if not self.sums:
                self._hash()
            s, p = self.sums, self.powers
            x, y = s[i], s[j]
            length = self._search(lambda m: (s[i + m] - s[j + m] - (x - y) * p[m]) % MOD == 0, DIRECT, most)
        self.last[j - i] = i, length
        return length

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        a, most = self.a, i
        for k in range(1, min(DIRECT, most) + 1):
            if a[i - k] != a[j - k]:
                return k - 1
        if most <= DIRECT:
            return most
        if not self.sums:
            self._hash()
        s, p = self.sums, self.powers
        x, y = s[i], s[j]
        return self._search(lambda m: (x - y - (s[i - m] - s[j - m]) * p[m]) % MOD == 0, DIRECT, most)


def lyndon_ends(a: list[int], extensions: Extensions, falling: bool) -> list[int]:
    """Where the longest Lyndon word ends that starts at each place: at the next smaller suffix.

    a is in the order of comparison, extensions know which words are equal; the end is less than any word.
    """
    n = len(a)
    ends, stack = [n] * n, [n]
    a = [-x for x in a] if falling else list(a)
    a.append(min(a, default=0) - 1)  # the place n, which is never popped
    for i in range(n - 1, -1, -1):
        x, j = a[i], stack[-1]
        while (y := a[j]) >= x:
            if y == x:
                k = extensions.right(i, j)
                if a[j + k] < a[i + k]:
                    break
            stack.pop()
            j = stack[-1]
        ends[i] = j
        stack.append(i)
    return ends


def runs(a: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `least` words, by start and period."""
    n = len(a)
    if n < max(2, least):
        return []
    extensions, found = Extensions(a), set()
    words = np.array(a, np.int64)
    for falling in (False, True):
        ends = np.array(lyndon_ends(a, extensions, falling), np.int64)
        at = np.arange(n)
        # a Lyndon word that repeats on neither side is no root of a run
        right = words[at] == np.append(words, -1)[ends]
        left = (at > 0) & (words[at - 1] == words[ends - 1])
        known: dict[int, tuple[int, int]] = {}
        for i in np.flatnonzero(right | left).tolist():
            j = int(ends[i])
            p = j - i
            start, end = known.get(p, (0, 0))
            if start <= i and j <= end:
                continue
            start, end = i - extensions.left(i, j), j + (extensions.right(i, j) if j < n else 0)
            if end - start < 2 * p:
                continue
            if a[start : end - p] != a[start + p : end] or start and a[start - 1] == a[start + p - 1] or end < n and a[end] == a[end - p]:
                start, end = _plainly(a, i, j)  # hashes of different words were equal
                if end - start < 2 * p:
                    continue
            known[p] = start, end
            if end - start >= least:
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _plainly(a: list[int], i: int, j: int) -> tuple[int, int]:
    start, end, p = i, j, j - i
    while start and a[start - 1] == a[start + p - 1]:
        start -= 1
    while end < len(a) and a[end] == a[end - p]:
        end += 1
    return start, end


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, of each run only its first period's."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find(docs: DataFrame, least: int = LEAST, change: Callable[[int, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs and collapsed text of each document.

    change, if given, makes a document's words others before they are searched; it gets the id and the words.
    """
    small_batches(docs.sparkSession)
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches):
        for batch in batches:
            sizes, counts, held, texts = [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").split()  # by ASCII white space
                if change and doc_id is not None:
                    words = change(doc_id, words)
                number: dict[bytes, int] = {}
                found = runs([number.setdefault(w, len(number)) for w in words], least)
                sizes.append(len(words))
                held += found
                counts.append(len(held))
                texts.append(collapsed(words, found))
            columns = np.array(held, np.int64).reshape(-1, 3).T
            listed = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], fields=list(run_type))
            joined = pa.array(texts, pa.binary())
            joined = pa.Array.from_buffers(pa.string(), len(joined), joined.buffers())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), listed), joined], ["doc_id", "n_words", "runs", "collapsed"])

    rows = with_ids(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The query's change: of every tenth id, by hash, the words from some place on repeat with some period."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def digest(out: DataFrame) -> DataFrame:
    """n_runs, the greatest run, and hashes of the runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    most = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = out.withColumn("most", most)
    length, period = -F.col("most.less"), F.col("most.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("most.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(-1000 * most.less) div most.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
