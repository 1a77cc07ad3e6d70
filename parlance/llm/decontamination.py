"""Benchmark decontamination by SimHash of item-sized windows.

Each benchmark item is fingerprinted over its words. In a document, every window of an item's
length around a shared shingle is fingerprinted too (a window without any shingle of the benchmark
has similarity 0 to every item, so skipping it loses nothing). Fingerprints are cut into four
16-bit blocks; items are entered under every block value within RADIUS // 4 bits, so each item
within RADIUS of a window is met in at least one block. Candidates within RADIUS are then verified
exactly: the weight of the item's five-word shingles that the window holds, over the weight of all
of them; a shingle weighs one over the number of items that hold it.

The benchmark goes through in blocks of ITEM_BLOCK items, each a table of bounded size that tasks
get whole; the documents are never shuffled. The numbers of items that hold a shingle are counted
over the whole benchmark first.

Defined results: null and empty texts hold nothing; items with fewer than five words have the whole
sequence as their shingle; items without words match nothing; repeated rows and items are reported
each for itself, with their ids; of an item's windows in a text the one with the greatest similarity
is given, of equals the first, then the shortest; texts of any length are searched whole, and windows
of equal words are looked at once; an empty benchmark or table gives no row. Only doc_id and text, item_id and
text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Scratch, maybe_broadcast, small_batches, with_ids
from parlance.llm.textkit import _K, U, hashed, mix, shingles, simhash

RADIUS = 15
SIMILARITY = 0.8
ITEM_BLOCK = 2000
SHINGLE = 5
#: Words of windows that are laid out at once.
WINDOW_WORDS = 1 << 18
_word = re.compile(r"\w+")
_NEAR = [0, *(sum(1 << b for b in bits) for n in range(1, RADIUS // 4 + 1) for bits in combinations(range(16), n))]


def words(text: str) -> np.ndarray:
    return hashed(_word.findall(text.lower()))


_BACK = pow(int(_K), -1, 1 << 64)


def _running(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the hashes before each place, each times a power of its place, and the inverse powers."""
    power, back = (np.cumprod(np.concatenate([np.ones(1, U), np.full(len(h), k, U)])) for k in (_K, U(_BACK)))
    return np.concatenate([np.zeros(1, U), np.cumsum(mix(h) * power[:-1], dtype=U)]), back


def _windows(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n words that its words in their order decide."""
    total, back = sums
    return (total[starts + n] - total[starts]) * back[starts]


class Items:
    """One block of items and its multi-index over fingerprint blocks."""

    def __init__(self, rows: list[tuple[int, str]], weight: dict[int, float] | None = None):
        self.ids, self.sizes, self.sets = [], [], []
        prints = []
        for i, text in rows:
            h = words(text or "")
            if len(h):
                self.ids.append(i)
                self.sizes.append(len(h))
                self.sets.append(np.unique(shingles(h, SHINGLE)))
                prints.append(simhash(h, np.array([0]), np.array([len(h)]))[0])
        self.prints = np.array(prints, U)
        holders = Counter(s for x in self.sets for s in x.tolist())
        self.shingles = np.array(sorted(holders), U)
        # the items' shingles, as places in self.shingles, end to end: where each item begins, and the weights
        self.counts = np.array([len(x) for x in self.sets], np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        flat = np.concatenate(self.sets) if self.sets else np.empty(0, U)
        self.flat = np.searchsorted(self.shingles, flat)
        of = np.array([(weight or {}).get(s, 1 / holders[s]) for s in self.shingles.tolist()])
        self.weights = of[self.flat] if len(flat) else np.empty(0)
        self.totals = np.add.reduceat(self.weights, self.begins) if len(flat) else np.empty(0)
        # the distinct sizes of the items that hold each shingle, end to end
        pairs = np.unique(np.stack([self.flat, np.repeat(np.array(self.sizes, np.int64), self.counts)], 1), axis=0) if len(flat) else np.empty((0, 2), np.int64)
        self.lengths = pairs[:, 1]
        self.length_begins = np.searchsorted(pairs[:, 0], np.arange(len(self.shingles) + 1))
        # a bitmap over the low bits rules most shingles out before the exact look-up
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.shingles & U((1 << 20) - 1)).astype(int)] = True
        self.short = sorted({n for n in self.sizes if n < SHINGLE})
        near = np.array(_NEAR, np.int64)
        #: For each of the four blocks: items by block value, and where each value's items start.
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        for b in range(4):
            part = (self.prints >> U(16 * b) & U(0xFFFF)).astype(np.int64)
            keys = (part[:, None] ^ near).ravel()
            order = np.argsort(keys, kind="stable")
            owner = np.repeat(np.arange(len(part), dtype=np.int32), len(near))[order]
            self.blocks.append((owner, np.searchsorted(keys[order], np.arange(1 << 16 | 1)).astype(np.int32)))

    def near(self, print_: int) -> np.ndarray:
        """Items within RADIUS of a fingerprint."""
        values = [print_ >> 16 * b & 0xFFFF for b in range(4)]
        found = np.unique(np.concatenate([owner[at[v] : at[v + 1]] for (owner, at), v in zip(self.blocks, values, strict=True)]))
        return found[np.bitwise_count(self.prints[found] ^ U(print_)) <= RADIUS]

    def known(self, s: np.ndarray) -> np.ndarray:
        """The place in self.shingles of each of s, -1 for those of no item."""
        out = np.full(len(s), -1, np.int64)
        at = np.flatnonzero(self.bits[(s & U((1 << 20) - 1)).astype(np.int64)])
        if len(at):
            found = np.minimum(np.searchsorted(self.shingles, s[at]), len(self.shingles) - 1)
            out[at] = np.where(self.shingles[found] == s[at], found, -1)
        return out

    def starts(self, place: np.ndarray, words: int) -> dict[int, np.ndarray]:
        """By length, where windows begin that hold a shingle of an item of that length, in a text of so many words."""
        at = np.flatnonzero(place >= 0)
        sizes = self.length_begins[place[at] + 1] - self.length_begins[place[at]]
        which = np.repeat(self.length_begins[place[at]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        length, at = np.minimum(self.lengths[which], words), np.repeat(at, sizes)
        out = {}
        for n in np.unique(length).tolist():
            if n < SHINGLE and n != words:
                continue
            p = at[length == n]
            low, high = np.maximum(0, p + SHINGLE - n), np.minimum(p, words - n)
            change = np.zeros(words - n + 2, np.int64)
            np.add.at(change, low[low <= high], 1)
            np.add.at(change, high[low <= high] + 1, -1)
            out[n] = np.flatnonzero(np.cumsum(change) > 0)
        return out

    def shares(self, held: np.ndarray, items: np.ndarray) -> np.ndarray:
        """What share of each item's weight these shingles, places in self.shingles, make up."""
        mark = np.zeros(len(self.shingles), bool)
        mark[held] = True
        sizes = self.counts[items]
        heads = np.cumsum(sizes) - sizes
        which = np.repeat(self.begins[items] - heads, sizes) + np.arange(int(sizes.sum()))
        return np.add.reduceat(self.weights[which] * mark[self.flat[which]], heads) / self.totals[items]

    def leaks(self, text: str) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity): the best window of each item in the text."""
        h = words(text)
        return self.leaks_in(h, shingles(h, SHINGLE)) if len(h) and len(self.ids) else []

    def leaks_in(self, h: np.ndarray, s: np.ndarray) -> list[tuple[int, int, int, float]]:
        best: dict[int, tuple[float, int, int]] = {}
        place = self.known(s)
        places = self.starts(place, len(h))
        held = {n: place for n in places}  # of windows by length, what stands at each place
        for n in self.short:  # an item of fewer words than a shingle is met by its own windows
            if n <= len(h):
                held[n] = self.known(shingles(h, n))
                places[n] = np.union1d(places.get(n, np.empty(0, np.int64)), np.flatnonzero(held[n] >= 0))
        sums = None
        for n, starts in sorted(places.items()):
            if len(starts) > 1:  # equal windows are looked at once, where they come first
                sums = _running(h) if sums is None else sums
                starts = np.sort(starts[np.unique(_windows(sums, starts, n), return_index=True)[1]])
            step = max(1, WINDOW_WORDS // n)
            for at in (starts[k : k + step] for k in range(0, len(starts), step)):
                inside = np.repeat(at, n) + np.tile(np.arange(n), len(at))
                prints = simhash(h[inside], np.arange(len(at)) * n, np.full(len(at), n))
                for a, f in zip(at.tolist(), prints.tolist(), strict=True):
                    near = self.near(f)
                    if len(near):
                        own = held[n][a : a + max(1, n - SHINGLE + 1)]
                        shares = self.shares(own[own >= 0], near)
                        for i in np.flatnonzero(shares >= SIMILARITY - 1e-12).tolist():
                            item, share = int(near[i]), float(shares[i])
                            # first come the greatest share, then the first window, then the shortest
                            if item not in best or (-share, a, n) < (-best[item][0], *best[item][1:]):
                                best[item] = (share, a, n)
        return [(i, a, n, share) for i, (share, a, n) in sorted(best.items())]


def holders(benchmark: DataFrame) -> DataFrame:
    """(s, n): how many items of the whole benchmark hold each shingle."""

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles(words(t), SHINGLE)).view(np.int64))], ["s"])

    texts = with_ids(benchmark, "item_id", "text").where("item_id is not null and text is not null").select("text")
    return texts.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n"))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, key): each document's leaks; key is the text's hash."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = with_ids(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    out, block = None, []
    schema = "doc_id long, key long, item_id long, start long, n_words long, similarity double"

    items = with_ids(benchmark, "item_id", "text").where("item_id is not null")
    # one block holds the whole benchmark, so its own counts are those of all items
    counts = Scratch(spark, "benchmark").save(holders(benchmark)) if items.count() > ITEM_BLOCK else None

    def weights(block):
        own = np.unique(np.concatenate([shingles(words(t or ""), SHINGLE) for _, t in block]))
        own = spark.createDataFrame(pa.table({"s": pa.array(own.view(np.int64))}), "s long")
        return {r["s"] & (1 << 64) - 1: 1 / r["n"] for r in counts.join(maybe_broadcast(own), "s").collect()}

    def through(block):
        sent = spark.sparkContext.broadcast(Items(block, weights(block) if counts is not None else None))

        def run(batches):
            items = sent.value
            for b in batches:
                found = []
                for d, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    found += [(d, k, items.ids[i], a, n, share) for i, a, n, share in items.leaks(t)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if j == 5 else pa.int64()) for j, c in enumerate(zip(*found, strict=True))], ["doc_id", "key", "item_id", "start", "n_words", "similarity"])

        return rows.mapInArrow(run, schema)

    # the benchmark is read a partition at a time; the driver holds one block
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == ITEM_BLOCK:
            part = through(block)
            out, block = part if out is None else out.unionByName(part), []
    if block or out is None:
        part = through(block)
        out = part if out is None else out.unionByName(part)
    return out
