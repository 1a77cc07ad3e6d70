"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct five-word shingles. Shingles have one global order: those that
many documents hold come last, by count, all others by hash. Sets with Jaccard similarity of at
least 0.8 share a shingle in their prefixes, the first n - ceil(0.8 n) + 1 of their n shingles.
Documents with identical prefix and size form one group; groups that share a prefix shingle are
matched: pairs of groups pass bounds from their sizes and the places of the shared shingle, and only
then are groups expanded into their distinct sets. Pairs of these pass bounds from 512 and more
parity bits, whose Hamming distance never exceeds the symmetric difference; the rest are verified on
whole texts.

The order is a hint that no result depends on: counts come from all documents, and at most
FREQUENT of the commonest shingles are told apart. Links are followed to components through
`linking`, so a group of thousands of copies is compared with few of its members.

Defined results: null, empty and word-less texts have no shingle and are linked with nothing;
fewer than five words are one shingle; equal sets are linked whatever the texts; rows with a null
doc_id link others but can't name a component (null if nothing else is in it); repeated rows get
equal results; shingles that are equally frequent are ordered by their hashes; texts of any length are compared
whole; an empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Scratch, maybe_broadcast, small_batches, text_key, with_ids
from parlance.llm.linking import buckets, link, shared_keys
from parlance.llm.textkit import U, mix, shingles, word_hashes

#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
FREQUENT = 1 << 18
COMMON = 6
_SIGN = U(1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _common(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles, the rarer first, by counts over all documents.

    Each batch adds the shingles that it holds twice or more; a shingle of many documents is one of many batches.
    """

    def run(batches):
        for b in batches:
            sets = [np.unique(shingles(word_hashes(t))) for t in b.column(0).cast(pa.binary()).to_pylist() if t]
            if sets:
                s, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(s[n > 1])), pa.array(n[n > 1].astype(np.int64))], ["s", "n"])

    counts = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    order = np.lexsort([top.column("s").to_numpy(), top.column("n").to_numpy()])
    return top.column("s").to_numpy()[order].astype(np.int64).view(U)


class Order:
    """The global order of shingles."""

    def __init__(self, common: np.ndarray):
        at = np.argsort(common, kind="stable")
        self.common, self.rank = common[at], at.astype(np.int64)

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The prefix of a sorted set."""
        n = len(s)
        p = n - -(-NUM * n // DEN) + 1
        if not len(self.common):
            return s[:p]
        at = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
        late = self.common[at] == s
        if not late[: p].any():
            return s[:p]
        rare = s[~late]
        if len(rare) >= p:
            return rare[:p]
        held = s[late]
        return np.concatenate([rare, held[np.argsort(self.rank[at[late]], kind="stable")][: p - len(rare)]])


def _sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s * U(0xD6E8FEB86659FD93) >> U(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide(s: np.ndarray) -> bytes:
    """Parity bits as many as shingles at least, a power of two; shorter ones are foldings of longer ones."""
    bits = max(512, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _wide_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of wide parity bits, a number of shingles by which the sets differ at least."""
    out = np.zeros(len(a), np.int64)
    x_size, y_size = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    for x, y in set(zip(x_size.tolist(), y_size.tolist(), strict=True)):
        all_at = np.flatnonzero((x_size == x) & (y_size == y))
        step = max(1, (8 << 20) // max(x, y))
        for at in (all_at[k : k + step] for k in range(0, len(all_at), step)):
            one, two = (np.frombuffer(b"".join(side[at].tolist()), np.uint64).reshape(len(at), -1) for side in (a, b))
            if x < y:
                one, two = two, one
            while one.shape[1] > two.shape[1]:
                one = one[:, : one.shape[1] // 2] ^ one[:, one.shape[1] // 2 :]
            out[at] = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
    return out


def profiles(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, key, n, id (of the set), grp (of prefix and size), 512 parity bits in s0 to s7, wide parity bits, prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        order = Order(sent.value)
        for b in batches:
            n, ids, grp, bits, wide, prefix, met = [], [], [], [], [], [], set()
            for t in b.column(2).cast(pa.binary()).to_pylist():
                s = np.unique(shingles(word_hashes(t or b"")))
                n.append(len(s))
                if not len(s):
                    ids.append(0), grp.append(0), bits.append(np.zeros(8, np.int64)), wide.append(b""), prefix.append(s)
                    continue
                p = order.prefix(s)
                ids.append(int(mix(mix(s).sum(keepdims=True) + U(len(s)))[0].view(np.int64)))
                fold = (mix(p) * (np.arange(1, len(p) + 1, dtype=U) * U(2) + U(1))).sum(keepdims=True)
                grp.append(int(mix(fold + U(len(s)))[0].view(np.int64)))
                bits.append(_sketch(s))
                wide.append(_wide(s))
                prefix.append(p if grp[-1] not in met else p[:0])  # a batch names a group's prefix once
                met.add(grp[-1])
            bits = np.stack(bits) if bits else np.zeros((0, 8), np.int64)
            flat = np.concatenate(prefix).view(np.int64) if prefix else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(grp, pa.int64()), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(8)], pa.array(wide, pa.binary()), lists],
                ["doc_id", "key", "n", "id", "grp", *[f"s{i}" for i in range(8)], "wide", "prefix"],
            )

    columns = ", ".join(f"s{i} long" for i in range(8))
    return docs.select("doc_id", "key", "text").mapInArrow(run, f"doc_id long, key long, n long, id long, grp long, {columns}, wide binary, prefix array<long>")


def _near(cols: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By how many in a thousand of their shingles sets i and j differ at least; -1 if they can't be similar.

    Size and place hold for whole groups: with a common shingle at places p and q of two prefixes,
    at most min(p, q) shingles before it and those after it in the smaller rest are shared. Then
    parity bits bound the symmetric difference, (1 - t) / (1 + t) * (sizes added) at most.
    """
    out = np.full(len(i), -1, np.int64)
    n, m, p, q = cols["n"][i], cols["n"][j], cols["place"][i], cols["place"][j]
    shared = 1 + np.minimum(p, q) + np.minimum(n - p - 1, m - q - 1)
    ok = (DEN * n >= NUM * m) & (DEN * m >= NUM * n) & ((p < 0) | (q < 0) | ((DEN + NUM) * shared >= NUM * (n + m)))
    at = np.flatnonzero(ok)
    for bound in ("bits", "wide"):
        x, y = i[at], j[at]
        if bound == "bits":
            apart = sum(np.bitwise_count((cols[f"s{k}"][x] ^ cols[f"s{k}"][y]).view(U)).astype(np.int64) for k in range(8)) if len(at) else np.empty(0, np.int64)
        else:
            apart = _wide_apart(cols["wide"][x], cols["wide"][y])
        total = (n + m)[at]
        ok = (DEN + NUM) * apart <= (DEN - NUM) * total
        out[at] = np.where(ok, 1000 * apart // np.maximum(total, 1), -1)
        at = at[ok]
    return out


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs whose texts have the similarity. sets (id, key) names a text for each set."""
    pairs = scratch.save(pairs)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ids = scratch.save(sets.join(maybe_broadcast(ids), "id").groupBy("id").agg(F.min("key").alias("key")))
    texts = docs.join(maybe_broadcast(ids.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    texts = scratch.save(ids.join(texts, "key").select("id", "text"))
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        last, left = None, None
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            right = batch.column(3).cast(pa.binary())
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if x != last:
                    last, left = x, np.unique(shingles(word_hashes(batch.column(2)[i].as_py().encode())))
                other = np.unique(shingles(word_hashes(right[i].as_py())))
                at = np.minimum(np.searchsorted(left, other), len(left) - 1)
                shared = int((left[at] == other).sum())
                if DEN * shared >= NUM * (len(left) + len(other) - shared):
                    keep.append((x, y))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep, strict=True)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_shingles and component_id of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = with_ids(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key())
    rows = scratch.save(profiles(docs, _common(docs)))
    full = rows.where("n > 0")
    index = full.select("grp", F.posexplode("prefix").alias("place", "key"))
    sets = full.select("id", "grp", "n", "wide", *[f"s{i}" for i in range(8)])
    keys = shared_keys(index, scratch)
    held = buckets(keys, scratch)
    scratch.drop(keys)
    labels = link(held, sets, _near, lambda pairs, _: _verified(pairs, full.select("id", "key"), docs, scratch), scratch, True)
    plain = scratch.save(rows.select("doc_id", "key", "n", "id"))
    named = scratch.save(plain.where("n > 0").join(labels, "id", "left").select("doc_id", "key", "n", F.coalesce("label", "id").alias("label")))
    scratch.release(0, plain, named)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "label").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(plain.where("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
