"""Exact top-k search by inner product over a pivot-distance index.

Components are floor(256 x). With M the largest squared norm, a vector is lifted by one coordinate
of square M - |x|^2 and a query by 0; then |q - x|^2 = |q|^2 + M - 2 q.x, so the largest inner
products are the nearest neighbours. Each vector is keyed by its nearest pivot and the distance to
it. Rows of a pivot are cut into RINGS annuli sorted by distance, each in cells of bounded size, so a
vector that is repeated millions of times is many cells. A task holds some cells, and knows the
annulus that a cell fills about every pivot. Each query of a block takes the cells that it falls into
first, then moves outward in order of the largest gap |d(q, pivot) - annulus| over the pivots, which
by the triangle inequality bounds the distance to all rows of the cell, and stops where the bound
exceeds its k-th distance. Its k-th score among the pivots' sample is known before the first cell.

The query set is handled in blocks of QUERY_BLOCK rows, each sent to all tasks; its size is fixed.
Pivots are fitted on at most PIVOT_SAMPLE rows, and their number grows with the square root of the
rows; every row is indexed and the search is exact.

Defined results: null vectors and vectors with null or non-finite components take no part;
components that a shorter vector lacks count as 0; equal rows count once, and rows that
share a vec_id with other vectors each for themselves; ties go to the smaller vec_id; a null vec_id takes no part; fewer than k candidates
give fewer rows; an empty table gives no row; extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import Scratch, with_ids

#: Pivots: sqrt(rows) / 8 within these bounds.
PIVOTS, MOST_PIVOTS = 32, 512
PIVOT_SAMPLE = 8192
RINGS = 16
CELL = 2048
#: Cells that the queries of a block order at once.
CELLS = 256
QUERY_BLOCK = 4096
#: Beyond this, sums of products may not be exact in doubles and are made in whole numbers.
_EXACT = 2.0**52


def quantised(df: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) with whole components, without repeats of a whole row."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return with_ids(df, "vec_id", "embedding").where(fine).select(F.col("vec_id").cast("long"), whole.alias("v")).distinct()


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up to dim with 0."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    at = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at] = values
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))[:, None]])


def fit_pivots(sample: np.ndarray, n: int = PIVOTS, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of a few k-means rounds."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    centres = sample[rng.permutation(len(sample))[:n]]
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        centres = np.stack([sample[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))


def _fits(q: np.ndarray, x: np.ndarray) -> bool:
    return q.shape[1] * (np.abs(q).max(initial=0) + 1) * (np.abs(x).max(initial=0) + 1) < _EXACT


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products; whole numbers too large for doubles are exact up to 2^63, where a long ends, and clipped there."""
    if _fits(q, x):
        return q @ x.T
    whole = np.array([[int(c) for c in r] for r in q], object) @ np.array([[int(c) for c in r] for r in x], object).T
    return np.clip(whole, -(2**63), 2**63 - 1)


class Search:
    """Top k of each query of a block over the cells that one task sees."""

    def __init__(self, ids, vectors, reach, top, k, least=None):
        self.ids, self.q, self.reach, self.k = ids, vectors, reach, k
        self.best = [[] for _ in ids]  # (-score, vec_id), at most k, sorted
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()  # a score below it can't enter
        # (|q|^2 + M - gap^2) / 2 bounds the inner product; the slack covers rounding of distances
        self.most = ((vectors * vectors).sum(1) + top) * (1 + 1e-6) / 2 + 1
        self.visited = self.met = 0

    def bounds(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(query, cell): no row of the cell has a larger inner product. low, high (cell, pivot) are the cell's annuli."""
        gap = np.zeros((len(self.ids), len(low)))
        for p in range(low.shape[1]):
            d = self.reach[:, p][:, None]
            np.maximum(gap, low[:, p] - d, out=gap)
            np.maximum(gap, d - high[:, p], out=gap)
        return self.most[:, None] - gap * gap / 2

    def expand(self, low: np.ndarray, high: np.ndarray, cells: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Each query takes the cells (ids, vectors) from its own annuli outward, until no bound reaches its k-th score."""
        bound = self.bounds(low, high)
        order = np.argsort(-bound, axis=1, kind="stable")
        self.met += bound.size
        live = np.arange(len(self.ids))
        for step in range(len(cells)):
            cell = order[live, step]
            open_ = bound[live, cell] >= self.least[live]
            live, cell = live[open_], cell[open_]
            if not len(live):
                return
            self.visited += len(live)
            by = np.argsort(cell, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(cell[by])) + 1):
                self._score(live[own], *cells[cell[own[0]]])

    def _score(self, which: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        scores = _scores(self.q[which], x)
        hits = (scores >= self.least[which][:, None]).astype(bool) & (ids != self.ids[which][:, None])
        for at in np.flatnonzero(hits.any(1)).tolist():
            j, row, near = int(which[at]), scores[at], np.flatnonzero(hits[at])
            if len(near) > self.k:  # ids rise within a cell, so a stable sort leaves ties to the smaller id
                near = near[np.argsort(-row[near], kind="stable")[: self.k]]
            self.best[j] = sorted(self.best[j] + [(-int(row[i]), int(ids[i])) for i in near])[: self.k]
            if len(self.best[j]) == self.k:
                self.least[j] = max(self.least[j], -self.best[j][-1][0])


def seeds(ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th is not below: its k-th among the sample, whose rows are candidates too."""
    out = np.full(len(ids), -np.inf)
    if len(sample) <= k or not _fits(q, sample):
        return out
    for a in range(0, len(ids), 256):
        s = q[a : a + 256] @ sample.T
        s[sample_ids == ids[a : a + 256][:, None]] = -np.inf
        out[a : a + 256] = np.partition(s, -k, axis=1)[:, -k]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for quantised vectors and queries (vec_id, v)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = scratch.save(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    seen = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(square).alias("top"), F.count(F.lit(1)).alias("n")).first()
    if not seen["dim"]:
        return empty
    dim, top, n = seen["dim"], seen["top"], seen["n"]
    sample = vectors.orderBy(F.xxhash64("vec_id")).limit(PIVOT_SAMPLE).select("vec_id", "v").toArrow()
    sample_ids, sample = sample.column("vec_id").to_numpy(), _matrix(sample.column("v").combine_chunks(), dim)
    centres = fit_pivots(_lifted(sample, top), pivots or min(MOST_PIVOTS, max(PIVOTS, int(n**0.5 / 8))))

    def keyed(batches):
        for b in batches:
            d = _distances(_lifted(_matrix(b.column(1), dim), top), centres)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], ["vec_id", "v", "pivot", "d"])

    index = scratch.save(vectors.mapInArrow(keyed, "vec_id long, v array<double>, pivot int, d double"))
    # annuli of one width about a pivot; one that holds more than CELL rows is dealt out by row
    sizes = index.groupBy("pivot").agg(F.min("d").alias("near"), F.max("d").alias("far"))
    ring = F.least(F.lit(RINGS - 1), F.floor((F.col("d") - F.col("near")) / F.greatest(F.col("far") - F.col("near"), F.lit(1e-9)) * RINGS)).cast("int")
    rings = index.join(F.broadcast(sizes), "pivot").withColumn("ring", ring)
    heavy = rings.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("m"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / CELL)).cast("int")
    cells = rings.join(F.broadcast(heavy), ["pivot", "ring"]).withColumn("deal", F.pmod(F.xxhash64("vec_id", "v"), parts).cast("int"))
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, -(-n // (4 * CELL))))
    cells = scratch.save(cells.repartition(tasks, "pivot", "ring", "deal").sortWithinPartitions("pivot", "ring", "deal", "vec_id").select("pivot", "ring", "deal", "vec_id", "v"))

    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = scratch.save(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")))
    found = empty
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).orderBy("vec_id").select("vec_id", "v").toArrow()
        if not rows.num_rows:
            continue
        ids = rows.column("vec_id").to_numpy()
        q = _matrix(rows.column("v").combine_chunks(), dim)
        reach = _distances(np.hstack([q, np.zeros((len(q), 1))]), centres)
        sent = spark.sparkContext.broadcast((ids, q, reach, seeds(ids, q, sample_ids, sample, k)))

        def search(batches, sent=sent):
            ids, q, reach, least = sent.value
            state = Search(ids, q, reach, top, k, least)

            def flush(held):
                table = pa.Table.from_batches(held)
                key = np.stack([table.column(c).to_numpy() for c in ("pivot", "ring", "deal")], 1)
                cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
                x = _matrix(table.column("v").combine_chunks(), dim)
                d, own = _distances(_lifted(x, top), centres), table.column("vec_id").to_numpy()
                low, high = np.minimum.reduceat(d, cuts[:-1]), np.maximum.reduceat(d, cuts[:-1])
                cells = [(own[a:b], x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                for a in range(0, len(cells), CELLS):
                    state.expand(low[a : a + CELLS], high[a : a + CELLS], cells[a : a + CELLS])

            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.num_rows
                if size >= 16 * CELL:
                    flush(held)
                    held, size = [], 0
            if held:
                flush(held)
            out = [(int(i), v, -s) for i, best in zip(state.ids, state.best, strict=True) for s, v in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

        part = cells.mapInArrow(search, "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        part = part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = scratch.save(part) if blocks == 1 else found.unionByName(scratch.save(part))
    return found


def every_fiftieth(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0")
