"""Places of rows in a total order, and sums over what is before them, without sorting in one task.

A sample of the rows gives points that cut the order into ranges. The order may have any number of
columns of any type that can be sorted, so ties of the first one are cut by the next. Each range is
worked on by itself; only one row a range ever comes together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a table is cut into; their sums are all that is ever in one place.
RANGES = 256
#: Rows of the sample for each cut.
SAMPLED = 64
#: Rows below which a range isn't worth a task of its own.
LEAST_ROWS = 200_000


def cuts(rows: DataFrame, order: list[Column], ranges: int) -> list[tuple]:
    """At most ranges - 1 rows of the order, evenly spread over it, from a sample of bounded size.

    They come from one pass that keeps the SAMPLED * ranges rows of least hash, drawn by the order alone.
    """
    if ranges < 2:
        return []
    keys = rows.select(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    names = keys.columns
    # rows that tie in the whole order count once: no cut can part them
    sample = keys.withColumn("h", F.xxhash64(*names)).orderBy("h", *names).limit(SAMPLED * ranges).select(*names)
    held = sample.distinct().orderBy(*names).collect()  # at most SAMPLED * ranges rows
    step = len(held) / ranges
    return [tuple(r) for i, r in enumerate(held) if i and int(i / step) != int((i - 1) / step)] if step >= 1 else [tuple(r) for r in held[1:]]


def _literal(values: tuple, kinds: list) -> Column:
    return F.struct(*[F.lit(v).cast(k).alias(f"o{i}") for i, (v, k) in enumerate(zip(values, kinds, strict=True))])


def range_of(rows: DataFrame, order: list[Column], points: list[tuple]) -> Column:
    """The number of points that aren't after the row, found by halving."""
    kinds = [f.dataType for f in rows.select(*order).schema.fields]
    own = F.struct(*[c.cast(k).alias(f"o{i}") for i, (c, k) in enumerate(zip(order, kinds, strict=True))])

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(own < _literal(points[mid], kinds), search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(points))


def ranged(rows: DataFrame, order: list[str | Column], name: str = "__range", ranges: int | None = None) -> DataFrame:
    """rows with the range that each lies in; by default as many ranges as counted rows call for, RANGES at most.

    Ranges are fixed numbers of fixed points, so plans that read the result more than once agree on them.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if ranges is None:
        ranges = min(RANGES, -(-rows.count() // LEAST_ROWS))
    return rows.withColumn(name, range_of(rows, order, cuts(rows, order, ranges)))


def running(rows: DataFrame, order: list[str | Column], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """rows with the sum of value over all rows before theirs in the order."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = ranged(rows, order, "__range", ranges).withColumn("__value", value)
    sums = dealt.groupBy("__range").agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("__range", before.alias("__before"))  # a row a range
    own = F.coalesce(F.sum("__value").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__own", own).join(F.broadcast(starts), "__range").withColumn(name, F.col("__own") + F.col("__before")).drop("__range", "__value", "__own", "__before")


def numbered(rows: DataFrame, order: list[str | Column], name: str = "nth", ranges: int | None = None) -> DataFrame:
    """rows with their place from 0 by order; rows that tie in all of it are numbered in any order."""
    return running(rows, order, F.lit(1).cast("bigint"), name, ranges)
