"""Vector and probability functions on array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0; the shorter length counts."""
    n = F.least(F.size(a), F.size(b))
    norms = F.sqrt(dot(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1), n))) * F.sqrt(dot(F.slice(b, F.lit(1), n), F.slice(b, F.lit(1), n)))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def softmax(x: Column) -> Column:
    """Shifted by the maximum; uniform if that isn't finite or nothing is left."""
    # what all elements share goes in as a second array: inside a lambda it would be computed for each
    along = lambda v: F.array_repeat(v, F.size(x))
    e = F.zip_with(x, along(F.array_max(x)), lambda v, m: F.exp(v - m))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    fine = total.isNotNull() & ~F.isnan(total) & (total > 0) & (total < float("inf"))
    return F.when(fine, F.zip_with(e, along(total), lambda v, t: v / t)).otherwise(along(1.0 / F.size(x)))


def mask(p: Column, ids: Column) -> Column:
    return F.transform(p, lambda v, i: F.when(F.array_contains(ids, i), F.lit(0.0)).otherwise(v))


def repetition_penalty(p: Column, recent: Column, penalty: float) -> Column:
    """Multiplied by penalty once for each time the id is in recent; a penalty of 1 or more does nothing."""
    if penalty >= 1:
        return p
    return F.transform(p, lambda v, i: v * F.pow(F.lit(penalty), F.size(F.filter(recent, lambda r: r == i))))


def top_k_ids(p: Column, k: int) -> Column:
    """Ids of the k largest finite values, ties to the smaller id."""
    pairs = F.filter(F.transform(p, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))), lambda s: s["v"].isNotNull() & ~F.isnan(s["v"]) & (F.abs(s["v"]) < float("inf")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: s["i"])


def learning_rate(epoch: Column, peak: float, least: float, warmup: int, anneal: int) -> Column:
    """Linear warm-up, half a cosine, then least; peak throughout if anneal is 0."""
    if anneal == 0:
        return F.lit(peak)
    after = epoch - warmup
    cosine = least + (peak - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * after / anneal))
    out = F.when(after >= anneal, F.lit(least)).otherwise(cosine)
    return F.when(epoch <= warmup, peak * epoch / warmup).otherwise(out) if warmup else out


def window_ids(ids: Column, n: int = 32, pad: int = 0) -> Column:
    """The last n ids, filled up with pad on the left."""
    size = F.size(ids)
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(0), n - size)), F.slice(ids, F.greatest(size - n + 1, F.lit(1)), F.lit(n)))


def position_feature(position: Column) -> Column:
    return F.least(position / 100.0, F.lit(1.0))


def cross_entropy(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(1e-9)))
