"""Vectors held as arrays: products, norms, means and blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def blend(a: Column, b: Column, wa: float, wb: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * wa + y * wb)


def rounded(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))


def scaled(v: Column, p: int = 2) -> Column:
    """``v`` divided by its L1 or L2 norm; a zero vector stays."""
    n = norm(v) if p == 2 else F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def combined(a: Column, b: Column, how: str = "mean") -> Column:
    """Two vectors of equal length as one: their mean, product, sum, or one behind the other. Where one is null, the other."""
    ways = {"mean": lambda x, y: (x + y) / 2, "product": lambda x, y: x * y, "sum": lambda x, y: x + y}
    if how == "concat":
        both = F.concat(a, b)
    elif how in ways:
        both = F.zip_with(a, b, ways[how])
    else:
        raise ValueError(f"unknown way {how!r}: concat, {', '.join(ways)}")
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def masked_mean(states: Column, mask: Column) -> Column:
    """The mean of the rows of ``states`` (an array of vectors) whose ``mask`` is not 0, scaled to length one; with no such row the zero vector."""
    kept = F.filter(F.zip_with(states, mask, lambda s, m: F.struct(s.alias("s"), m.alias("m"))), lambda x: x["m"] != 0)
    zero = F.transform(states[0], lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda sums, x: F.zip_with(sums, x["s"].cast("array<double>"), lambda p, q: p + q))
    return scaled(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))


def representation(scores: DataFrame | None, vectors: DataFrame | None, by_scores: bool) -> tuple[DataFrame, bool]:
    """(topic table, whether it is the scores'): the representation asked for, or the other if that isn't there."""
    wanted, other = (scores, vectors) if by_scores else (vectors, scores)
    if wanted is None and other is None:
        raise ValueError("a model without scores and vectors has no representation")
    return (wanted, by_scores) if wanted is not None else (other, not by_scores)


def mean_vectors(rows: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """key, vector: the mean vector of each group, weighted if asked.

    Positions are summed on the map side, so a group's size doesn't matter and only dimension sums are shuffled.
    """
    exploded = rows.select(key, *([weight] if weight else []), F.posexplode(doubles(F.col(vector))).alias("i", "x"))
    mean = F.sum(F.col("x") * F.col(weight)) / F.sum(weight) if weight else F.avg("x")
    parts = exploded.groupBy(key, "i").agg(mean.alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
