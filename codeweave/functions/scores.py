"""Similarity of token sets and vectors, and the labels drawn from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the Jaccard index and of the share of the left side: lookup and linking, then classification.
LOOKUP, CLASSIFY = (0.4, 0.6), (0.35, 0.65)


def blended(shared: Column, left: Column, right: Column, weights: tuple[float, float] = LOOKUP) -> Column:
    """Weighted sum of Jaccard index and overlap with the left set, from set sizes; 0 where a side is empty. One expression everywhere."""
    j, o = weights
    score = F.lit(j) * (shared / (left + right - shared)) + F.lit(o) * (shared / left)
    return F.when((left > 0) & (right > 0), score).otherwise(F.lit(0.0))


def token_score(left: Column, right: Column, weights: tuple[float, float] = LOOKUP) -> Column:
    return blended(F.size(F.array_intersect(left, right)), F.size(left), F.size(right), weights)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.55, "high").when(score >= 0.30, "medium").when(score >= 0.15, "low").otherwise("very_low")


def record_confidence(fn: Column, price: Column, description: Column) -> Column:
    """By what a record has: name and price, name, description only, or neither."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(fn) & has(price), "high").when(has(fn), "medium").when(has(description), "low").otherwise("very_low")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalised(v: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
