"""Similarity of two arrays as column expressions; on arrays of tokens or of hashes.

A quotient of nothing by nothing is NaN. Nulls inside an array are ignored; a null array gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def _clean(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _ratio(n: Column, d: Column) -> Column:
    return F.when(n.isNull() | d.isNull(), F.lit(None).cast("double")).when(d == 0, F.lit(float("nan"))).otherwise(n / F.nullif(d, F.lit(0)))


def jaccard_similarity(a: Column, b: Column) -> Column:
    a, b = _clean(a), _clean(b)
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def jaccard_dissimilarity(a: Column, b: Column) -> Column:
    return 1 - jaccard_similarity(a, b)


def _merged(a: Column, b: Column) -> Column:
    """Elements of both arrays in order, those of a (``of_b`` 0) before equal ones of b."""
    side = lambda v, n: F.transform(v, lambda x: F.struct(x.alias("x"), F.lit(n).alias("of_b")))
    return F.sort_array(F.concat(side(a, 0), side(b, 1)))


def _nothing(a: Column, *names: str) -> Column:
    """What a pass over elements of a begins with: no element and zeros."""
    return F.struct(F.get(a, F.lit(-1)).alias("x"), *[F.lit(0).alias(n) for n in names])


def jaccard_bag_similarity(a: Column, b: Column) -> Column:
    """Common elements, each as often as both sides have it, over the length of both; 0.5 at most. One pass in order."""
    x, y = _clean(a), _clean(b)

    def step(acc: Column, e: Column) -> Column:
        same = e["x"].eqNullSafe(acc["x"])
        held = lambda n: F.when(same, acc[n]).otherwise(0)
        return F.struct(e["x"].alias("x"), (held("p") + 1 - e["of_b"]).alias("p"), (held("q") + e["of_b"]).alias("q"), (acc["n"] + F.when(same, 0).otherwise(F.least(acc["p"], acc["q"]))).alias("n"))

    common = F.aggregate(_merged(x, y), _nothing(x, "p", "q", "n"), step, lambda acc: acc["n"] + F.least(acc["p"], acc["q"]))
    return _ratio(F.when(a.isNotNull() & b.isNotNull(), common), F.size(x) + F.size(y))


def matching_tokens(a: Column, b: Column) -> Column:
    """Elements of b that are in a, in order and with repetitions. Only what both have in common is searched."""
    return let(F.array_intersect(b, a), lambda c: F.filter(b, lambda x: F.array_contains(c, x)))


def count_matches(a: Column, b: Column) -> Column:
    """How many elements of b are in a, by one pass over both in order."""

    def step(acc: Column, e: Column) -> Column:
        mine = e["of_b"] == 0
        return F.struct(F.when(mine, e["x"]).otherwise(acc["x"]).alias("x"), (acc["n"] + F.when(~mine & e["x"].eqNullSafe(acc["x"]), 1).otherwise(0)).alias("n"))

    common = F.aggregate(_merged(F.array_distinct(_clean(a)), _clean(b)), _nothing(_clean(a), "n"), step, lambda acc: acc["n"])
    return F.when(a.isNotNull() & b.isNotNull(), common)


def ratio_of_matches(a: Column, b: Column) -> Column:
    """Share of b's elements that are in a; directional."""
    return _ratio(count_matches(a, b), F.when(b.isNotNull(), F.size(_clean(b))))
