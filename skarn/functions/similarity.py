"""Similarities of vectors and passages as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.functions import lexicon as L


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _paired(a: Column, b: Column) -> tuple[Column, Column]:
    """Both cut to the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(_double(a), F.lit(1), n), F.slice(_double(b), F.lit(1), n)


def gamma(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger magnitudes; 0 without any."""
    a, b = _paired(a, b)
    low = _sum(F.zip_with(a, b, lambda x, y: F.least(F.abs(x), F.abs(y))))
    high = _sum(F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x), F.abs(y))))
    return F.when(high > 0, low / high).otherwise(0.0)


def angle(a: Column, b: Column) -> Column:
    """Angle in radians; a right angle if a vector is zero."""
    a, b = _paired(a, b)
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return F.when(norm > 0, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / norm)))).otherwise(math.pi / 2)


def wrapping(radians: Column) -> Column:
    """How often the angle goes into atan(2), rounded half to even."""
    return F.when(radians > 0, F.greatest(F.lit(0.0), F.bround(F.lit(math.atan(2)) / radians))).otherwise(0.0).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def blended(g: Column, d_seq: Column, d_seconds: Column, linked: Column) -> Column:
    """0.7 gamma + 0.3 nearness in time, order or descent; nearness counts from gamma 0.2 on."""
    near = F.greatest(
        F.when(linked, 1.0).otherwise(0.0),
        F.when(d_seq > 0, 1.0 / (1.0 + d_seq)).otherwise(0.0),
        F.when(d_seconds > 0, 60.0 / (60.0 + d_seconds)).otherwise(0.0),
    )
    return 0.7 * g + 0.3 * F.when(g < 0.2, 0.0).otherwise(near)


def directed(a_chain: Column, b_chain: Column, a_active: Column, b_active: Column, a_ops: Column, b_ops: Column) -> Column:
    """0.5 chain fit + 0.3 overlap of active dimensions + 0.2 overlap of operations."""
    last, first = F.get(a_chain, F.size(a_chain) - 1), F.get(b_chain, F.lit(0))
    table = F.create_map(*(F.lit(x) for (s, d), w in L.ADJACENCY.items() for x in (f"{s}>{d}", w)))
    fit = F.when(last == first, 1.0).otherwise(F.coalesce(table[F.concat(last, F.lit(">"), first)], F.lit(0.0)))
    return 0.5 * F.coalesce(fit, F.lit(0.0)) + 0.3 * jaccard(a_active, b_active) + 0.2 * jaccard(a_ops, b_ops)


def golden_threshold() -> float:
    """The least threshold of couplings."""
    return 1 / math.sqrt(5)
