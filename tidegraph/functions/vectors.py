"""Expressions on array columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_float32(feat) -> Column:
    return F.transform(feat, lambda x: x.cast("float"))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("double"), dim)


def zero_like(vec) -> Column:
    """Zeros for every element, whatever it was (NaN, infinite and null included)."""
    return F.transform(vec, lambda x: F.lit(0.0).cast("double"))


def time_encode(dt, dim: int) -> Column:
    """cos(dt * 10**(-9 i / (dim-1))) for i in 0..dim-1: the initial time code of a layer."""
    dt = F.col(dt) if isinstance(dt, str) else dt
    steps = F.array(*[F.lit(float(10.0 ** (-9.0 * i / (dim - 1)))) for i in range(dim)]) if dim > 1 \
        else F.array(F.lit(1.0))
    return F.transform(steps, lambda w: F.cos(dt.cast("double") * w))


def leaky_relu(col, slope: float = 0.2) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col > 0, col).otherwise(col * F.lit(slope))


def sigmoid(col) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return 1 / (1 + F.exp(-col))


def pair_product(left, right) -> Column:
    """Elementwise product of two vectors."""
    return F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))


def pair_products(left, rights) -> Column:
    """The products of one vector with each of an array of vectors, as for several negatives."""
    return F.transform(rights, lambda right: pair_product(left, right))


def vector_sum(vec) -> Column:
    return F.aggregate(vec, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))
