"""Vectors as array columns. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def squared_distance_float(a, b) -> Column:
    """Every step in 32 bits."""
    d = F.zip_with(a, b, lambda x, y: ((x.cast("float") - y.cast("float")) * (x.cast("float") - y.cast("float"))).cast("float"))
    return F.aggregate(d, F.lit(0).cast("float"), lambda s, x: (s + x).cast("float"))


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def add(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a, k) -> Column:
    return F.transform(a, lambda x: x * k)


def axpy(k, a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: k * x + y)


def linear_score(w, x, bias) -> Column:
    return dot(w, x) + bias


def argmax(a) -> Column:
    """The first place of the largest element, from 0."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1
