"""Vector arithmetic on array columns, in double precision and in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def l2(a: Column, b: Column) -> Column:
    """Negated Euclidean distance, so that larger is nearer."""
    return -F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


METRICS = {"cosine": cosine, "dot": dot, "l2": l2}


def unit(a: Column) -> Column:
    """At length one; zero stays zero."""
    return F.transform(_doubles(a), lambda x: F.when(norm(a) == 0, x).otherwise(x / norm(a)))


def checked(a: Column, dimension: int) -> Column:
    """a, or an error where its dimension is another."""
    return F.when(F.size(a) == dimension, a).otherwise(F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {dimension}, got "), F.size(a).cast("string"))))
