"""Column expressions on vectors kept as arrays of numbers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, functions as F


def bind(value: Column, use) -> Column:
    """use(value) with `value` evaluated once per row.

    Spark evaluates an expression inside a lambda anew for every element, and copies the definition of
    a computed column into each place that names it; an argument of a lambda is neither.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, added from left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    def scaled(x, y, squares):
        return F.when(squares > 0, dot(x, y) / F.sqrt(squares)).otherwise(F.lit(0.0))

    return bind(a, lambda x: bind(b, lambda y: bind(dot(x, x) * dot(y, y), lambda squares: scaled(x, y, squares))))


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    def divide(vector, length):
        return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))

    return bind(v, lambda vector: bind(norm(vector), lambda length: divide(vector, length)))


def rounded(value: Column, decimals: int) -> Column:
    """Half-up rounding by arithmetic alone, so that every engine agrees on it."""
    scale = float(10 ** decimals)
    return F.floor(value * scale + 0.5) / scale


__all__ = ["array_to_vector", "bind", "cosine", "dot", "l2_normalise", "norm", "rounded", "vector_to_array"]
