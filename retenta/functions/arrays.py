"""Array and vector column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def top_drivers(values: Sequence[tuple[str, Column]], n: int = 3, digits: int = 4) -> Column:
    """The ``n`` entries of largest magnitude, sign kept, earlier entries first on ties."""
    entries = F.array(*[
        F.struct((-F.abs(c)).alias("k"), F.lit(i).alias("pos"), F.lit(name).alias("feature"),
                 c.alias("shap"))
        for i, (name, c) in enumerate(values)
    ])
    best = F.slice(F.array_sort(entries), 1, n)
    return F.transform(best, lambda d: F.struct(d["feature"].alias("feature"),
                                                F.bround(d["shap"], digits).alias("shap")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
