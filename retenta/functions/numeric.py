"""Numeric column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def flag(condition: Column) -> Column:
    """0/1 flag in which an undecided condition counts as not met."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def cut(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval ``(edges[i], edges[i+1]]`` holding ``value``, null outside all."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    out = F.when(value <= F.lit(edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(value <= F.lit(upper), F.lit(label))
    return out


def cut_position(value: Column, edges: Sequence[float]) -> Column:
    """Ordinal of the interval chosen by :func:`cut`, for sorting labels."""
    return cut(value, edges, [str(i) for i in range(len(edges) - 1)]).cast("int")


def null_if_nan(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def clamp(value: Column, low: Column, high: Column) -> Column:
    """``value`` limited to [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def signed(value: Column, digits: int) -> Column:
    """Fixed-point text with an explicit sign."""
    return F.format_string(f"%+.{digits}f", value)
