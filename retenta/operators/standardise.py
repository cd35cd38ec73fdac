"""Standardisation and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from retenta.operators.grouping import stat_rows


def fit_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column."""
    return stat_rows(df, columns, lambda c: {"mean": F.avg(F.col(c).cast("double")), "std": F.stddev_pop(c)})


def scale_expressions(fitted: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Scaled columns from fitted numbers; a constant column becomes 0."""
    return {c: (F.when(F.col(c).isNotNull(), F.lit(0.0)) if not sd else (F.col(c) - F.lit(m)) / F.lit(sd))
            for c, (m, sd) in fitted.items()}


def fitted_numbers(fitted: DataFrame) -> dict[str, tuple[float, float]]:
    """The fit as plain numbers: two per column."""
    return {r["column"]: (r["mean"], r["std"]) for r in fitted.collect()}


def scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Standardise ``columns`` with statistics of ``fit_on`` (by default of ``df`` itself)."""
    fitted = fitted_numbers(fit_scale(df if fit_on is None else fit_on, columns))
    return df.withColumns(scale_expressions(fitted))


def class_weights(df: DataFrame, label: str = "attrition_flag") -> DataFrame:
    """Negatives per positive (for trees) and the balanced weight of each class, n / (2 n_class)."""
    n, pos = F.count(label), F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.agg(F.try_divide(neg.cast("double"), pos).alias("positive_weight"),
                  F.try_divide(n.cast("double"), pos * 2).alias("weight_1"),
                  F.try_divide(n.cast("double"), neg * 2).alias("weight_0"))


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(F.struct("weight_0", "weight_1")).scalar()
    return df.withColumn("__w", w).withColumn(
        name, F.when(F.col(label) == 1, F.col("__w.weight_1")).otherwise(F.col("__w.weight_0"))).drop("__w")
