"""Group statistics attached to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from retenta.session import stage


def attach_group_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Add per-group aggregates to every row; rows with a null key belong to no group and get nulls.

    The aggregate is staged first, so the planner knows its real size: it broadcasts the result when that is below
    the session's threshold, and otherwise runs a sort-merge join, where adaptive execution splits hot keys.
    """
    table = df.dropna(subset=list(keys)).groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()])
    joined = df.join(stage(table, "group-stats"), list(keys), "left")
    return joined.select(*df.columns, *stats)


def stat_rows(df: DataFrame, columns: Sequence[str], stats) -> DataFrame:
    """One row per column with the named statistics, all computed by a single aggregate over ``df``.

    ``stats(c)`` returns ``{name: aggregate}`` for column ``c``; names and types must agree between columns.
    """
    per_column = [F.struct(F.lit(c).alias("column"), *[a.alias(n) for n, a in stats(c).items()]) for c in columns]
    return df.agg(F.array(*per_column).alias("rows")).select(F.inline("rows"))
