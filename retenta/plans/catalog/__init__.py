"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from retenta.plans.subjects import SUBJECTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("ingest", "profile", "features", "reports", "statistics", "models", "survival", "text", "sources")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its check where SQL can express it."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


_FITTED: dict[tuple, object] = {}


def once(spark: SparkSession, d: str, kind: str, make: Callable[[], object]):
    """What is fitted on a folder is kept for the session: scoring, attribution and metadata use one and the same model."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def on_subjects(body: str, *ctes: str) -> str:
    """SQL over the subject binding, with further common table expressions."""
    return "WITH " + ",\n".join([SUBJECTS_SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + body


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals, so that summation order does not show."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def steady(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, with ties and what lies within float noise of a tie rounded up.

    Both engines do this the same way (``steady_sql``); their own roundings treat ties apart, and a mean summed in another
    order may lie just above or below one.
    """
    def value(c: str):
        return F.floor(F.col(f"`{c}`") * F.lit(1e6) + F.lit(0.500001)).cast("double") / F.lit(1e6)
    return df.select(*[value(c).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def steady_sql(expression: str) -> str:
    return f"floor(CAST({expression} AS DOUBLE) * 1e6 + 0.500001) / 1e6"


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
