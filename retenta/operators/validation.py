"""Checks of a feature table before training. All column statistics come from one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from retenta import schema
from retenta.operators.ordering import ordered_split

CHECK_SCHEMA = "check string, column string, metric string, value double, passed boolean, severity string, message string"
SKIP_VARIANCE = ("dept_", "circle_", "interact_")


def _row(check: str, column: str, metric: str, value: Column, passed: Column, message: Column) -> Column:
    passed = F.coalesce(passed, F.lit(False))
    return F.struct(
        F.lit(check).alias("check"), F.lit(column).alias("column"), F.lit(metric).alias("metric"),
        value.cast("double").alias("value"), passed.alias("passed"),
        F.when(passed, "INFO").otherwise("CRITICAL").alias("severity"), message.cast("string").alias("message"))


def _text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


class Checks:
    """Rules for one table: each method yields check rows built from aggregates, so that any selection of them is
    evaluated together by :meth:`run` in one pass."""

    def __init__(self, df: DataFrame, contract: Sequence[str], label: str = "attrition_flag",
                 key: str = "employee_id"):
        self.df, self.contract, self.label, self.key = df, list(contract), label, key

    def have(self, prefix: str) -> list[str]:
        return [c for c in self.df.columns if c.startswith(prefix)]

    def present_features(self) -> list[str]:
        return [c for c in self.contract if c in self.df.columns]

    def inputs(self) -> list[Column]:
        n = F.lit(len(self.df.columns))
        m = F.lit(len(self.contract))
        return [_row("inputs_exist", "", "n_columns", n, n > 0, F.format_string("%d columns", n)),
                _row("contract_exists", "", "n_features", m, m > 0, F.format_string("%d features", m))]

    def row_count(self, minimum: int = 500) -> list[Column]:
        n = F.count("*")
        return [_row("row_count", "", "n_rows", n, n >= minimum, F.format_string("%d rows, need %d", n, F.lit(minimum)))]

    def features_present(self) -> list[Column]:
        missing = [c for c in self.contract if c not in self.df.columns]
        return [_row("features_present", ", ".join(missing), "n_missing", F.lit(len(missing)),
                     F.lit(not missing), F.lit(f"missing: {missing}" if missing else "all present"))]

    def no_nulls(self) -> list[Column]:
        out = []
        for c in self.present_features():
            n = F.count_if(F.col(c).isNull())
            out.append(_row("no_nulls", c, "n_null", n, n == 0, F.format_string("%d nulls in %s", n, F.lit(c))))
        return out

    def label_valid(self) -> list[Column]:
        if self.label not in self.df.columns:
            return [_row("label_valid", self.label, "missing", F.lit(1), F.lit(False), F.lit("label column missing"))]
        value = F.col(self.label).cast("double")
        bad, nulls = F.count_if(~value.isin(0.0, 1.0)), F.count_if(value.isNull())
        message = (F.when(bad > 0, F.format_string("%d non-binary labels", bad))
                   .when(nulls > 0, F.format_string("%d null labels", nulls))
                   .otherwise(F.format_string("binary, rate=%.1f%%", F.avg(value) * 100)))
        return [_row("label_valid", self.label, "n_invalid", bad + nulls, (bad == 0) & (nulls == 0), message)]

    def key_unique(self) -> list[Column | DataFrame]:
        if self.key not in self.df.columns:
            return [_row("key_unique", self.key, "missing", F.lit(1), F.lit(False), F.lit("key column missing"))]
        # Counted by itself: a distinct count next to the other checks would carry all their buffers through a shuffle by key.
        dup = F.coalesce(F.sum(F.col("count") - 1), F.lit(0))
        row = _row("key_unique", self.key, "n_duplicates", dup, dup == 0, F.format_string("%d duplicate keys", dup))
        return [self.df.groupBy(self.key).count().agg(F.array(row).alias("rows")).select(F.inline("rows"))]

    def class_balance(self, low: float = 0.05, high: float = 0.60) -> list[Column]:
        rate = F.avg(self.label)
        return [_row("class_balance", self.label, "rate", rate, (rate >= low) & (rate <= high),
                     F.format_string("rate %.1f%%", rate * 100))]

    def ranges(self, limits=schema.FEATURE_RANGES, tolerance: float = 0.05) -> list[Column]:
        out = []
        for c, (low, high) in limits.items():
            if c in self.df.columns:
                n = F.count_if(F.col(c) < low) + F.count_if(F.col(c) > high)
                out.append(_row("ranges", c, "n_outside", n, n <= F.count("*") * tolerance,
                                F.format_string("%d values outside [%s, %s]", n, F.lit(str(low)), F.lit(str(high)))))
        return out

    def variance(self) -> list[Column]:
        out = []
        for c in self.present_features():
            if not c.startswith(SKIP_VARIANCE):
                sd = F.stddev_samp(c)
                out.append(_row("variance", c, "std", sd, F.coalesce(sd != 0, F.lit(True)),
                                F.format_string("std of %s", F.lit(c))))
        return out

    def interactions(self, minimum: float = 0.002) -> list[Column]:
        return [_row("interactions", c, "fire_rate", F.avg(c), F.avg(c) >= minimum,
                     F.format_string("fires for %.2f%%", F.avg(c) * 100)) for c in self.have("interact_")]

    def dummies(self) -> list[Column]:
        out = []
        for prefix in ("dept_", "circle_"):
            cols = self.have(prefix)
            if cols:
                total = sum((F.coalesce(F.col(c), F.lit(0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0)))
                full = F.bool_and(total == 1)
                out.append(_row("dummies", prefix, "always_one", full.cast("int"), ~full,
                                F.when(full, "reference category not dropped").otherwise("reference dropped")))
        return out

    def all(self) -> list[Column | DataFrame]:
        return [*self.inputs(), *self.row_count(), *self.features_present(), *self.no_nulls(), *self.label_valid(),
                *self.key_unique(), *self.class_balance(), *self.ranges(), *self.variance(), *self.interactions(),
                *self.dummies()]

    def run(self, rows: Sequence[Column | DataFrame]) -> DataFrame:
        """One pass for all checks that are columns; checks that bring their own frame are added."""
        columns, frames = [r for r in rows if isinstance(r, Column)], [r for r in rows if isinstance(r, DataFrame)]
        if columns:
            frames.insert(0, self.df.agg(F.array(*columns).alias("rows")).select(F.inline("rows")))
        return reduce(DataFrame.unionByName, frames)


def split_check(df: DataFrame, order_col: str, label: str = "attrition_flag", fraction: float = 0.80,
                minimum: float = 0.05, max_drift: float = 0.15) -> DataFrame:
    """Class rates of the ordered split: too small a class is reported before drift."""
    split = ordered_split(df.select(order_col, label), order_col, fraction)
    train = F.avg(F.when(F.col("is_train"), F.col(label)))
    test = F.avg(F.when(~F.col("is_train"), F.col(label)))
    drift = F.abs(train - test)
    thin = (train < minimum) | (test < minimum)
    message = (F.when(thin, F.lit("near-empty class")).when(drift > max_drift, F.lit("large drift"))
               .otherwise(F.lit("balanced")))
    row = _row("split", label, "drift", drift, ~thin & (drift <= max_drift), message)
    return split.agg(F.array(row).alias("rows"), train.alias("train_rate"), test.alias("test_rate")).select(
        F.inline("rows"))


def validate_features(df: DataFrame, contract: Sequence[str], order_col: str, **names) -> DataFrame:
    """All checks as one long table."""
    checks = Checks(df, contract, **names)
    return checks.run(checks.all()).unionByName(split_check(df, order_col, checks.label))


def summary(results: DataFrame) -> DataFrame:
    """One row: per check the worst outcome decides; the table can proceed when every check passed."""
    per_check = results.groupBy("check").agg(F.bool_and("passed").alias("passed"))
    return per_check.agg(F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"),
                         F.count_if(~F.col("passed")).alias("n_failed"),
                         F.coalesce(F.bool_and("passed"), F.lit(False)).alias("can_proceed"))
