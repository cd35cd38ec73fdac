"""Data-quality profile of the subject table and the go/no-go verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from retenta import schema
from retenta.functions.numeric import cut, cut_position
from retenta.operators.grouping import stat_rows
from retenta.operators.ordering import exact_quantiles, quantile_map

LABEL = "attrition_flag"


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


# --------------------------------------------------------------- shape and completeness
def shape(df: DataFrame, required: Sequence[str] = schema.REQUIRED) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(len(missing)).cast("bigint").alias("n_missing_required"),
        F.lit(", ".join(missing)).alias("missing_required"),
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with nulls: count and percentage (2 decimals)."""
    rows = stat_rows(df, columns or df.columns, lambda c: {
        "n_null": F.count_if(F.col(c).isNull()), "n_rows": F.count("*")})
    return rows.filter("n_null > 0").select(
        "column", "n_null", F.bround(F.col("n_null") * 100.0 / F.col("n_rows"), 2).alias("pct"))


def duplicate_keys(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """Rows beyond the first of each key, null counted as one key; ``approximate`` is for monitoring only."""
    distinct = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    has_null = F.max(F.col(key).isNull().cast("bigint"))
    return df.agg((F.count("*") - distinct - F.coalesce(has_null, F.lit(0))).alias("n_duplicates"))


def label_values(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Distinct non-null labels with their counts and whether they are binary."""
    return (df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("double").alias("value"))
            .agg(F.count("*").alias("n_rows")).withColumn("is_binary", F.col("value").isin(0.0, 1.0)))


# --------------------------------------------------------------- rates
def overall_rate(df: DataFrame, target: float = 0.18, tolerance: float = 0.08, label: str = LABEL) -> DataFrame:
    rate = F.avg(label)
    deviation = F.abs(rate - F.lit(target))
    return df.agg(F.bround(rate, 4).alias("overall_rate"), F.lit(target).alias("target_rate"),
                  F.bround(deviation, 4).alias("deviation"), (deviation > tolerance).alias("high_deviation"))


def rates_by_dimension(df: DataFrame, dimensions: Sequence[str] = ("band", "department", "circle", "gender"),
                       label: str = LABEL) -> DataFrame:
    """Rate and count per value of each dimension, in one pass with grouping sets; null values dropped."""
    dims = present(df, dimensions)
    source = df.select(*[F.col(d).cast("string").alias(d) for d in dims], F.col(label).alias("__label"))
    grouped = source.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.grouping_id().alias("gid"), F.avg("__label").alias("attrition_rate"), F.count("__label").alias("n"))
    full = 2 ** len(dims) - 1
    ids = {full - 2 ** (len(dims) - 1 - i): d for i, d in enumerate(dims)}
    which = F.coalesce(*[F.when(F.col("gid") == g, F.lit(d)) for g, d in ids.items()])
    value = F.coalesce(*[F.when(F.col("gid") == g, F.col(d)) for g, d in ids.items()])
    return (grouped.select(which.alias("dimension"), value.alias("value"), "attrition_rate", "n")
            .filter(F.col("value").isNotNull()))


# --------------------------------------------------------------- distributions
def describe(df: DataFrame, columns: Sequence[str] = schema.NUMERIC) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    cols = present(df, columns)
    basic = stat_rows(df, cols, lambda c: {
        "n": F.count(c), "mean": F.avg(F.col(c).cast("double")), "std": F.stddev_samp(c),
        "min": F.min(F.col(c).cast("double")), "max": F.max(F.col(c).cast("double"))})
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).select(
        "column", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))
    return basic.join(quartiles, "column", "left").select(
        "column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def range_counts(df: DataFrame, ranges: dict[str, tuple[float, float]] = schema.EXPECTED_RANGES) -> DataFrame:
    """Values strictly below and above the expected range per column."""
    return stat_rows(df, present(df, list(ranges)), lambda c: {
        "below_min": F.count_if(F.col(c) < ranges[c][0]), "above_max": F.count_if(F.col(c) > ranges[c][1])})


def histogram(df: DataFrame, columns: Sequence[str] = schema.NUMERIC, bins: int = 30) -> DataFrame:
    """Equal-width bin counts per column between its minimum and maximum; the last bin is closed."""
    cols = present(df, columns)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    ends = data.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols]).select(
        F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c))])).scalar()
    long = data.unpivot([], cols, "column", "value").filter(F.col("value").isNotNull())
    long = long.withColumn("__e", ends)
    lo, hi = F.col("__e")[F.col("column")]["lo"], F.col("__e")[F.col("column")]["hi"]
    place = F.floor(F.coalesce(F.try_divide((F.col("value") - lo) * bins, hi - lo), F.lit(0.0)))
    return (long.groupBy("column", F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin"))
            .agg(F.count("*").alias("n")))


# --------------------------------------------------------------- segments
def _overall(df: DataFrame, label: str) -> Column:
    return df.agg(F.avg(label)).scalar()


def risk_segments(df: DataFrame, keys: Sequence[str] = ("band", "department"), times: float = 2.0,
                  min_rows: int = 10, id_column: str = "employee_id", label: str = LABEL) -> DataFrame:
    """Segments whose rate, rounded to 3 decimals, exceeds ``times`` the overall rate."""
    overall = F.col("__overall")
    grouped = df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.bround(F.avg(label), 3).alias("attrition_rate"), F.count(id_column).alias("n"))
    return grouped.withColumn("__overall", _overall(df, label)).filter((F.col("attrition_rate") > overall * times) & (F.col("n") >= min_rows)).select(
        F.concat(F.lit("Band "), F.col(keys[0]).cast("string"), F.lit(" - "), F.col(keys[1])).alias("segment"),
        "attrition_rate", "n",
        F.format_string("%.1f×", F.col("attrition_rate") / overall).alias("vs_overall"))


def high_performer_rate(df: DataFrame, at_least: float = 4.0, times: float = 1.5, label: str = LABEL) -> DataFrame:
    strong = F.col("perf_rating_current") >= at_least
    rate, overall = F.avg(F.when(strong, F.col(label))), F.avg(label)
    return df.agg(F.bround(rate, 4).alias("rate"), F.count_if(strong).alias("n"),
                  F.format_string("%.1f×", F.try_divide(rate, overall)).alias("vs_overall"),
                  F.when(rate > overall * times, "CRITICAL").otherwise("OK").alias("flag"))


def rate_pivot(df: DataFrame, departments: Sequence[str], label: str = LABEL) -> DataFrame:
    """Band by department grid of rates, 3 decimals."""
    grid = df.groupBy("band").pivot("department", sorted(departments)).agg(F.avg(label))
    return grid.select("band", *[F.bround(F.col(f"`{d}`"), 3).alias(d) for d in sorted(departments)])


def bucket_rates(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str],
                 label: str = LABEL) -> DataFrame:
    """Rate per right-closed bucket; values outside every bucket are reported as ``unbucketed``."""
    bucket = F.coalesce(cut(F.col(column), edges, labels), F.lit("unbucketed"))
    return (df.groupBy(bucket.alias("bucket"),
                       F.coalesce(cut_position(F.col(column), edges), F.lit(-1)).alias("position"))
            .agg(F.bround(F.avg(label), 3).alias("attrition_rate"), F.count("*").alias("n")))


def post_appraisal_signal(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Whether the rate within two months of a hike exceeds the rate at 6 to 12 months (missing counts as 0)."""
    bucket = cut(F.col("months_since_hike"), schema.HIKE_EDGES, schema.HIKE_LABELS)

    def rate(name: str) -> Column:
        return F.coalesce(F.bround(F.avg(F.when(bucket == name, F.col(label))), 3), F.lit(0.0))

    return df.agg(rate("0-2m").alias("rate_0_2m"), rate("6-12m").alias("rate_6_12m"),
                  (rate("0-2m") > rate("6-12m")).alias("confirmed"))


def new_joiner_rate(df: DataFrame, months: float = 12, high: float = 0.30, label: str = LABEL) -> DataFrame:
    new = F.col("tenure_months") <= months
    rate = F.avg(F.when(new, F.col(label)))
    return df.agg(F.bround(rate, 4).alias("rate"), F.count_if(new).alias("n"),
                  F.when(rate > high, "HIGH").otherwise("OK").alias("flag"))


# --------------------------------------------------------------- outliers
def iqr_outliers(df: DataFrame, columns: Sequence[str] = schema.NUMERIC, times: float = 3.0) -> DataFrame:
    """Columns with values outside the extreme fences: counts, fences and maximum (3 decimals)."""
    cols = present(df, columns)
    q = F.col("__q")

    def stats(c: str) -> dict[str, Column]:
        spread = (q[c][1] - q[c][0]) * times
        low, high = q[c][0] - spread, q[c][1] + spread
        return {"extreme_low": F.count_if(F.col(c) < low), "extreme_high": F.count_if(F.col(c) > high),
                "lower_fence": F.bround(F.first(low), 3), "upper_fence": F.bround(F.first(high), 3),
                "max_value": F.bround(F.max(F.col(c).cast("double")), 3)}

    fenced = df.withColumn("__q", quantile_map(df, cols, [0.25, 0.75]))
    return stat_rows(fenced, cols, stats).filter("extreme_low + extreme_high > 0")


# --------------------------------------------------------------- readiness
def readiness(df: DataFrame, target: float = 0.18, tolerance: float = 0.08, max_null_pct: float = 20.0,
              max_out_of_range: int = 10, key: str = "employee_id", label: str = LABEL) -> DataFrame:
    """Every rule of the go/no-go decision as ``(severity, rule, column, value, triggered)`` rows."""
    spark = df.sparkSession
    missing = [("BLOCKER", "missing_required", c, 1.0, True) for c in schema.REQUIRED if c not in df.columns]
    out = spark.createDataFrame(missing, "severity string, rule string, column string, value double, triggered boolean")

    def add(rows: DataFrame, severity: str, rule: str, column: Column, value: Column, triggered: Column) -> None:
        nonlocal out
        out = out.unionByName(rows.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                                          column.alias("column"), value.cast("double").alias("value"),
                                          triggered.alias("triggered")))

    required = present(df, schema.REQUIRED)
    if required:
        nulls = stat_rows(df, required, lambda c: {
            "pct": F.bround(F.count_if(F.col(c).isNull()) * 100.0 / F.count("*"), 2)})
        add(nulls, "BLOCKER", "null_rate", F.col("column"), F.col("pct"), F.col("pct") > max_null_pct)
    if key in df.columns:
        add(duplicate_keys(df, key), "BLOCKER", "duplicate_key", F.lit(key), F.col("n_duplicates"),
            F.col("n_duplicates") > 0)
    if label in df.columns:
        bad = df.agg(F.count_if(~F.col(label).cast("double").isin(0.0, 1.0)).alias("n"),
                     F.abs(F.avg(label) - target).alias("deviation"))
        add(bad, "BLOCKER", "non_binary_label", F.lit(label), F.col("n"), F.col("n") > 0)
        add(bad, "WARNING", "rate_deviation", F.lit(label), F.bround("deviation", 4), F.col("deviation") > tolerance)
    ranged = present(df, [c for c in schema.NUMERIC if c in schema.EXPECTED_RANGES])
    if ranged:
        spread = range_counts(df.select(*ranged)).withColumn("n", F.col("below_min") + F.col("above_max"))
        add(spread, "WARNING", "out_of_range", F.col("column"), F.col("n"), F.col("n") > max_out_of_range)
    return out


def verdict(rules: DataFrame) -> DataFrame:
    blocked = F.coalesce(F.bool_or((F.col("severity") == "BLOCKER") & F.col("triggered")), F.lit(False))
    return rules.agg(
        F.when(blocked, "BLOCKED").otherwise("READY").alias("verdict"), (~blocked).alias("can_proceed"),
        F.count_if((F.col("severity") == "BLOCKER") & F.col("triggered")).alias("n_blockers"),
        F.count_if((F.col("severity") == "WARNING") & F.col("triggered")).alias("n_warnings"))


def flag_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return stat_rows(df, columns, lambda c: {"n_fired": F.sum(F.col(c).cast("bigint"))})
