"""Expected value, risk tiers, scored table, and the reports over it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from retenta import schema
from retenta.config import DEFAULTS, Settings
from retenta.operators.ordering import top_k

URGENT = ("CRITICAL", "HIGH")
TOP_COLUMNS = ("employee_id", "band", "department", "p_attrition", "ev", "median_survival_months")


# --------------------------------------------------------------- row level
def expected_value(p: Column, settings: Settings = DEFAULTS) -> Column:
    return p * settings.replacement_cost - settings.intervention_cost


def risk_tier(p: Column, ev: Column, settings: Settings = DEFAULTS) -> Column:
    high, medium = settings.high_threshold, settings.medium_threshold
    return (F.when((p >= 0.70) & (ev >= high), "CRITICAL")
            .when((p >= 0.55) & (ev >= high * 0.5), "HIGH")
            .when((p >= 0.40) & (ev >= medium), "MEDIUM")
            .otherwise("LOW"))


def add_value_and_tier(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Expected value rounded half-even to whole units, then the tier from the rounded value."""
    return (df.withColumn("ev", F.bround(expected_value(F.col("p_attrition"), settings), 0))
            .withColumn("risk_tier", risk_tier(F.col("p_attrition"), F.col("ev"), settings)))


def scored_table(scores: DataFrame, profile: DataFrame, key: str = "employee_id") -> DataFrame:
    """Scores left-joined to the profile columns, one row per scored subject."""
    columns = [c for c in schema.PROFILE_COLUMNS if c in profile.columns]
    keep = [c for c in ("p_attrition", "median_survival_months", "survival_is_infinite", "ev", "risk_tier",
                        "top_shap_drivers") if c in scores.columns]
    return scores.select(key, *keep).join(profile.select(key, *columns), key, "left")


def by_priority(df: DataFrame, key: str = "employee_id") -> DataFrame:
    return df.orderBy(F.desc("ev"), key)


# --------------------------------------------------------------- filters
def one_subject(df: DataFrame, value: str, key: str = "employee_id") -> DataFrame:
    return df.filter(F.col(key) == value)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise LookupError(message)
    return df


def in_tiers(df: DataFrame, tiers: Sequence[str]) -> DataFrame:
    return df.filter(F.col("risk_tier").isin(*tiers))


def scope_tiers(scope: str) -> tuple[str, ...]:
    """Tiers covered by a budget scope; an unknown scope covers the narrowest set."""
    return schema.SCOPES.get(scope.upper(), schema.SCOPES["CRITICAL"])


def in_scope(df: DataFrame, scope: str) -> DataFrame:
    return in_tiers(df, scope_tiers(scope))


def same_text(column: str, value: str) -> Column:
    return F.lower(column) == F.lower(F.lit(value))


def tier_and_route(df: DataFrame, tiers: Sequence[str], routes: Sequence[str]) -> DataFrame:
    """Both filters together; when either selection is empty nothing is filtered."""
    if not tiers or not routes:
        return df
    return df.filter(F.col("risk_tier").isin(*tiers) & F.col("routed_to").isin(*routes))


# --------------------------------------------------------------- reports
def _count_tier(*tiers: str) -> Column:
    return F.count_if(F.col("risk_tier").isin(*tiers))


def tier_distribution(df: DataFrame) -> DataFrame:
    """Count and share of all four tiers, zero-filled, from one aggregate."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(t).alias("risk_tier"), _count_tier(t).alias("n"),
                              F.coalesce(F.try_divide(_count_tier(t) * 100.0, F.count("*")), F.lit(0.0)).alias("pct"))
                     for i, t in enumerate(schema.TIERS)])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def value_totals(df: DataFrame) -> DataFrame:
    """Value at stake in the urgent tiers, and means of the critical tier (infinite survival counted apart)."""
    critical = F.col("risk_tier") == "CRITICAL"
    months = F.col("median_survival_months")
    endless = months == float("inf")
    return df.agg(
        F.coalesce(F.sum(F.when(F.col("risk_tier").isin(*URGENT), F.col("ev"))), F.lit(0.0)).alias("urgent_ev"),
        F.avg(F.when(critical, F.col("p_attrition"))).alias("critical_avg_p"),
        F.avg(F.when(critical & ~endless, months)).alias("critical_avg_survival"),
        F.count_if(critical & (endless | months.isNull())).alias("critical_infinite"))


def weekly_counts(df: DataFrame) -> DataFrame:
    n, c, h, m = F.count("*"), _count_tier("CRITICAL"), _count_tier("HIGH"), _count_tier("MEDIUM")
    return df.agg(n.alias("total_employees"), c.alias("critical_count"), h.alias("high_count"),
                  m.alias("medium_count"), (n - c - h - m).alias("low_count"))


def budget_summary(df: DataFrame, settings: Settings = DEFAULTS, tiers: Sequence[str] = URGENT) -> DataFrame:
    """Value, expected replacements, avoided cost and return over the urgent tiers; zeros when there are none."""
    chosen = in_tiers(df, tiers)
    ev = F.coalesce(F.sum("ev"), F.lit(0.0))
    p = F.coalesce(F.sum("p_attrition"), F.lit(0.0))
    avoided = p * settings.replacement_cost
    return chosen.agg(
        F.bround(ev, 0).alias("total_ev_urgent"), F.bround(p, 1).alias("expected_replacements"),
        F.bround(avoided, 0).alias("replacement_cost_avoided"),
        F.bround(avoided / F.greatest(ev, F.lit(1.0)), 2).alias("net_roi"),
        (F.count("*") * settings.intervention_cost).alias("intervention_cost_total"))


def budget_scenarios(df: DataFrame, settings: Settings = DEFAULTS,
                     scopes: Sequence[str] = tuple(schema.SCOPES)) -> DataFrame:
    """Cost, retentions, return and payback of acting on each scope; all scopes come from one aggregate."""
    def scenario(scope: str) -> Column:
        chosen = F.col("risk_tier").isin(*scope_tiers(scope))
        n = F.count_if(chosen)
        cost = n * settings.intervention_cost
        retained = F.coalesce(F.sum(F.when(chosen, F.col("p_attrition") * settings.retention_success)), F.lit(0.0))
        avoided = retained * settings.replacement_cost
        return F.struct(
            F.lit(scope).alias("simulation_tier"), n.alias("employees_affected"),
            F.bround(cost, 0).alias("total_intervention_cost"), F.bround(retained, 1).alias("expected_retentions"),
            F.bround(avoided, 0).alias("replacement_cost_avoided"),
            F.bround(avoided / F.greatest(cost, F.lit(1.0)), 2).alias("net_roi"),
            F.bround(cost / F.greatest(avoided / 12, F.lit(1.0)), 1).alias("payback_months"))

    return df.agg(F.array(*[scenario(s) for s in scopes]).alias("rows")).select(F.inline("rows"))


def derived_shares(scenarios: DataFrame) -> DataFrame:
    """Net benefit and retentions per affected subject of each scenario."""
    return scenarios.select(
        "simulation_tier",
        (F.col("replacement_cost_avoided") - F.col("total_intervention_cost")).alias("net_benefit"),
        (F.col("expected_retentions") / F.greatest(F.col("employees_affected"), F.lit(1))).alias("retention_share"))


def critical_share(df: DataFrame) -> DataFrame:
    return df.agg(F.try_divide(_count_tier("CRITICAL").cast("double"), F.count("*")).alias("critical_share"))


class DepartmentReport(NamedTuple):
    grid: DataFrame
    totals: DataFrame
    critical: DataFrame


def department_report(df: DataFrame, department: str | None = None) -> DepartmentReport:
    """Band grid, totals and critical subjects of every department (or of one, matched without regard to case).

    A department without subjects has no row in any part; ``require_rows`` on the totals tells a caller so.
    """
    if department is not None:
        df = df.filter(same_text("department", department))
    grid = df.groupBy("department", "band").agg(
        F.avg("p_attrition").alias("avg_p_attrition"), _count_tier(*URGENT).alias("high_risk_count"),
        F.count("employee_id").alias("total_employees"), F.sum("ev").alias("total_ev"))
    return DepartmentReport(grid, department_overview(df), critical_subjects(df))


def department_overview(df: DataFrame) -> DataFrame:
    return df.groupBy("department").agg(
        F.count("*").alias("total_employees"), F.bround(F.avg("p_attrition"), 3).alias("avg_p_attrition"),
        _count_tier("CRITICAL").alias("critical_count"))


def critical_subjects(df: DataFrame) -> DataFrame:
    return in_tiers(df, ["CRITICAL"]).select("department", "employee_id", "band", "p_attrition", "ev")


def top_per_tier(df: DataFrame, k: int = 10, tiers: Sequence[str] = URGENT) -> DataFrame:
    return top_k(in_tiers(df, tiers), k, [F.desc("ev"), F.col("employee_id")], ["risk_tier"])


def top_overall(df: DataFrame, k: int = 5) -> DataFrame:
    return top_k(df, k, [F.desc("ev"), F.col("employee_id")])


def score_upload(upload: DataFrame, scored: DataFrame, key: str = "employee_id") -> DataFrame:
    """Uploaded keys left-joined to their scores; repeated keys stay repeated and misses are marked."""
    if key not in upload.columns:
        raise ValueError(f"the upload needs a '{key}' column")
    facts = scored.select(key, "p_attrition", "ev", "risk_tier", "median_survival_months")
    return upload.join(facts, key, "left").withColumn(
        "status", F.when(F.col("risk_tier").isNull(), "NOT_FOUND").otherwise("SCORED"))


def upload_summary(result: DataFrame) -> DataFrame:
    missing = F.count_if(F.col("status") == "NOT_FOUND")
    return result.agg(F.count("*").alias("total_submitted"), (F.count("*") - missing).alias("scored"),
                      missing.alias("not_found"))


def report_rows(df: DataFrame) -> DataFrame:
    """One report record per subject, with its profile nested."""
    profile = F.struct("band", "department", "circle", "tenure_months", "compa_ratio",
                       F.col("perf_rating_current").alias("perf_rating"),
                       F.col("months_since_promotion").alias("months_since_promo"))
    extras = [c for c in ("shap_drivers", "recommendation", "routed_to") if c in df.columns]
    return df.select(
        "employee_id", "risk_tier", F.bround("p_attrition", 4).alias("p_attrition"),
        F.bround("median_survival_months", 1).alias("median_survival_months"), F.bround("ev", 0).alias("ev"),
        *extras, profile.alias("employee_profile"))
