"""Feature table of the bound subjects, with the optional workload and onboarding inputs derived from the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from retenta.operators import features, ingest
from retenta.plans.subjects import (CIRCLE_REFERENCE, CIRCLES, DEPARTMENT_REFERENCE, DEPARTMENTS, subjects)

# Optional inputs: workload and onboarding measures bound to existing measures.
OPTIONAL = {
    "overtime_hours_slope": "team_size_change_pct * -5",
    "after_hours_logins": "leave_days_30d",
    "onboarding_completion": "1 - manager_attrition_rate_6m",
    "days_to_first_project": "months_since_hike * 30",
    "manager_1on1_count_first30d": "perf_rating_current - 1",
}
FILLED = ("login_freq_30d", "login_freq_slope_30d", "training_completions_90d", "leave_days_30d")


def subject_base(spark: SparkSession, sf_dir: str, optional: bool = False) -> DataFrame:
    """Subjects with peer counts and, on request, the optional inputs."""
    df = features.peer_attrition(subjects(spark, sf_dir))
    return df.withColumns({n: F.expr(e) for n, e in OPTIONAL.items()}) if optional else df


def subject_features(spark: SparkSession, sf_dir: str, optional: bool = False) -> DataFrame:
    table, _ = features.feature_table(subject_base(spark, sf_dir, optional), DEPARTMENTS, DEPARTMENT_REFERENCE,
                                      CIRCLES, CIRCLE_REFERENCE, ("order_col", "employee_id"))
    return table


def contract_of(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in ("order_col", "employee_id", "attrition_flag", "attrition_prob",
                                                  "risk_profile")]


def imputed_features(spark: SparkSession, sf_dir: str, given: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Feature table without nulls: constants, then medians, before the features are derived.

    ``given`` names measures that are also kept as they were before, as ``given_<c>``; they are not part of the contract.
    """
    from retenta.session import stage
    base = subject_base(spark, sf_dir).withColumns({f"given_{c}": F.col(c) for c in given})
    base = ingest.impute_median(stage(ingest.impute_constant(base)))
    return features.feature_table(base, DEPARTMENTS, DEPARTMENT_REFERENCE, CIRCLES, CIRCLE_REFERENCE,
                                  ("order_col", "employee_id", *[f"given_{c}" for c in given]))


PEERS_SQL = """
based AS (SELECT *, team_size_change_pct * -5 AS overtime_hours_slope, leave_days_30d AS after_hours_logins,
  1 - manager_attrition_rate_6m AS onboarding_completion, months_since_hike * 30 AS days_to_first_project,
  perf_rating_current - 1 AS manager_1on1_count_first30d,
  CASE WHEN department IS NULL OR circle IS NULL THEN 0.0 ELSE
    CAST(sum(attrition_flag) OVER (PARTITION BY department, circle) - attrition_flag AS DOUBLE) END AS peer_attrition_count_90d
  FROM subjects)
"""
_NEW = "tenure_months <= 12"


def _flag(cond: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS INTEGER)"


FEATURE_SQL = {
    "recency_manager_change": "months_since_manager_changed * 30",
    "trend_login": "login_freq_slope_30d",
    "trend_performance": "performance_rating_delta",
    "trend_training": "CAST(CASE WHEN training_completions_90d = 0 THEN -1 ELSE 1 END AS INTEGER)",
    "volatility_leave": "leave_days_30d / (tenure_months + 1)",
    "volatility_performance": "abs(performance_rating_delta)",
    "org_peer_attrition": "peer_attrition_count_90d",
    "org_manager_attrition": "manager_attrition_rate_6m",
    "org_team_shrink": _flag("team_size_change_pct < -0.10"),
    "comp_compa_ratio": "compa_ratio",
    "comp_hike_vs_median": "hike_vs_band_median",
    "comp_months_no_hike": "months_since_hike",
    "career_tenure_at_band": "months_since_promotion",
    "career_promotion_velocity": "tenure_months / CASE WHEN band <> 2 THEN band - 2 END",
    "overload_overtime_slope": "overtime_hours_slope",
    "overload_afterhours_login": "after_hours_logins",
    "is_new_joiner": _flag(_NEW),
    "onboard_completion_rate": f"CASE WHEN {_NEW} THEN onboarding_completion ELSE 1.0 END",
    "onboard_days_to_project": f"CASE WHEN {_NEW} THEN days_to_first_project ELSE 0.0 END",
    "onboard_manager_1on1s": f"CASE WHEN {_NEW} THEN manager_1on1_count_first30d ELSE 0.0 END",
    "interact_high_performer_no_promo": _flag("perf_rating_current >= 4 AND months_since_promotion > 18"),
    "interact_underpaid_declining": _flag("compa_ratio < 0.85 AND login_freq_slope_30d < 0"),
    "interact_new_mgr_peer_left": _flag("months_since_manager_changed < 3 AND peer_attrition_count_90d > 1"),
    "interact_post_appraisal_dissatisfied": _flag("hike_vs_band_median < -1.5 AND months_since_hike < 3"),
    "interact_overload_underpaid": _flag("overtime_hours_slope > 0.3 AND compa_ratio < 0.90"),
    "interact_onboard_abandoned": _flag(f"{_NEW} AND onboarding_completion < 0.70 AND manager_1on1_count_first30d < 2"),
    "interact_onboard_idle": _flag(f"{_NEW} AND days_to_first_project > 21"),
    "gender_encoded": _flag("gender = 'M'"),
    **{f"dept_{v}": _flag(f"department = '{v}'") for v in DEPARTMENTS if v != DEPARTMENT_REFERENCE},
    **{f"circle_{v}": _flag(f"circle = '{v}'") for v in CIRCLES if v != CIRCLE_REFERENCE},
}
