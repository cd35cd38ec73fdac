"""Canonical subject schema, rule tables and lookup values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    name: str
    dtype: str
    required: bool
    nullable: bool


# ---------------------------------------------------------------- fixed values
# Canonical column rules: (name, type, required, nullable).
CANONICAL = tuple(
    Rule(*r)
    for r in (
        ("employee_id", "str", True, False),
        ("band", "int", True, False),
        ("circle", "str", True, True),
        ("department", "str", True, True),
        ("gender", "str", False, True),
        ("tenure_months", "float", True, False),
        ("months_since_promotion", "float", True, True),
        ("months_since_hike", "float", True, True),
        ("months_since_manager_changed", "float", False, True),
        ("compa_ratio", "float", True, True),
        ("hike_vs_band_median", "float", False, True),
        ("perf_rating_current", "float", True, True),
        ("login_freq_30d", "float", True, True),
        ("login_freq_slope_30d", "float", False, True),
        ("training_completions_90d", "float", False, True),
        ("leave_days_30d", "float", False, True),
        ("performance_rating_delta", "float", False, True),
        ("peer_attrition_count_90d", "float", False, True),
        ("manager_attrition_rate_6m", "float", False, True),
        ("team_size_change_pct", "float", False, True),
        ("attrition_flag", "int", True, False),
    )
)

# Header aliases of each canonical column.
ALIASES = {
    "employee_id": ["emp_id", "employee id", "empid", "eid", "staff_id", "staffid", "id", "emp_code",
                    "employee_code", "hrid", "hr_id"],
    "band": ["grade", "level", "job_level", "pay_band", "band_level", "joblevel", "salary_band",
             "career_level", "gradelevel"],
    "circle": ["region", "location", "geo", "geography", "state", "zone", "business_unit", "bu", "circle_name"],
    "department": ["dept", "function", "team", "division", "business_function", "dept_name", "deptname"],
    "gender": ["sex", "gender_code", "m_f"],
    "tenure_months": ["tenure", "months_at_company", "length_of_service", "service_months", "los",
                      "experience_months", "total_tenure"],
    "months_since_promotion": ["last_promotion_months", "promotion_gap", "months_since_last_promo", "promo_gap",
                               "time_since_promotion"],
    "months_since_hike": ["last_hike_months", "hike_gap", "months_since_last_hike", "salary_revision_gap"],
    "months_since_manager_changed": ["manager_change_months", "mgr_change_gap", "reporting_change_months"],
    "compa_ratio": ["comp_ratio", "compensation_ratio", "salary_ratio", "market_ratio", "pay_ratio"],
    "hike_vs_band_median": ["hike_delta", "hike_vs_median", "increment_vs_median", "hike_comparison"],
    "perf_rating_current": ["performance_rating", "perf_rating", "rating", "appraisal_rating", "perf_score",
                            "annual_rating", "last_rating"],
    "login_freq_30d": ["login_count", "logins_30d", "monthly_logins", "system_logins", "active_days"],
    "login_freq_slope_30d": ["login_trend", "login_slope", "activity_trend"],
    "training_completions_90d": ["trainings_completed", "training_count", "lms_completions", "courses_completed"],
    "leave_days_30d": ["leave_days", "leaves_taken", "absent_days", "monthly_leaves"],
    "performance_rating_delta": ["rating_change", "rating_delta", "perf_change", "rating_trend"],
    "peer_attrition_count_90d": ["peer_exits", "team_attrition_count", "colleagues_left"],
    "manager_attrition_rate_6m": ["mgr_attrition", "manager_exit_rate", "reporting_attrition"],
    "team_size_change_pct": ["team_change", "headcount_change", "team_growth_pct"],
    "attrition_flag": ["attrition", "left_flag", "resigned", "exit_flag", "churned", "left_company",
                       "is_attrition", "turnover_flag"],
}

# Spellings of a missing value, compared after trim and lower-casing.
NULL_TOKENS = ("na", "n/a", "nan", "null", "none", "-", "?", ".", "#n/a", "#na", "missing", "unknown", "",
               "not available", "not applicable", "nil")

# Text spellings of the binary label and of gender.
LABEL_VALUES = {"yes": 1, "no": 0, "y": 1, "n": 0, "true": 1, "false": 0, "1": 1, "0": 0,
                "resigned": 1, "active": 0, "left": 1, "stayed": 0}
GENDER_VALUES = {"male": "M", "female": "F", "m": "M", "f": "F", "1": "M", "0": "F", "man": "M", "woman": "F"}

# Date columns and the elapsed-month column each one feeds.
DATE_TARGETS = {
    "hire_date": "tenure_months",
    "joining_date": "tenure_months",
    "date_of_joining": "tenure_months",
    "last_promotion_date": "months_since_promotion",
    "promotion_date": "months_since_promotion",
    "last_hike_date": "months_since_hike",
    "salary_revision_date": "months_since_hike",
    "manager_change_date": "months_since_manager_changed",
}
DAYS_PER_MONTH = 30.44

# Imputation: constants, medians and modes.
FILL_CONSTANT = {"hike_vs_band_median": 0.0, "login_freq_slope_30d": 0.0, "training_completions_90d": 0.0,
                 "performance_rating_delta": 0.0, "peer_attrition_count_90d": 0.0, "team_size_change_pct": 0.0}
FILL_MEDIAN = ("tenure_months", "months_since_promotion", "months_since_hike", "months_since_manager_changed",
               "compa_ratio", "perf_rating_current", "login_freq_30d", "leave_days_30d",
               "manager_attrition_rate_6m")
FILL_MODE = ("circle", "department", "gender", "band")

# Columns winsorised at their 1st and 99th percentile.
CAP_COLUMNS = ("tenure_months", "compa_ratio", "login_freq_30d", "leave_days_30d", "perf_rating_current",
               "months_since_promotion", "months_since_hike", "peer_attrition_count_90d",
               "manager_attrition_rate_6m")

# Profiling: required and numeric columns, expected ranges, allowed bands.
REQUIRED = ("employee_id", "band", "department", "circle", "tenure_months", "attrition_flag", "compa_ratio",
            "perf_rating_current", "months_since_promotion", "months_since_hike", "login_freq_30d")
NUMERIC = ("tenure_months", "compa_ratio", "perf_rating_current", "months_since_promotion", "months_since_hike",
           "login_freq_30d", "leave_days_30d", "training_completions_90d", "manager_attrition_rate_6m",
           "peer_attrition_count_90d", "team_size_change_pct", "login_freq_slope_30d",
           "performance_rating_delta")
EXPECTED_RANGES = {"compa_ratio": (0.3, 2.0), "perf_rating_current": (1.0, 5.0), "tenure_months": (0.0, 360.0),
                   "months_since_promotion": (0.0, 120.0), "months_since_hike": (0.0, 60.0),
                   "login_freq_30d": (0.0, 31.0), "leave_days_30d": (0.0, 31.0), "band": (1.0, 10.0)}
BANDS = (3, 4, 5, 6, 7)

# Feature-table validation ranges.
FEATURE_RANGES = {"comp_compa_ratio": (0.2, 3.0), "perf_rating_current": (1.0, 5.0),
                  "tenure_months": (0.0, 600.0), "career_tenure_at_band": (0.0, 600.0), "band": (1.0, 10.0)}

# Right-closed bucket edges and labels.
HIKE_EDGES, HIKE_LABELS = (0, 2, 6, 12, 24, 999), ("0-2m", "2-6m", "6-12m", "12-24m", "24m+")
TENURE_EDGES, TENURE_LABELS = (0, 12, 36, 72, 120, 999), ("0-1yr", "1-3yr", "3-6yr", "6-10yr", "10yr+")
PROFILE_EDGES, PROFILE_LABELS = (-0.01, 0.33, 0.66, 1.0), ("Stable", "At Risk", "Critical")

# Base features of the model contract, in order.
BASE_FEATURES = (
    "recency_manager_change", "trend_login", "trend_performance", "trend_training", "volatility_leave",
    "volatility_performance", "org_peer_attrition", "org_manager_attrition", "org_team_shrink",
    "comp_compa_ratio", "comp_hike_vs_median", "comp_months_no_hike", "career_tenure_at_band",
    "career_promotion_velocity", "overload_overtime_slope", "overload_afterhours_login", "is_new_joiner",
    "onboard_completion_rate", "onboard_manager_1on1s", "interact_high_performer_no_promo",
    "interact_underpaid_declining", "interact_new_mgr_peer_left", "interact_post_appraisal_dissatisfied",
    "interact_overload_underpaid", "interact_onboard_abandoned", "interact_onboard_idle", "band",
    "tenure_months", "perf_rating_current", "login_freq_30d", "training_completions_90d", "leave_days_30d",
    "gender_encoded",
)
EXTRA_COLUMNS = ("attrition_flag", "attrition_prob", "risk_profile")

# Reader-facing label of a driver.
DRIVER_LABELS = {
    "interact_high_performer_no_promo": "High performer with no promotion in 18+ months",
    "interact_underpaid_declining": "Underpaid vs market AND activity declining",
    "interact_new_mgr_peer_left": "New manager + peers recently left (contagion risk)",
    "interact_post_appraisal_dissatisfied": "Received below-median hike in recent appraisal",
    "comp_compa_ratio": "Salary below market benchmark",
    "comp_underpaid_flag": "Significantly underpaid vs peers",
    "org_peer_attrition": "Multiple peers left team recently",
    "org_manager_attrition": "High manager turnover in team",
    "org_team_shrink": "Team headcount reduced >10%",
    "trend_login": "Login activity declining sharply",
    "trend_performance": "Performance rating declining",
    "career_tenure_at_band": "Stuck at same band for extended period",
    "recency_promotion": "Long gap since last promotion",
    "recency_hike": "Long gap since last salary hike",
    "recency_manager_change": "Recent manager change — destabilisation risk",
    "volatility_leave": "Unusual leave pattern vs tenure",
    "volatility_performance": "Erratic performance ratings",
}

# Search text of a driver.
DRIVER_QUERIES = {
    "interact_high_performer_no_promo": "high performer no promotion 18 months escalation",
    "interact_underpaid_declining": "salary below market compa ratio MAP correction underpaid",
    "interact_new_mgr_peer_left": "peer attrition contagion team members leaving new manager",
    "interact_post_appraisal_dissatisfied": "post appraisal resignation retention hike below median",
    "comp_compa_ratio": "salary market alignment MAP correction compa ratio",
    "comp_underpaid_flag": "underpaid salary correction market alignment",
    "org_peer_attrition": "peer attrition team contagion stabilisation",
    "org_team_shrink": "team size reduction health check morale",
    "trend_login": "login activity declining engagement review",
    "volatility_leave": "excessive leave unplanned attendance",
    "career_tenure_at_band": "promotion criteria band tenure career progression",
    "recency_promotion": "promotion overdue career stagnation",
}
NO_CONTEXT = "No specific policy found for these risk drivers."

# Survival covariates.
COX_COVARIATES = ("tenure_months", "comp_compa_ratio", "career_tenure_at_band",
                  "interact_high_performer_no_promo", "interact_underpaid_declining", "org_peer_attrition",
                  "org_manager_attrition", "trend_login", "trend_performance", "band")

# Tiers, routes and budget scopes.
TIERS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
ROUTES = {"CRITICAL": "SLACK_ALERT", "HIGH": "WEEKLY_DIGEST", "MEDIUM": "MANAGER_AWARENESS"}
DEFAULT_ROUTE, ERROR_ROUTE = "AUDIT_LOG_ONLY", "ERROR_LOG"
SCOPES = {"CRITICAL": ("CRITICAL",), "HIGH": ("CRITICAL", "HIGH"), "ALL": ("CRITICAL", "HIGH", "MEDIUM")}

# Profile columns carried into the scored table.
PROFILE_COLUMNS = ("band", "circle", "department", "gender", "tenure_months", "compa_ratio",
                   "perf_rating_current", "months_since_promotion", "months_since_hike")
# ------------------------------------------------------------ end fixed values

CANONICAL_NAMES = tuple(r.name for r in CANONICAL)
ALIAS_TO_CANONICAL = {a: c for c, names in ALIASES.items() for a in names}

DRIVER_TYPE = T.ArrayType(
    T.StructType([T.StructField("feature", T.StringType()), T.StructField("shap", T.DoubleType())])
)
RECOMMENDATION_TYPE = T.StructType([
    T.StructField("narrative", T.StringType()),
    T.StructField("immediate_actions", T.ArrayType(T.StringType())),
    T.StructField("timeline", T.StringType()),
    T.StructField("policy_references", T.ArrayType(T.StringType())),
    T.StructField("intervention_window", T.StringType()),
])
_SPARK_TYPES = {"str": T.StringType(), "int": T.IntegerType(), "float": T.DoubleType()}
SUBJECT_SCHEMA = T.StructType(
    [T.StructField(r.name, _SPARK_TYPES[r.dtype], r.nullable) for r in CANONICAL]
    + [T.StructField("order_col", T.LongType(), False)]
)
