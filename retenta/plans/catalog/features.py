"""Feature and rule-score queries, and the checks of a feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from retenta import schema
from retenta.operators import features, profile, validation
from retenta.operators.ordering import ordered_split
from retenta.plans.catalog import on_subjects, query, rounded, steady, steady_sql
from retenta.plans.features import FEATURE_SQL, PEERS_SQL, contract_of, subject_base, subject_features
from retenta.plans.scored import SCORED_SQL, rule_scored
from retenta.plans.subjects import CIRCLES, DEPARTMENTS, subjects
from retenta.session import stage

_INPUTS = {
    "F1_trends": (["trend_login", "trend_performance"], ["login_freq_slope_30d", "performance_rating_delta"]),
    "F2_trend_training": (["trend_training"], ["training_completions_90d"]),
    "F3_volatility_leave": (["volatility_leave"], ["leave_days_30d", "tenure_months"]),
    "F4_volatility_performance": (["volatility_performance"], ["performance_rating_delta"]),
    "F5_org_attrition": (["org_peer_attrition", "org_manager_attrition"], None),
    "F6_team_shrink": (["org_team_shrink"], ["team_size_change_pct"]),
    "F7_compensation": (["comp_compa_ratio", "comp_hike_vs_median", "comp_months_no_hike"],
                        ["compa_ratio", "hike_vs_band_median", "months_since_hike"]),
    "F8_tenure_at_band": (["career_tenure_at_band"], ["months_since_promotion"]),
    "F9_promotion_velocity": (["career_promotion_velocity"], ["tenure_months", "band"]),
    "F10_manager_recency": (["recency_manager_change"], ["months_since_manager_changed"]),
    "F11_overload": (["overload_overtime_slope", "overload_afterhours_login"], None),
    "F12_onboarding": (["is_new_joiner", "onboard_completion_rate", "onboard_days_to_project",
                        "onboard_manager_1on1s"], None),
    "F13_high_performer_no_promo": (["interact_high_performer_no_promo"],
                                    ["perf_rating_current", "months_since_promotion"]),
    "F14_underpaid_declining": (["interact_underpaid_declining"], ["compa_ratio", "login_freq_slope_30d"]),
    "F15_new_manager_peer_left": (["interact_new_mgr_peer_left"], None),
    "F16_post_appraisal": (["interact_post_appraisal_dissatisfied"], ["hike_vs_band_median", "months_since_hike"]),
    "F17_overload_underpaid": (["interact_overload_underpaid"], None),
    "F18_onboarding_flags": (["interact_onboard_abandoned", "interact_onboard_idle"], None),
    "F20_gender_encoded": (["gender_encoded"], ["gender"]),
}


def _feature_query(names, inputs):
    def run(spark, d):
        base = subject_base(spark, d, True) if inputs is None else subjects(spark, d, ["order_col", *inputs])
        exprs = features.feature_columns(base.columns)
        return steady(base.select("order_col", *[exprs[n].alias(n) for n in names]))
    return run


def _feature_sql(names):
    cols = ", ".join(f"{FEATURE_SQL[n]} AS \"{n}\"" if FEATURE_SQL[n].startswith("CAST(CASE")
                     else f"{steady_sql(FEATURE_SQL[n])} AS \"{n}\"" for n in names)
    return on_subjects(f"SELECT order_col, {cols} FROM based", PEERS_SQL)


for _name, (_cols, _needs) in _INPUTS.items():
    query(_name, _feature_sql(_cols))(_feature_query(_cols, _needs))

_DUMMIES = [n for n in FEATURE_SQL if n.startswith(("dept_", "circle_"))]


@query("F19_one_hot", _feature_sql(_DUMMIES))
def _(spark, d):
    df = subjects(spark, d, ["order_col", "department", "circle"])
    hot = {**features.dummies("department", "dept", DEPARTMENTS, "BUILDING"),
           **features.dummies("circle", "circle", CIRCLES, "AFRICA")}
    return df.select("order_col", *[c.alias(n) for n, c in hot.items()])


_FINAL = [n for n in schema.BASE_FEATURES if n in FEATURE_SQL] + _DUMMIES
_RAW = [n for n in schema.BASE_FEATURES if n not in FEATURE_SQL]


@query("F21_feature_table", on_subjects("SELECT order_col, employee_id, attrition_flag, band, " + ", ".join(
    f"{steady_sql(c)} AS {c}" for c in _RAW if c != "band") + ", " + ", ".join(
    f"{FEATURE_SQL[n]} AS \"{n}\"" if FEATURE_SQL[n].startswith("CAST(CASE") else f"{steady_sql(FEATURE_SQL[n])} AS \"{n}\""
    for n in _FINAL) + " FROM based", PEERS_SQL))
def _(spark, d):
    return steady(subject_features(spark, d, True))


_PEER = on_subjects("SELECT order_col, peer_attrition_count_90d FROM based", PEERS_SQL)


@query("F22_peer_attrition", _PEER)
@query("J3_peer_self_join", _PEER)
def _(spark, d):
    base = subjects(spark, d, ["order_col", "department", "circle", "attrition_flag"])
    return features.peer_attrition(base).select("order_col", "peer_attrition_count_90d")


@query("G1_rule_score", on_subjects("SELECT order_col, round(rule_score, 6) AS rule_score FROM scored", SCORED_SQL))
def _(spark, d):
    base = subjects(spark, d, ["order_col", "manager_attrition_rate_6m", "login_freq_slope_30d", "perf_rating_current",
                               "months_since_promotion", "compa_ratio", "hike_vs_band_median", "months_since_hike",
                               "tenure_months"])
    return rounded(base.select("order_col", features.rule_score().alias("rule_score")))


@query("G2_top_fraction_label", on_subjects("""
, n AS (SELECT CAST(round_even(count(*) * CAST(0.18 AS DOUBLE), 0) AS BIGINT) AS k FROM scored),
cut AS (SELECT min(rule_score) AS t FROM (SELECT rule_score FROM scored ORDER BY rule_score DESC LIMIT (SELECT k FROM n)))
SELECT order_col, CAST(CASE WHEN rule_score >= (SELECT t FROM cut) THEN 1 ELSE 0 END AS INTEGER) AS label FROM scored""".lstrip(),
                                            SCORED_SQL).replace("\n, n AS", ",\nn AS"))
def _(spark, d):
    base = stage(rule_scored(spark, d).select("order_col", "rule_score"))
    return features.top_fraction_label(base, "rule_score", 0.18).select("order_col", "label")


@query("G3_min_max", on_subjects("SELECT order_col, p_attrition FROM scored", SCORED_SQL))
def _(spark, d):
    return rule_scored(spark, d).select("order_col", "p_attrition")


@query("G4_profile_bins", on_subjects("""
SELECT CASE WHEN p_attrition <= 0.33 THEN 'Stable' WHEN p_attrition <= 0.66 THEN 'At Risk' ELSE 'Critical' END
  AS risk_profile, count(*) AS n FROM scored GROUP BY 1""", SCORED_SQL))
def _(spark, d):
    from retenta.functions.numeric import cut
    label = cut(F.col("p_attrition"), schema.PROFILE_EDGES, schema.PROFILE_LABELS)
    return rule_scored(spark, d).groupBy(label.alias("risk_profile")).agg(F.count("*").alias("n"))


_FLAGS = [n for n in FEATURE_SQL if n.startswith("interact_")]


@query("A26_flag_sums", on_subjects("\nUNION ALL\n".join(
    f"SELECT '{n}' AS \"column\", CAST(sum({FEATURE_SQL[n]}) AS BIGINT) AS n_fired FROM based" for n in _FLAGS), PEERS_SQL))
def _(spark, d):
    return profile.flag_sums(subject_features(spark, d, True), _FLAGS)


# --------------------------------------------------------------- checks of the feature table
def _checks(spark, d):
    df = stage(subject_features(spark, d, True))
    return validation.Checks(df, contract_of(df)), df


def _brief(df):
    return df.select("check", "column", "metric", F.round("value", 6).alias("value"), "passed")


def _check_sql(rows):
    return on_subjects("\nUNION ALL\n".join(
        f"SELECT '{check}' AS \"check\", '{column}' AS \"column\", '{metric}' AS metric, round(CAST({value} AS DOUBLE), 6) AS value, "
        f"coalesce({passed}, false) AS passed FROM feats" for check, column, metric, value, passed in rows), PEERS_SQL, FEATS_SQL)


FEATS_SQL = "feats AS (SELECT order_col, employee_id, attrition_flag, " + ", ".join(_RAW) + ", " + ", ".join(
    f"{FEATURE_SQL[n]} AS \"{n}\"" for n in _FINAL) + " FROM based)"
_CONTRACT = [n for n in schema.BASE_FEATURES] + _DUMMIES
_V = {
    "V1_inputs": ("inputs", [("inputs_exist", "", "n_columns", 3 + len(_CONTRACT), "count(*) >= 0"),
                             ("contract_exists", "", "n_features", len(_CONTRACT), "count(*) >= 0")]),
    "V2_row_count": ("row_count", [("row_count", "", "n_rows", "count(*)", "count(*) >= 500")]),
    "V3_features_present": ("features_present", [("features_present", "", "n_missing", 0, "count(*) >= 0")]),
    "V4_no_nulls": ("no_nulls", [("no_nulls", c, "n_null", f'count(*) - count("{c}")', f'count(*) = count("{c}")')
                                 for c in _CONTRACT]),
    "V5_label_valid": ("label_valid", [(
        "label_valid", "attrition_flag", "n_invalid",
        "count(CASE WHEN attrition_flag IS NULL OR attrition_flag NOT IN (0, 1) THEN 1 END)",
        "count(CASE WHEN attrition_flag IS NULL OR attrition_flag NOT IN (0, 1) THEN 1 END) = 0")]),
    "V6_key_unique": ("key_unique", [("key_unique", "employee_id", "n_duplicates",
                                      "count(*) - count(DISTINCT employee_id)",
                                      "count(*) = count(DISTINCT employee_id)")]),
    "V7_class_balance": ("class_balance", [("class_balance", "attrition_flag", "rate", "avg(attrition_flag)",
                                            "avg(attrition_flag) BETWEEN 0.05 AND 0.60")]),
    "V8_ranges": ("ranges", [("ranges", c, "n_outside", f"count(CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1 END)",
                              f"count(CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1 END) <= count(*) * 0.05")
                             for c, (lo, hi) in schema.FEATURE_RANGES.items()]),
    "V9_variance": ("variance", [("variance", c, "std", f'stddev_samp("{c}")', f'coalesce(stddev_samp("{c}") <> 0, true)')
                                 for c in _CONTRACT if not c.startswith(validation.SKIP_VARIANCE)]),
    "V11_interactions": ("interactions", [("interactions", c, "fire_rate", f"avg({c})", f"avg({c}) >= 0.002")
                                          for c in _CONTRACT if c.startswith("interact_")]),
    "V12_dummies": ("dummies", [("dummies", p, "always_one", f"CAST(bool_and({s} = 1) AS INTEGER)", f"NOT bool_and({s} = 1)")
                                for p in ("dept_", "circle_")
                                for s in [" + ".join(f'"{n}"' for n in _DUMMIES if n.startswith(p))]]),
}


def _check_query(method):
    def run(spark, d):
        checks, _ = _checks(spark, d)
        return _brief(checks.run(getattr(checks, method)()))
    return run


for _name, (_method, _rows) in _V.items():
    query(_name, _check_sql(_rows))(_check_query(_method))

_SPLIT_SQL = """
placed AS (SELECT *, row_number() OVER (ORDER BY order_col) <= CAST(floor((SELECT count(*) FROM subjects) * 0.8) AS BIGINT) AS is_train
  FROM subjects)"""


@query("V10_split_check", on_subjects("""
SELECT 'split' AS "check", 'attrition_flag' AS "column", 'drift' AS metric, round(abs(tr - te), 6) AS value,
  NOT (tr < 0.05 OR te < 0.05) AND abs(tr - te) <= 0.15 AS passed FROM (
  SELECT avg(CASE WHEN is_train THEN attrition_flag END) AS tr, avg(CASE WHEN NOT is_train THEN attrition_flag END) AS te FROM placed)""",
                                      _SPLIT_SQL))
def _(spark, d):
    return _brief(validation.split_check(stage(subjects(spark, d, ["order_col", "attrition_flag"])), "order_col"))


@query("M1_ordered_split", on_subjects("SELECT order_col, is_train FROM placed", _SPLIT_SQL))
def _(spark, d):
    return ordered_split(subjects(spark, d, ["order_col"]), "order_col")


@query("M1_ordered_split_lines", """
SELECT is_train, count(*) AS n, min(l_partkey) AS lo, max(l_partkey) AS hi FROM (
  SELECT l_partkey, dense_rank() OVER (ORDER BY l_partkey) <= CAST(floor((SELECT count(DISTINCT l_partkey) FROM lineitem) * 0.8) AS BIGINT)
  AS is_train FROM lineitem) GROUP BY 1""")
def _(spark, d):
    from retenta.plans.subjects import table
    lines = table(spark, d, "lineitem").select("l_partkey")
    parts = ordered_split(stage(lines.distinct(), "parts"), "l_partkey")
    edge = parts.filter("is_train").agg(F.max("l_partkey")).scalar()
    return (lines.groupBy((F.col("l_partkey") <= edge).alias("is_train"))
            .agg(F.count("*").alias("n"), F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi")))


@query("V13_validation_summary", on_subjects("""
SELECT count(*) AS n_checks, count(CASE WHEN passed THEN 1 END) AS n_passed, count(CASE WHEN NOT passed THEN 1 END) AS n_failed,
  bool_and(passed) AS can_proceed FROM (SELECT "check", bool_and(passed) AS passed FROM (""" + "\nUNION ALL\n".join(
    f"SELECT '{check}' AS \"check\", coalesce({passed}, false) AS passed FROM feats"
    for _, rows in _V.values() for check, _c, _m, _x, passed in rows) + """
  UNION ALL SELECT 'split', NOT (tr < 0.05 OR te < 0.05) AND abs(tr - te) <= 0.15 FROM (
  SELECT avg(CASE WHEN is_train THEN attrition_flag END) AS tr, avg(CASE WHEN NOT is_train THEN attrition_flag END) AS te FROM placed)
  ) GROUP BY 1)""", PEERS_SQL, FEATS_SQL, _SPLIT_SQL))
def _(spark, d):
    checks, df = _checks(spark, d)
    return validation.summary(validation.validate_features(df, checks.contract, "order_col"))
