"""Scoring and report queries over the rule-scored subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from retenta import schema
from retenta.operators import scoring
from retenta.plans.catalog import on_subjects, query, rounded
from retenta.plans.scored import SCORED_SQL, rule_scored
from retenta.plans.subjects import subjects, table


def _sql(body, *more):
    return on_subjects(body, SCORED_SQL, *more)


@query("tier_budget_by_department", _sql("""
SELECT department, risk_tier, count(*) AS n, CAST(sum(ev) AS DOUBLE) AS total_ev, round(sum(p_attrition), 6) AS expected_leavers,
  CAST(count(*) * 50000.0 AS DOUBLE) AS intervention_cost FROM scored GROUP BY 1, 2"""))
def _(spark, d):
    s = rule_scored(spark, d)
    return rounded(s.groupBy("department", "risk_tier").agg(
        F.count("*").alias("n"), F.sum("ev").alias("total_ev"), F.sum("p_attrition").alias("expected_leavers"),
        (F.count("*") * 50000.0).alias("intervention_cost")))


@query("E1_expected_value", _sql("SELECT order_col, ev FROM scored"))
def _(spark, d):
    return rule_scored(spark, d).select("order_col", "ev")


@query("E2_risk_tier", _sql("SELECT order_col, risk_tier FROM scored"))
def _(spark, d):
    return rule_scored(spark, d).select("order_col", "risk_tier")


_E3 = _sql("""SELECT employee_id, p_attrition, CASE WHEN isinf(median_survival_months) THEN -1 ELSE median_survival_months END
  AS median_survival_months, ev, risk_tier, band, circle, department, gender, round(tenure_months, 6) AS tenure_months,
  round(compa_ratio, 6) AS compa_ratio, perf_rating_current, round(months_since_promotion, 6) AS months_since_promotion,
  round(months_since_hike, 6) AS months_since_hike FROM scored""")


@query("E3_scored_table", _E3)
@query("J1_scores_with_profile", _E3)
@query("K1_by_priority", _E3)
def _(spark, d):
    scores = rule_scored(spark, d).select("employee_id", "p_attrition", "median_survival_months", "ev", "risk_tier")
    profile = subjects(spark, d, ["employee_id", *schema.PROFILE_COLUMNS])
    out = scoring.by_priority(scoring.scored_table(scores, profile))
    months = F.col("median_survival_months")
    return rounded(out.withColumn("median_survival_months", F.when(months == float("inf"), -1.0).otherwise(months)))


@query("A19_tier_distribution", _sql("""
SELECT CAST(position AS INTEGER) AS position, t AS risk_tier, count(risk_tier) AS n,
  round(count(risk_tier) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM scored), 6) AS pct
FROM (VALUES (0, 'CRITICAL'), (1, 'HIGH'), (2, 'MEDIUM'), (3, 'LOW')) v(position, t) LEFT JOIN scored ON t = risk_tier GROUP BY 1, 2"""))
def _(spark, d):
    return rounded(scoring.tier_distribution(rule_scored(spark, d)))


@query("A20_value_totals", _sql("""
SELECT coalesce(sum(CASE WHEN risk_tier IN ('CRITICAL', 'HIGH') THEN ev END), 0) AS urgent_ev,
  round(avg(CASE WHEN risk_tier = 'CRITICAL' THEN p_attrition END), 6) AS critical_avg_p,
  round(avg(CASE WHEN risk_tier = 'CRITICAL' AND NOT isinf(median_survival_months) THEN median_survival_months END), 6) AS critical_avg_survival,
  count(CASE WHEN risk_tier = 'CRITICAL' AND (median_survival_months IS NULL OR isinf(median_survival_months)) THEN 1 END) AS critical_infinite
FROM scored"""))
def _(spark, d):
    return rounded(scoring.value_totals(rule_scored(spark, d)))


@query("A21_weekly_counts", _sql("""
SELECT count(*) AS total_employees, count(CASE WHEN risk_tier = 'CRITICAL' THEN 1 END) AS critical_count,
  count(CASE WHEN risk_tier = 'HIGH' THEN 1 END) AS high_count, count(CASE WHEN risk_tier = 'MEDIUM' THEN 1 END) AS medium_count,
  count(CASE WHEN risk_tier = 'LOW' THEN 1 END) AS low_count FROM scored"""))
def _(spark, d):
    return scoring.weekly_counts(rule_scored(spark, d))


@query("A22_budget_summary", _sql("""
SELECT round_even(ev, 0) AS total_ev_urgent, round_even(p, 1) AS expected_replacements,
  round_even(p * 450000, 0) AS replacement_cost_avoided, round_even(p * 450000 / greatest(ev, 1), 2) AS net_roi,
  CAST(n * 50000.0 AS DOUBLE) AS intervention_cost_total FROM (
  SELECT coalesce(sum(ev), 0) AS ev, coalesce(sum(p_attrition), 0) AS p, count(*) AS n FROM scored
  WHERE risk_tier IN ('CRITICAL', 'HIGH'))"""))
def _(spark, d):
    return scoring.budget_summary(rule_scored(spark, d))


_SIM = """
sim AS (SELECT scope, n AS employees_affected, round_even(n * 50000.0, 0) AS total_intervention_cost,
  round_even(r, 1) AS expected_retentions, round_even(r * 450000, 0) AS replacement_cost_avoided,
  round_even(r * 450000 / greatest(n * 50000.0, 1), 2) AS net_roi,
  round_even(n * 50000.0 / greatest(r * 450000 / 12, 1), 1) AS payback_months
FROM (SELECT scope, count(p_attrition) AS n, coalesce(sum(p_attrition * 0.75), 0) AS r FROM
  (VALUES ('CRITICAL', 'CRITICAL'), ('HIGH', 'CRITICAL'), ('HIGH', 'HIGH'), ('ALL', 'CRITICAL'), ('ALL', 'HIGH'), ('ALL', 'MEDIUM'))
  v(scope, tier) LEFT JOIN scored ON tier = risk_tier GROUP BY scope))"""


@query("A23_budget_scenarios", _sql("SELECT scope AS simulation_tier, * EXCLUDE (scope) FROM sim", _SIM))
def _(spark, d):
    return scoring.budget_scenarios(rule_scored(spark, d))


@query("A25_derived_shares", _sql("""
SELECT scope AS simulation_tier, replacement_cost_avoided - total_intervention_cost AS net_benefit,
  round(expected_retentions / greatest(employees_affected, 1), 6) AS retention_share FROM sim""", _SIM))
def _(spark, d):
    return rounded(scoring.derived_shares(scoring.budget_scenarios(rule_scored(spark, d))))


@query("A25_critical_share", _sql("""
SELECT round(count(CASE WHEN risk_tier = 'CRITICAL' THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS critical_share FROM scored"""))
def _(spark, d):
    return rounded(scoring.critical_share(rule_scored(spark, d)))


_GRID = """SELECT department, band, round(avg(p_attrition), 6) AS avg_p_attrition,
  count(CASE WHEN risk_tier IN ('CRITICAL', 'HIGH') THEN 1 END) AS high_risk_count, count(employee_id) AS total_employees,
  sum(ev) AS total_ev FROM scored {} GROUP BY 1, 2"""


@query("A24_department_report", _sql(_GRID.format("")))
def _(spark, d):
    return rounded(scoring.department_report(rule_scored(spark, d)).grid)


@query("A24_department_overview", _sql("""SELECT department, count(*) AS total_employees,
  round_even(avg(p_attrition), 3) AS avg_p_attrition, count(CASE WHEN risk_tier = 'CRITICAL' THEN 1 END) AS critical_count
  FROM scored GROUP BY 1"""))
def _(spark, d):
    return scoring.department_report(rule_scored(spark, d)).totals


@query("A24_critical_subjects", _sql("""SELECT department, employee_id, band, p_attrition, ev FROM scored
  WHERE risk_tier = 'CRITICAL'"""))
def _(spark, d):
    return scoring.department_report(rule_scored(spark, d)).critical


@query("W1_point_lookup", _sql("SELECT employee_id, risk_tier, ev FROM scored WHERE employee_id = 'C42'"))
def _(spark, d):
    return scoring.one_subject(rule_scored(spark, d).select("employee_id", "risk_tier", "ev"), "C42")


@query("W2_tier_filter", _sql("SELECT employee_id, risk_tier FROM scored WHERE risk_tier IN ('CRITICAL', 'HIGH')"))
def _(spark, d):
    return scoring.in_tiers(rule_scored(spark, d), ["CRITICAL", "HIGH"]).select("employee_id", "risk_tier")


@query("W3_scope_filter", _sql("""
SELECT scope, count(risk_tier) AS n FROM (VALUES ('critical', 'CRITICAL'), ('High', 'CRITICAL'), ('High', 'HIGH'),
  ('all', 'CRITICAL'), ('all', 'HIGH'), ('all', 'MEDIUM'), ('typo', 'CRITICAL')) v(scope, tier)
LEFT JOIN scored ON tier = risk_tier GROUP BY 1"""))
def _(spark, d):
    s = rule_scored(spark, d)
    rows = [F.struct(F.lit(x).alias("scope"), F.count_if(F.col("risk_tier").isin(*scoring.scope_tiers(x))).alias("n"))
            for x in ("critical", "High", "all", "typo")]
    return s.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


@query("W4_case_insensitive", _sql(_GRID.format("WHERE lower(department) = 'machinery'")))
def _(spark, d):
    return rounded(scoring.department_report(rule_scored(spark, d), "Machinery").grid)


@query("W5_tier_and_route", _sql("""
SELECT employee_id, risk_tier FROM scored WHERE risk_tier IN ('CRITICAL', 'HIGH', 'MEDIUM')
  AND CASE risk_tier WHEN 'CRITICAL' THEN 'SLACK_ALERT' WHEN 'HIGH' THEN 'WEEKLY_DIGEST' ELSE 'MANAGER_AWARENESS' END
  IN ('WEEKLY_DIGEST', 'MANAGER_AWARENESS')"""))
def _(spark, d):
    from retenta.operators.explain import with_route
    return scoring.tier_and_route(with_route(rule_scored(spark, d)), ["CRITICAL", "HIGH", "MEDIUM"],
                                  ["WEEKLY_DIGEST", "MANAGER_AWARENESS"]).select("employee_id", "risk_tier")


_TOP = _sql("""SELECT risk_tier, employee_id, ev, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY risk_tier ORDER BY ev DESC, employee_id) AS rank FROM scored WHERE risk_tier IN ('CRITICAL', 'HIGH')) WHERE rank <= 10""")


@query("K3_top_per_tier", _TOP)
def _(spark, d):
    return scoring.top_per_tier(rule_scored(spark, d)).select("risk_tier", "employee_id", "ev", "rank")


@query("K3_top_overall", _sql("SELECT employee_id, ev, risk_tier FROM scored ORDER BY ev DESC, employee_id LIMIT 5"))
def _(spark, d):
    return scoring.top_overall(rule_scored(spark, d)).select("employee_id", "ev", "risk_tier")


@query("K4_head_of_filter", _sql("""SELECT employee_id, ev FROM scored WHERE risk_tier IN ('CRITICAL', 'HIGH', 'MEDIUM')
  ORDER BY ev DESC, employee_id LIMIT 20"""))
def _(spark, d):
    from retenta.operators.explain import run_batch
    s = rule_scored(spark, d).withColumn("top_shap_drivers", F.array().cast(schema.DRIVER_TYPE))
    return run_batch(s, 20, ("CRITICAL", "HIGH", "MEDIUM")).select("employee_id", "ev")


_UPLOAD = """
up AS (SELECT 'C' || o_custkey AS employee_id FROM orders UNION ALL SELECT 'S' || s_suppkey FROM supplier),
hits AS (SELECT up.employee_id, p_attrition, risk_tier, CASE WHEN risk_tier IS NULL THEN 'NOT_FOUND' ELSE 'SCORED' END AS status
  FROM up LEFT JOIN scored ON up.employee_id = scored.employee_id)"""


def _upload(spark, d):
    known = table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("employee_id"))
    unknown = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("employee_id"))
    return known.unionByName(unknown)


@query("J2_score_upload", _sql("SELECT employee_id, p_attrition, risk_tier, status FROM hits", _UPLOAD))
def _(spark, d):
    return scoring.score_upload(_upload(spark, d), rule_scored(spark, d)).select(
        "employee_id", "p_attrition", "risk_tier", "status")


@query("J2_upload_summary", _sql("""SELECT count(*) AS total_submitted, count(risk_tier) AS scored,
  count(*) - count(risk_tier) AS not_found FROM hits""", _UPLOAD))
def _(spark, d):
    return scoring.upload_summary(scoring.score_upload(_upload(spark, d), rule_scored(spark, d)))


@query("E7_report_rows", _sql("""
SELECT employee_id, risk_tier, p_attrition, CASE WHEN isinf(median_survival_months) THEN -1 ELSE median_survival_months END AS months,
  ev, band, department, circle, round(tenure_months, 6) AS tenure_months, round(compa_ratio, 6) AS compa_ratio,
  perf_rating_current AS perf_rating, round(months_since_promotion, 6) AS months_since_promo FROM scored"""))
def _(spark, d):
    out = scoring.report_rows(rule_scored(spark, d))
    months = F.col("median_survival_months")
    return rounded(out.select("employee_id", "risk_tier", "p_attrition",
                              F.when(months == float("inf"), -1.0).otherwise(months).alias("months"), "ev",
                              "employee_profile.*"))


@query("P19_rounding", _sql("""
SELECT employee_id, round_even(ev / 1000.0, 1) AS ev_thousands, printf('%.4f', p_attrition) AS p_text,
  format('{:,}', CAST(ev AS BIGINT)) AS ev_text FROM scored"""))
def _(spark, d):
    from retenta.operators.explain import whole_units
    return rule_scored(spark, d).select(
        "employee_id", F.bround(F.col("ev") / 1000, 1).alias("ev_thousands"),
        F.format_string("%.4f", "p_attrition").alias("p_text"), whole_units(F.col("ev")).alias("ev_text"))
