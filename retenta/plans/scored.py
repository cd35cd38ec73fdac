"""Rule-scored subject table: the rule score rescaled to [0, 1] stands in for a fitted model's probability.

It needs no training, so that every report over a scored table can be checked exactly in SQL. Its survival column is
``tenure_months * (1 - p)``, infinite below p = 0.05.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from retenta import schema
from retenta.operators import features, scoring
from retenta.plans.subjects import subjects
from retenta.session import stage

_SCORE_INPUTS = ("manager_attrition_rate_6m", "login_freq_slope_30d", "perf_rating_current",
                 "months_since_promotion", "compa_ratio", "hike_vs_band_median", "months_since_hike",
                 "tenure_months")


def rule_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = dict.fromkeys(["order_col", "employee_id", *schema.PROFILE_COLUMNS, *_SCORE_INPUTS])
    # The rescaling looks at the scores twice; staged, the joins behind them run once.
    base = stage(subjects(spark, sf_dir, list(columns)).withColumn("rule_score", features.rule_score()), "ruled")
    scored = features.min_max(base, "rule_score", "p_attrition").withColumn(
        "median_survival_months",
        F.when(F.col("p_attrition") < 0.05, F.lit(float("inf")))
        .otherwise(F.bround(F.col("tenure_months") * (1 - F.col("p_attrition")), 1)))
    return scoring.add_value_and_tier(scored)


SCORED_SQL = """
ruled AS (SELECT *,
  coalesce(2.9 * manager_attrition_rate_6m, 0.0) + coalesce(-0.8 * login_freq_slope_30d, 0.0)
  + CASE WHEN perf_rating_current >= 4.0 AND months_since_promotion > 18 THEN CAST(0.9 AS DOUBLE) ELSE 0.0 END
  + CASE WHEN compa_ratio < 0.85 AND login_freq_slope_30d < 0 THEN CAST(0.7 AS DOUBLE) ELSE 0.0 END
  + CASE WHEN hike_vs_band_median < -1.5 AND months_since_hike < 3 THEN CAST(0.6 AS DOUBLE) ELSE 0.0 END
  + coalesce(0.015 * months_since_hike, 0.0)
  + CASE WHEN tenure_months < 12 THEN CAST(0.1 AS DOUBLE) ELSE 0.0 END AS rule_score FROM subjects),
probs AS (SELECT *, round_even((rule_score - (SELECT min(rule_score) FROM ruled))
  / ((SELECT max(rule_score) FROM ruled) - (SELECT min(rule_score) FROM ruled)), 4) AS p_attrition FROM ruled),
valued AS (SELECT *, round_even(p_attrition * 450000 - 50000, 0) AS ev,
  CASE WHEN p_attrition < 0.05 THEN CAST('inf' AS DOUBLE) ELSE round_even(tenure_months * (1 - p_attrition), 1) END
    AS median_survival_months FROM probs),
scored AS (SELECT *, CASE WHEN p_attrition >= 0.70 AND ev >= 200000 THEN 'CRITICAL'
  WHEN p_attrition >= 0.55 AND ev >= 100000 THEN 'HIGH' WHEN p_attrition >= 0.40 AND ev >= 50000 THEN 'MEDIUM'
  ELSE 'LOW' END AS risk_tier FROM valued)
"""
