"""Survival queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from retenta import schema
from retenta.operators import survival
from retenta.plans.catalog import on_subjects, once, query, rounded
from retenta.plans.features import imputed_features
from retenta.plans.scored import SCORED_SQL, rule_scored
from retenta.plans.subjects import subjects
from retenta.session import stage

_KM = """
per AS (SELECT gender AS g, tenure_months AS t, sum(attrition_flag) AS d, count(*) AS c FROM subjects WHERE tenure_months IS NOT NULL GROUP BY 1, 2),
risk AS (SELECT *, sum(c) OVER (PARTITION BY g ORDER BY t DESC) AS n FROM per),
steps AS (SELECT *, CASE WHEN d < n THEN ln(1 - d / CAST(n AS DOUBLE)) ELSE 0 END AS ls, CASE WHEN d >= n THEN 1 ELSE 0 END AS em,
  CASE WHEN d < n THEN d / (CAST(n AS DOUBLE) * (n - d)) ELSE 0 END AS gr FROM risk),
run AS (SELECT *, sum(ls) OVER w AS cl, sum(em) OVER w AS ce, sum(gr) OVER w AS cg FROM steps WINDOW w AS (PARTITION BY g ORDER BY t)),
km AS (SELECT *, CASE WHEN ce > 0 THEN 0 ELSE exp(cl) END AS s FROM run)"""


@query("M16_kaplan_meier", on_subjects("""
SELECT g AS "group", round(t, 6) AS t, d AS n_events, n AS n_at_risk, round(s, 6) AS survival,
  round(CASE WHEN s > 0 AND s < 1 THEN exp(cl * exp(1.959963984540054 * sqrt(cg) / abs(cl))) ELSE s END, 6) AS lower,
  round(CASE WHEN s > 0 AND s < 1 THEN exp(cl * exp(-1.959963984540054 * sqrt(cg) / abs(cl))) ELSE s END, 6) AS upper FROM km""", _KM))
def _(spark, d):
    df = subjects(spark, d, ["tenure_months", "attrition_flag", "gender"])
    return rounded(survival.kaplan_meier(df, "tenure_months", "attrition_flag", "gender"))


_LOG_RANK = """
SELECT o AS observed, e AS expected, (o - e) * (o - e) / v AS chi2 FROM (
  SELECT sum(d1) AS o, sum(d * n1 / CAST(n AS DOUBLE)) AS e,
    sum(CASE WHEN n > 1 THEN d * (n1 / CAST(n AS DOUBLE)) * (1 - n1 / CAST(n AS DOUBLE)) * (n - d) / (n - 1) ELSE 0 END) AS v FROM (
    SELECT t, d1, d, sum(c1) OVER (ORDER BY t DESC) AS n1, sum(c) OVER (ORDER BY t DESC) AS n FROM (
      SELECT tenure_months AS t, sum(CASE WHEN gender = 'F' THEN attrition_flag ELSE 0 END) AS d1, sum(attrition_flag) AS d,
        count(CASE WHEN gender = 'F' THEN 1 END) AS c1, count(*) AS c FROM subjects WHERE tenure_months IS NOT NULL GROUP BY 1)))"""


@query("M17_log_rank", on_subjects("SELECT CAST(observed AS BIGINT) AS observed, round(expected, 6) AS expected, round(chi2, 6) AS chi2 FROM (" + _LOG_RANK + ")"))
def _(spark, d):
    df = subjects(spark, d, ["tenure_months", "attrition_flag", "gender"])
    return rounded(survival.log_rank(df, "tenure_months", "attrition_flag", "gender", "F", "M")).drop("p_value")


# The tail by Simpson's rule: erfc(x) is the integral of 2 / sqrt(pi) * exp(-u * u) from x to x + 8.
@query("M17_log_rank_p_value", on_subjects("""
SELECT CAST(round(observed, 6) AS DOUBLE) AS observed, round(expected, 6) AS expected, round(chi2, 6) AS chi2,
  round((SELECT sum(exp(-power(sqrt(chi2 / 2) + k / 1000.0, 2)) * CASE WHEN k IN (0, 8000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
    FROM range(0, 8001) AS t(k)) / 3000 * 2 / sqrt(pi()), 6) AS p_value FROM ("""+ _LOG_RANK + """)"""))
def _(spark, d):
    df = subjects(spark, d, ["tenure_months", "attrition_flag", "gender"])
    return rounded(survival.log_rank(df, "tenure_months", "attrition_flag", "gender", "F", "M").withColumn("observed", F.col("observed").cast("double")))


def _cox(spark, d):
    """The hazard model of all ten covariates; the duration is one of them, as configured."""
    def make():
        table, _ = imputed_features(spark, d)
        df = stage(table.select("employee_id", "attrition_flag", *schema.COX_COVARIATES))
        return df, survival.cox_fit(df, schema.COX_COVARIATES, "tenure_months", "attrition_flag", allow_duration=True)

    return once(spark, d, "cox", make)


@query("M13_cox_coefficients")
def _(spark, d):
    return _cox(spark, d)[1].table(spark)


# At the fit the slope of the penalised likelihood is zero in every direction.
@query("M13_cox_gradient", "SELECT covariate, CAST(0 AS DOUBLE) AS gradient FROM (VALUES "
       + ", ".join(f"('{c}')" for c in schema.COX_COVARIATES) + ") AS t(covariate)")
def _(spark, d):
    model = _cox(spark, d)[1]
    rows = list(zip(model.covariates, model.gradient))
    return spark.createDataFrame(rows, "covariate string, gradient double").select("covariate", (F.round("gradient", 5) + 0.0).alias("gradient"))


@query("M14_median_survival")
def _(spark, d):
    df, model = _cox(spark, d)
    return survival.median_survival(df, model).select("employee_id", "median_survival_months", "survival_is_infinite")


# The lookup with a given hazard: Nelson-Aalen of all subjects, and the rule probability as the log hazard.
@query("J10_hazard_lookup", on_subjects("""
, per AS (SELECT tenure_months AS t, sum(attrition_flag) AS d, count(*) AS c FROM subjects WHERE tenure_months IS NOT NULL GROUP BY 1),
risk AS (SELECT *, sum(c) OVER (ORDER BY t DESC) AS n FROM per),
h AS (SELECT t, sum(d / CAST(n AS DOUBLE)) OVER (ORDER BY t) AS h0 FROM risk WHERE d > 0)
SELECT employee_id, round((SELECT min(t) FROM h WHERE h0 >= ln(CAST(2 AS DOUBLE)) / exp(2 * p_attrition - 1)), 6) AS median_months
FROM scored""".lstrip(), SCORED_SQL).replace("\n, per AS", ",\nper AS"))
def _(spark, d):
    s = stage(rule_scored(spark, d).select("employee_id", "p_attrition"))
    facts = subjects(spark, d, ["tenure_months", "attrition_flag"]).dropna()
    per_t = stage(facts.groupBy(F.col("tenure_months").alias("t")).agg(
        F.sum("attrition_flag").alias("d"), F.count("*").alias("c")))
    from retenta.operators.ordering import running_totals
    risk = running_totals(per_t, "t", ["c"], descending=True)
    hazard = stage(risk.filter("d > 0").select("t", (F.col("d") / F.col("cum_c")).alias("h")))
    baseline = running_totals(hazard, "t", ["h"]).select("t", F.col("cum_h").alias("h0"))
    target = F.lit(survival.LN2) / F.exp(F.col("p_attrition") * 2 - 1)
    return rounded(survival.first_at_least(s, target, baseline, "median_months").select("employee_id", "median_months"))


@query("M15_concordance", on_subjects("""
SELECT concordant, discordant, tied, round((concordant + tied * 0.5) / (concordant + discordant + tied), 6) AS concordance FROM (
SELECT count(CASE WHEN a.r > b.r THEN 1 END) AS concordant, count(CASE WHEN a.r < b.r THEN 1 END) AS discordant,
  count(CASE WHEN a.r = b.r THEN 1 END) AS tied
FROM (SELECT tenure_months AS t, attrition_flag AS e, p_attrition AS r FROM scored WHERE tenure_months IS NOT NULL) a
JOIN (SELECT tenure_months AS t, attrition_flag AS e, p_attrition AS r FROM scored WHERE tenure_months IS NOT NULL) b
ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)))""", SCORED_SQL))
def _(spark, d):
    s = rule_scored(spark, d).select("employee_id", "p_attrition", "tenure_months")
    df = s.join(subjects(spark, d, ["employee_id", "attrition_flag"]), "employee_id")
    return rounded(survival.concordance(df, "tenure_months", "attrition_flag", "p_attrition"))
