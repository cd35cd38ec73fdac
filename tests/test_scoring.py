import pytest
from pyspark.sql import functions as F

from retenta import schema
from retenta.config import Settings
from retenta.functions.arrays import top_drivers
from retenta.operators import explain, scoring


def test_value_and_tier(spark):
    s = Settings(replacement_cost=100000.0, intervention_cost=10000.0)
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double")
    assert [r[0] for r in df.select(scoring.expected_value(F.col("p"), s)).collect()] == [-10000.0, 40000.0, 90000.0]
    rows = [(.70, 200000.), (.69, 200000.), (.55, 100000.), (.54, 100000.), (.40, 50000.), (.39, 50000.), (.99, 100.)]
    got = [r[0] for r in spark.createDataFrame(rows, "p double, ev double").select(
        scoring.risk_tier(F.col("p"), F.col("ev"))).collect()]
    assert got == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_top_drivers(spark):
    df = spark.createDataFrame([(.5, -.8, .1, -.05)], "a double, b double, c double, d double")
    got = df.select(top_drivers([(c, F.col(c)) for c in "abcd"])).first()[0]
    assert [(r["feature"], r["shap"]) for r in got] == [("b", -.8), ("a", .5), ("c", .1)]
    one = spark.createDataFrame([(.123456789, .2, -.2)], "a double, b double, c double")
    got = one.select(top_drivers([(c, F.col(c)) for c in "abc"])).first()[0]
    assert [r["feature"] for r in got] == ["b", "c", "a"] and got[2]["shap"] == .1235


@pytest.mark.parametrize("scope,n", [("CRITICAL", 1), ("HIGH", 2), ("ALL", 3), ("high", 2), ("typo", 1)])
def test_scopes(scope, n):
    assert len(scoring.scope_tiers(scope)) == n


def people(spark, rows):
    return spark.createDataFrame(rows, "employee_id string, risk_tier string, p_attrition double, ev double")


def test_budget(spark):
    df = people(spark, [("a", "CRITICAL", .6, 100000.), ("b", "HIGH", .8, 200000.), ("c", "LOW", .1, 5.)])
    b = scoring.budget_summary(df).first()
    assert (b["total_ev_urgent"], b["expected_replacements"], b["replacement_cost_avoided"]) == (300000, 1.4, 630000)
    assert scoring.budget_summary(df.limit(0)).first()["net_roi"] == 0
    two = people(spark, [("a", "CRITICAL", .8, 1.), ("b", "CRITICAL", .6, 1.)])
    sim = {r["simulation_tier"]: r for r in scoring.budget_scenarios(two).collect()}
    assert sim["CRITICAL"]["employees_affected"] == 2 and sim["CRITICAL"]["total_intervention_cost"] == 100000
    empty = scoring.budget_scenarios(two.limit(0)).first()
    assert empty["employees_affected"] == 0 and empty["net_roi"] == 0


def test_published_budget_identity(spark):
    df = spark.range(225).select(F.col("id").cast("string").alias("employee_id"), F.lit("CRITICAL").alias("risk_tier"),
                                 F.lit(0.98765).alias("p_attrition"), F.lit(1.0).alias("ev"))
    r = scoring.budget_scenarios(df).first()
    assert r["total_intervention_cost"] == 11_250_000 and r["net_roi"] == 6.67 and r["payback_months"] == 1.8


def test_tiers_sum_to_rows_and_upload(spark):
    df = people(spark, [("a", "CRITICAL", .6, 1.), ("b", "LOW", .8, 2.)]).withColumn("median_survival_months", F.lit(3.0))
    dist = scoring.tier_distribution(df).collect()
    assert [r["risk_tier"] for r in dist] == list(schema.TIERS) and sum(r["n"] for r in dist) == 2
    up = spark.createDataFrame([("a",), ("a",), ("zz",)], "employee_id string")
    assert tuple(scoring.upload_summary(scoring.score_upload(up, df)).first()) == (3, 2, 1)
    with pytest.raises(ValueError):
        scoring.score_upload(up.toDF("other"), df)
    with pytest.raises(LookupError):
        scoring.require_rows(scoring.one_subject(df, "nobody"), "no such subject")
    assert scoring.tier_and_route(df, [], ["X"]).count() == 2


def test_department_report_is_whole(spark):
    """Grid, totals and critical subjects of each department, or of the one that is asked for in any case."""
    df = spark.createDataFrame(
        [("a", "Sales", 3, "CRITICAL", .9, 300000.), ("b", "Sales", 3, "LOW", .1, 5.), ("c", "Sales", 4, "HIGH", .6, 200000.),
         ("d", "IT", 3, "CRITICAL", .8, 250000.)],
        "employee_id string, department string, band int, risk_tier string, p_attrition double, ev double")
    one = scoring.department_report(df, "sALES")
    assert sorted(tuple(r) for r in one.grid.collect()) == [("Sales", 3, .5, 1, 2, 300005.), ("Sales", 4, .6, 1, 1, 200000.)]
    assert [r.asDict() for r in one.totals.collect()] == [
        {"department": "Sales", "total_employees": 3, "avg_p_attrition": .533, "critical_count": 1}]
    assert [tuple(r) for r in one.critical.select("department", "employee_id", "band", "p_attrition", "ev").collect()] == [
        ("Sales", "a", 3, .9, 300000.)]
    every = scoring.department_report(df)
    assert sorted(r["department"] for r in every.totals.collect()) == ["IT", "Sales"]
    assert every.grid.count() == 3 and every.critical.count() == 2
    with pytest.raises(LookupError):
        scoring.require_rows(scoring.department_report(df, "Legal").totals, "no such department")


def drivers(spark, text, error=None):
    return spark.createDataFrame([("E1", text, error)], "employee_id string, top_shap_drivers string, error string")


def test_driver_labels(spark):
    r = explain.with_driver_labels(drivers(spark, '[{"feature":"comp_compa_ratio","shap":0.45},{"feature":"some_thing","shap":-0.2}]')).first()
    assert [tuple(x) for x in r["shap_drivers"]] == [
        ("comp_compa_ratio", "Salary below market benchmark", .45, "RISK FACTOR"), ("some_thing", "some thing", -.2, "PROTECTIVE")]
    kept = explain.with_driver_labels(drivers(spark, "[]", "before")).first()
    assert kept["error"] == "before" and kept["shap_drivers"] is None
    assert explain.with_driver_labels(drivers(spark, "not json")).first()["error"] is not None


def test_routes(spark):
    rows = [("CRITICAL", None), ("HIGH", None), ("MEDIUM", None), ("LOW", None), ("CRITICAL", "bad")]
    df = spark.createDataFrame(rows, "risk_tier string, error string")
    assert [r["routed_to"] for r in explain.with_route(df).collect()] == [
        "SLACK_ALERT", "WEEKLY_DIGEST", "MANAGER_AWARENESS", "AUDIT_LOG_ONLY", "ERROR_LOG"]


def test_replies(spark):
    doc = '{"narrative": "n", "immediate_actions": ["a"]}'
    texts = [f"x ```json\n{doc}\n``` y", f"```\n{doc}\n```", doc, "not json at all"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(explain.parse_reply(F.col("t"))).collect()]
    assert [g["narrative"] for g in got] == ["n", "n", "n", "not json at all"]
    assert got[3]["timeline"] == "ASAP" and got[3]["intervention_window"] == "Unknown"


def test_alert(spark):
    df = spark.createDataFrame([("E123", 5, "Sales", "North", .82, 319000.0)],
                               "employee_id string, band int, department string, circle string, p_attrition double, ev double")
    df = df.withColumn("shap_drivers", F.array(F.struct(F.lit("Salary below").alias("label"))))
    rec = F.struct(F.lit("Because").alias("narrative"), F.array(F.lit("Give a raise")).alias("immediate_actions"))
    text = explain.alert_payload(df.withColumn("recommendation", rec)).first()["payload"]
    for part in ("E123", "0.82", "Rs 319,000", "- Salary below", "Because", "1) Give a raise"):
        assert part in text
    assert "No advice yet" in explain.alert_payload(df).first()["payload"]


def test_signed_impacts(spark):
    df = spark.createDataFrame([(.1234,), (-.5,)], "s double")
    d = F.array(F.struct(F.lit("L").alias("label"), F.col("s").alias("shap"), F.lit("D").alias("direction")))
    assert [r[0] for r in df.select(explain.driver_lines(d)).collect()] == [
        "- L (weight +0.123) — D", "- L (weight -0.500) — D"]
