"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from retenta import schema
from retenta.operators import profile
from retenta.plans.catalog import on_subjects, query, rounded
from retenta.plans.subjects import DEPARTMENTS, subjects, table
from retenta.session import stage

_NUM = ("tenure_months", "compa_ratio", "perf_rating_current", "months_since_promotion", "months_since_hike",
        "login_freq_30d", "leave_days_30d", "training_completions_90d", "manager_attrition_rate_6m",
        "team_size_change_pct", "login_freq_slope_30d", "performance_rating_delta")


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@query("S2_table_scan", """
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R'""")
def _(spark, d):
    return (table(spark, d, "lineitem").filter((F.col("l_quantity") > 49) & (F.col("l_returnflag") == "R"))
            .select("l_orderkey", "l_partkey", "l_quantity"))


@query("A1_shape", on_subjects("""
SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns, CAST(8 AS BIGINT) AS n_missing_required,
  'circle, tenure_months, attrition_flag, compa_ratio, perf_rating_current, months_since_promotion, months_since_hike, login_freq_30d'
  AS missing_required FROM subjects"""))
def _(spark, d):
    return profile.shape(subjects(spark, d, ["employee_id", "band", "department"]))


@query("A2_null_profile", on_subjects("SELECT * FROM (" + _union(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, "
    f"round_even((count(*) - count({c})) * CAST(100.0 AS DOUBLE) / count(*), 2) AS pct FROM subjects" for c in _NUM)
    + ") WHERE n_null > 0"))
def _(spark, d):
    return profile.null_profile(subjects(spark, d, _NUM))


@query("A3_duplicate_keys", "SELECT count(*) - count(DISTINCT o_custkey) AS n_duplicates FROM orders")
def _(spark, d):
    return profile.duplicate_keys(table(spark, d, "orders"), "o_custkey")


@query("A4_label_values", """
SELECT CAST(quality + toxic * 2 AS DOUBLE) AS value, count(*) AS n_rows, quality + toxic * 2 IN (0, 1) AS is_binary
FROM labels GROUP BY 1, 3""")
def _(spark, d):
    return profile.label_values(table(spark, d, "labels").withColumn("v", F.col("quality") + F.col("toxic") * 2), "v")


@query("A6_overall_rate", on_subjects("""
SELECT round_even(avg(attrition_flag), 4) AS overall_rate, CAST(0.18 AS DOUBLE) AS target_rate,
  round_even(abs(avg(attrition_flag) - 0.18), 4) AS deviation, abs(avg(attrition_flag) - 0.18) > 0.08 AS high_deviation
FROM subjects"""))
def _(spark, d):
    return profile.overall_rate(subjects(spark, d, ["attrition_flag"]))


@query("A7_rates_by_dimension", on_subjects("SELECT dimension, value, round(attrition_rate, 6) AS attrition_rate, n FROM (" + _union(
    f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, avg(attrition_flag) AS attrition_rate, "
    f"count(attrition_flag) AS n FROM subjects WHERE {c} IS NOT NULL GROUP BY 2"
    for c in ("band", "department", "circle", "gender")) + ")"))
def _(spark, d):
    return rounded(profile.rates_by_dimension(
        subjects(spark, d, ["band", "department", "circle", "gender", "attrition_flag"])))


@query("A7_line_rates", "SELECT dimension, value, round(attrition_rate, 6) AS attrition_rate, n FROM (" + _union(
    f"SELECT '{c}' AS dimension, {c} AS value, avg(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS attrition_rate, "
    f"count(*) AS n FROM lineitem GROUP BY 2" for c in ("l_returnflag", "l_linestatus")) + ")")
def _(spark, d):
    lines = table(spark, d, "lineitem").withColumn("deep", (F.col("l_discount") > 0.05).cast("int"))
    return rounded(profile.rates_by_dimension(lines, ("l_returnflag", "l_linestatus"), "deep"))


@query("A8_describe", on_subjects(_union(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    f"round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM subjects" for c in _NUM)))
def _(spark, d):
    return rounded(profile.describe(stage(subjects(spark, d, _NUM))))


@query("A8_describe_lines", _union(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, "
    f"round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(spark, d):
    return rounded(profile.describe(table(spark, d, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount")), 4)


_RANGED = ("compa_ratio", "perf_rating_current", "tenure_months", "months_since_promotion", "months_since_hike",
           "login_freq_30d", "leave_days_30d", "band")
_RANGE_SQL = on_subjects(_union(
    f"SELECT '{c}' AS \"column\", count(CASE WHEN {c} < {schema.EXPECTED_RANGES[c][0]} THEN 1 END) AS below_min, "
    f"count(CASE WHEN {c} > {schema.EXPECTED_RANGES[c][1]} THEN 1 END) AS above_max FROM subjects" for c in _RANGED))


@query("A9_out_of_range", _RANGE_SQL)
@query("W6_range_predicates", _RANGE_SQL)
def _(spark, d):
    return profile.range_counts(subjects(spark, d, _RANGED))


@query("A10_histogram", on_subjects("SELECT \"column\", bin, count(*) AS n FROM (" + _union(
    f"SELECT '{c}' AS \"column\", CAST(least(floor((x - lo) * 30 / (hi - lo)), 29) AS BIGINT) AS bin "
    f"FROM (SELECT {c} AS x FROM subjects WHERE {c} IS NOT NULL), (SELECT min({c}) AS lo, max({c}) AS hi FROM subjects)"
    for c in ("tenure_months", "compa_ratio", "months_since_hike")) + ") GROUP BY 1, 2"))
def _(spark, d):
    cols = ["tenure_months", "compa_ratio", "months_since_hike"]
    return profile.histogram(subjects(spark, d, cols), cols)


_SEGMENT_SQL = on_subjects("""
SELECT 'Band ' || band || ' - ' || department AS segment, rate AS attrition_rate, n,
  printf('%.1f×', rate / overall) AS vs_overall FROM (
    SELECT band, department, round_even(avg(attrition_flag), 3) AS rate, count(employee_id) AS n FROM subjects GROUP BY 1, 2),
  (SELECT avg(attrition_flag) AS overall FROM subjects) WHERE rate > overall * 1.1 AND n >= 10""")


@query("A11_risk_segments", _SEGMENT_SQL)
@query("W7_segment_threshold", _SEGMENT_SQL)
def _(spark, d):
    return profile.risk_segments(subjects(spark, d, ["employee_id", "band", "department", "attrition_flag"]), times=1.1)


@query("A12_high_performer_rate", on_subjects("""
SELECT round_even(hp, 4) AS rate, n, printf('%.1f×', hp / overall) AS vs_overall,
  CASE WHEN hp > overall * 1.5 THEN 'CRITICAL' ELSE 'OK' END AS flag FROM (
  SELECT avg(CASE WHEN perf_rating_current >= 4 THEN attrition_flag END) AS hp, avg(attrition_flag) AS overall,
    count(CASE WHEN perf_rating_current >= 4 THEN 1 END) AS n FROM subjects)"""))
def _(spark, d):
    return profile.high_performer_rate(subjects(spark, d, ["perf_rating_current", "attrition_flag"]))


@query("A13_rate_pivot", on_subjects("SELECT band, " + ", ".join(
    f"round_even(avg(CASE WHEN department = '{x}' THEN attrition_flag END), 3) AS \"{x}\"" for x in DEPARTMENTS)
    + " FROM subjects GROUP BY band"))
def _(spark, d):
    return profile.rate_pivot(subjects(spark, d, ["band", "department", "attrition_flag"]), DEPARTMENTS)


def _bucket_sql(column, edges, labels):
    whens = " ".join(f"WHEN {column} > {a} AND {column} <= {b} THEN '{x}'" for a, b, x in zip(edges, edges[1:], labels))
    pos = " ".join(f"WHEN {column} > {a} AND {column} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return on_subjects(f"""SELECT CASE {whens} ELSE 'unbucketed' END AS bucket, CASE {pos} ELSE -1 END AS position,
  round_even(avg(attrition_flag), 3) AS attrition_rate, count(*) AS n FROM subjects GROUP BY 1, 2""")


@query("A14_rate_by_hike_gap", _bucket_sql("months_since_hike", schema.HIKE_EDGES, schema.HIKE_LABELS))
@query("G4_right_closed_bins", _bucket_sql("months_since_hike", schema.HIKE_EDGES, schema.HIKE_LABELS))
def _(spark, d):
    return profile.bucket_rates(subjects(spark, d, ["months_since_hike", "attrition_flag"]), "months_since_hike",
                                schema.HIKE_EDGES, schema.HIKE_LABELS)


@query("A14_post_appraisal_signal", on_subjects("""
SELECT a AS rate_0_2m, b AS rate_6_12m, a > b AS confirmed FROM (SELECT
  coalesce(round_even(avg(CASE WHEN months_since_hike > 0 AND months_since_hike <= 2 THEN attrition_flag END), 3), 0) AS a,
  coalesce(round_even(avg(CASE WHEN months_since_hike > 6 AND months_since_hike <= 12 THEN attrition_flag END), 3), 0) AS b
  FROM subjects)"""))
def _(spark, d):
    return profile.post_appraisal_signal(subjects(spark, d, ["months_since_hike", "attrition_flag"]))


@query("A15_rate_by_tenure", _bucket_sql("tenure_months", schema.TENURE_EDGES, schema.TENURE_LABELS))
def _(spark, d):
    return profile.bucket_rates(subjects(spark, d, ["tenure_months", "attrition_flag"]), "tenure_months",
                                schema.TENURE_EDGES, schema.TENURE_LABELS)


@query("A15_new_joiner_rate", on_subjects("""
SELECT round_even(r, 4) AS rate, n, CASE WHEN r > 0.30 THEN 'HIGH' ELSE 'OK' END AS flag FROM (
  SELECT avg(CASE WHEN tenure_months <= 12 THEN attrition_flag END) AS r,
         count(CASE WHEN tenure_months <= 12 THEN 1 END) AS n FROM subjects)"""))
def _(spark, d):
    return profile.new_joiner_rate(subjects(spark, d, ["tenure_months", "attrition_flag"]))


@query("A16_iqr_outliers", on_subjects("SELECT * FROM (" + _union(
    f"SELECT '{c}' AS \"column\", count(CASE WHEN {c} < lo THEN 1 END) AS extreme_low, count(CASE WHEN {c} > hi THEN 1 END) "
    f"AS extreme_high, round_even(lo, 3) AS lower_fence, round_even(hi, 3) AS upper_fence, round_even(max({c}), 3) AS max_value "
    f"FROM subjects, (SELECT quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
    f"quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM subjects) GROUP BY lo, hi"
    for c in _NUM) + ") WHERE extreme_low + extreme_high > 0"))
def _(spark, d):
    return profile.iqr_outliers(stage(subjects(spark, d, _NUM)))


def _readiness_sql(tail):
    nulls = _union(
        f"SELECT 'BLOCKER' AS severity, 'null_rate' AS rule, '{c}' AS \"column\", round_even((count(*) - count({c})) "
        f"* CAST(100.0 AS DOUBLE) / count(*), 2) AS value, round_even((count(*) - count({c})) * CAST(100.0 AS DOUBLE) / count(*), 2) > 20 "
        f"AS triggered FROM subjects" for c in schema.REQUIRED)
    ranges = _union(
        f"SELECT 'WARNING', 'out_of_range', '{c}', CAST(count(CASE WHEN {c} < {schema.EXPECTED_RANGES[c][0]} OR "
        f"{c} > {schema.EXPECTED_RANGES[c][1]} THEN 1 END) AS DOUBLE), count(CASE WHEN {c} < {schema.EXPECTED_RANGES[c][0]} OR "
        f"{c} > {schema.EXPECTED_RANGES[c][1]} THEN 1 END) > 10 FROM subjects" for c in _RANGED if c != "band")
    rules = f"""rules AS ({nulls}
UNION ALL SELECT 'BLOCKER', 'duplicate_key', 'employee_id', CAST(count(*) - count(DISTINCT employee_id) AS DOUBLE),
  count(*) > count(DISTINCT employee_id) FROM subjects
UNION ALL SELECT 'BLOCKER', 'non_binary_label', 'attrition_flag', CAST(count(CASE WHEN attrition_flag NOT IN (0, 1) THEN 1 END) AS DOUBLE),
  count(CASE WHEN attrition_flag NOT IN (0, 1) THEN 1 END) > 0 FROM subjects
UNION ALL SELECT 'WARNING', 'rate_deviation', 'attrition_flag', round_even(abs(avg(attrition_flag) - 0.18), 4),
  abs(avg(attrition_flag) - 0.18) > 0.08 FROM subjects
UNION ALL {ranges})"""
    return on_subjects(tail, rules)


_READY = (*schema.REQUIRED, "leave_days_30d")


@query("A17_readiness_rules", _readiness_sql("SELECT * FROM rules"))
def _(spark, d):
    return profile.readiness(stage(subjects(spark, d, _READY)))


@query("A17_verdict", _readiness_sql("""
SELECT CASE WHEN bool_or(severity = 'BLOCKER' AND triggered) THEN 'BLOCKED' ELSE 'READY' END AS verdict,
  NOT bool_or(severity = 'BLOCKER' AND triggered) AS can_proceed,
  count(CASE WHEN severity = 'BLOCKER' AND triggered THEN 1 END) AS n_blockers,
  count(CASE WHEN severity = 'WARNING' AND triggered THEN 1 END) AS n_warnings FROM rules"""))
def _(spark, d):
    return profile.verdict(profile.readiness(stage(subjects(spark, d, _READY))))
