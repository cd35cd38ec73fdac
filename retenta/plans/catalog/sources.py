"""Reader, writer and log queries: the given tables pass through files in the shared folder and are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from retenta import schema
from retenta.operators.explain import with_route
from retenta.operators.grouping import stat_rows
from retenta.plans.catalog import on_subjects, query, rounded
from retenta.plans.features import FEATURE_SQL, PEERS_SQL, contract_of, subject_features
from retenta.plans.scored import SCORED_SQL, rule_scored
from retenta.plans.subjects import ALL_COLUMNS, table
from retenta.session import shared_dir
from retenta.sources import files, logs


def _path(spark, label):
    return f"{shared_dir(spark).rstrip('/')}/retenta/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@query("S1_delimited_read", """
SELECT c_custkey AS customer_key, CASE WHEN c_custkey % 7 = 1 THEN c_name || chr(10) || 'of; ' || c_name ELSE c_name END AS customer_name,
  CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment, (SELECT count(*) FROM customer WHERE c_custkey % 7 = 2) AS n_rejected
FROM customer WHERE c_custkey % 7 <> 2""")
def _(spark, d):
    """All customers as an extract in which some rows lack a field, some have a quoted line break and some a field too many."""
    path, kind = _path(spark, "extract"), F.col("c_custkey") % 7
    name = F.when(kind == 1, F.concat(F.lit('"'), "c_name", F.lit("\nof; "), "c_name", F.lit('"'))).otherwise(F.col("c_name"))
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), name, F.when(kind != 0, F.col("c_mktsegment")),
                       F.when(kind == 2, F.lit("surplus")))
    first = F.monotonically_increasing_id() % (1 << 33) == 0        # every file begins with the header
    lines = table(spark, d, "customer").select(F.when(first, F.array(F.lit("customer key;Customer Name;segment"), line))
                                               .otherwise(F.array(line)).alias("lines"))
    lines.select(F.explode("lines").alias("value")).write.text(path)
    good, bad = files.read_delimited(spark, path)
    from retenta.operators.ingest import clean_column_names
    rejected = bad.count()
    return clean_column_names(good).select(F.col("customer_key").cast("bigint").alias("customer_key"), "customer_name", "segment",
                                           F.lit(rejected).cast("bigint").alias("n_rejected"))


_CONTRACT = [n for n in schema.BASE_FEATURES if n in FEATURE_SQL or n in ALL_COLUMNS]
_CONTRACT = [n for n in _CONTRACT if not n.startswith(("overload_", "onboard_", "interact_overload", "interact_onboard"))] + [
    n for n in FEATURE_SQL if n.startswith(("dept_", "circle_"))]


@query("S3_feature_contract", on_subjects("\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{n}' AS feature, count({FEATURE_SQL.get(n, n)}) AS n_present FROM based"
    for i, n in enumerate(_CONTRACT)), PEERS_SQL))
def _(spark, d):
    path = _path(spark, "contract")
    table_ = subject_features(spark, d)
    files.write_contract(spark, contract_of(table_), path)
    names = files.read_contract(spark, path)
    place = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return stat_rows(table_, names, lambda c: {"n_present": F.count(F.col(f"`{c}`"))}).select(
        place[F.col("column")].alias("position"), F.col("column").alias("feature"), "n_present")


@query("S4_text_folder", "SELECT CAST(sum(length(html)) + count(*) AS BIGINT) AS n_chars FROM pages")
def _(spark, d):
    path = _path(spark, "texts")
    table(spark, d, "pages").select(F.col("html").alias("value")).write.text(path)
    # The writer ends every page with a line break.
    return files.read_texts(spark, path).agg(F.sum(F.length("text")).alias("n_chars"))


@query("S5_csv_round_trip", on_subjects("SELECT employee_id, ev, risk_tier FROM scored", SCORED_SQL))
def _(spark, d):
    path = _path(spark, "csv")
    files.write_csv(rule_scored(spark, d).select("employee_id", "ev", "risk_tier"), path)
    return spark.read.schema("employee_id string, ev double, risk_tier string").option("header", True).csv(path)


@query("S6_report_round_trip", on_subjects("SELECT risk_tier, count(*) AS n FROM scored GROUP BY 1", SCORED_SQL))
def _(spark, d):
    path = _path(spark, "report")
    files.write_report(rule_scored(spark, d).groupBy("risk_tier").agg(F.count("*").alias("n")), path)
    return spark.read.schema("risk_tier string, n bigint").json(path)


_ROUTED = """CASE risk_tier WHEN 'CRITICAL' THEN 'SLACK_ALERT' WHEN 'HIGH' THEN 'WEEKLY_DIGEST' WHEN 'MEDIUM' THEN 'MANAGER_AWARENESS'
  ELSE 'AUDIT_LOG_ONLY' END"""


@query("S7_audit_append", on_subjects(f"""
SELECT employee_id, risk_tier, {_ROUTED} AS routed_to, '' AS recommendation, '' AS error, CAST(2 AS BIGINT) AS n FROM scored""", SCORED_SQL))
def _(spark, d):
    path = _path(spark, "audit")
    routed = with_route(rule_scored(spark, d))
    for _ in range(2):
        logs.append_audit(routed, path)
    return logs.read_audit(spark, path).groupBy("employee_id", "risk_tier", "routed_to", "recommendation", "error").agg(
        F.count("*").alias("n"))


@query("S8_digest_append", on_subjects("SELECT employee_id, ev FROM scored WHERE risk_tier = 'HIGH'", SCORED_SQL))
def _(spark, d):
    path = _path(spark, "digest")
    logs.append_digest(rule_scored(spark, d), path)
    return logs.read_digest(spark, path).select("employee_id", "ev")


@query("K5_recent_audit", """SELECT event_id, user_id FROM events ORDER BY ts DESC, CAST(user_id AS VARCHAR), event_id DESC LIMIT 20""")
def _(spark, d):
    log = table(spark, d, "events").select("event_id", "user_id", F.col("user_id").cast("string").alias("employee_id"),
                                           F.col("ts").alias("created_at"))
    return logs.recent_audit(log).select("event_id", "user_id")


@query("X3_event_inputs", """
WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
spans AS (SELECT user_id, n, (day - DATE '1970-01-01') // 30 AS span, (day - DATE '1970-01-01') % 30 AS x FROM daily)
SELECT user_id AS user, CAST(DATE '1970-01-01' + CAST(span * 30 AS INTEGER) AS VARCHAR) AS start, count(*) AS active_days, CAST(sum(n) AS BIGINT) AS total,
  round(CASE WHEN count(*) > 1 THEN (count(*) * sum(x * n) - sum(x) * sum(n)) / CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) END, 6) AS slope
FROM spans GROUP BY user_id, span""")
def _(spark, d):
    """Login measures per user and period, worked out from the events as the stream does."""
    from retenta.streaming.inputs import daily_counts, period_inputs
    found = period_inputs(daily_counts(table(spark, d, "events")))
    return rounded(found.withColumn("start", F.to_date("start").cast("string")))
