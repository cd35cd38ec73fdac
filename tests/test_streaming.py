import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from retenta.operators.explain import with_route
from retenta.operators.scoring import score_upload
from retenta.sources.logs import AUDIT_SCHEMA
from retenta.streaming import inputs, scoring


def test_stream_equals_batch(spark, tmp_path):
    scored = spark.range(20).select(F.concat(F.lit("C"), "id").alias("employee_id"), (F.col("id") / 20).alias("p_attrition"),
                                    F.col("id").cast("double").alias("ev"), F.lit(1.0).alias("median_survival_months"),
                                    F.when(F.col("id") > 10, "HIGH").otherwise("LOW").alias("risk_tier"))
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text("employee_id\nC1\nC15\nC15\n")
    (folder / "b.csv").write_text("employee_id\nZ9\n")
    for _ in range(2):       # a restart adds nothing
        q = scoring.append_arrivals(scoring.score_arrivals(scoring.arriving_ids(spark, str(folder)), scored), out, str(tmp_path / "cp"))
        q.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.read.schema(AUDIT_SCHEMA).parquet(out).select("employee_id", "ev", "routed_to").collect())
    batch = with_route(score_upload(spark.read.option("header", True).csv(str(folder)), scored))
    want = sorted((r["employee_id"], r["ev"] or 0.0, r["routed_to"]) for r in batch.collect())
    assert got == want and len(got) == 4


def test_a_file_sent_again_counts_once(spark, tmp_path):
    scored = spark.range(20).select(F.concat(F.lit("C"), "id").alias("employee_id"), (F.col("id") / 20).alias("p_attrition"),
                                    F.col("id").cast("double").alias("ev"), F.lit(1.0).alias("median_survival_months"),
                                    F.lit("HIGH").alias("risk_tier"))
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    first = "request_id,employee_id,sent_at\nr1,C1,2024-01-01 10:00:00\nr2,C2,2024-01-01 11:00:00\n"
    (folder / "a.csv").write_text(first)

    def run():
        rows = scoring.each_once(scoring.arriving_ids(spark, str(folder), "request_id string, employee_id string, sent_at timestamp"))
        scoring.append_arrivals(scoring.score_arrivals(rows.select("employee_id"), scored), out, str(tmp_path / "cp")).awaitTermination(90)
        return sorted(r[0] for r in spark.read.schema(AUDIT_SCHEMA).parquet(out).select("employee_id").collect())

    assert run() == ["C1", "C2"]
    (folder / "b.csv").write_text(first)                                                        # the file again
    (folder / "c.csv").write_text("request_id,employee_id,sent_at\nr2,C2,2024-01-01 11:00:00\nr3,C1,2024-01-01 12:00:00\n")
    assert run() == ["C1", "C1", "C2"]
    assert run() == ["C1", "C1", "C2"]


def test_a_batch_is_logged_once(spark, tmp_path):
    from retenta.sources import logs
    df, path = spark.createDataFrame([("E1", "HIGH")], "employee_id string, risk_tier string"), str(tmp_path / "log")
    assert logs.append_audit(df, path, "monday") and not logs.append_audit(df, path, "monday") and logs.append_audit(df, path, "tuesday")
    assert sorted(r[0] for r in logs.read_audit(spark, path).select("batch").collect()) == ["monday", "tuesday"]
    assert logs.append_audit(df, path) and logs.append_audit(df, path) and logs.read_audit(spark, path).count() == 4


def test_inputs_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(5) if k % 50 else None, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 80))) for k in range(1500)]
    events = spark.createDataFrame(sorted(rows, key=lambda r: r[1]) + [(99, datetime(2030, 1, 1))], "user_id int, ts timestamp")
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    ordered = events.orderBy("ts").coalesce(1)
    for part, keep in enumerate(("ts < '2024-02-01'", "ts >= '2024-02-01' and ts < '2029-01-01'", "ts >= '2029-01-01'")):
        ordered.filter(keep).write.mode("append").parquet(source)
        stream = spark.readStream.schema("user_id int, ts timestamp").parquet(source)
        inputs.append_inputs(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    batch = inputs.period_inputs(inputs.daily_counts(events)).filter("user <> 99")
    want = sorted(tuple(r) for r in batch.collect())
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(got) >= 15
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want])
