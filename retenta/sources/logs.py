"""Append-only audit and digest tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

AUDIT_SCHEMA = ("id string, employee_id string, p_attrition double, ev double, risk_tier string, routed_to string, "
                "recommendation string, error string, created_at timestamp, batch string, day date")
DIGEST_SCHEMA = ("employee_id string, risk_tier string, p_attrition double, ev double, recommendation string, "
                 "added_at timestamp")


def _optional(df: DataFrame, column: str, default):
    value = F.col(column) if column in df.columns else F.lit(None)
    kind = "double" if isinstance(default, float) else "string"
    return F.coalesce(value.cast(kind), F.lit(default)).alias(column)


def audit_rows(df: DataFrame, batch: str | None = None) -> DataFrame:
    """Audit records of routed subjects; absent fields become 0 or an empty text, and errors log as tier ERROR."""
    error = _optional(df, "error", "")
    tier = F.when(error != "", "ERROR").otherwise(F.coalesce(F.col("risk_tier"), F.lit("")))
    now = F.current_timestamp()
    return df.select(
        F.sha2(F.concat_ws("|", "employee_id", now.cast("string")), 256).alias("id"), "employee_id",
        _optional(df, "p_attrition", 0.0), _optional(df, "ev", 0.0), tier.alias("risk_tier"),
        _optional(df, "routed_to", ""), _optional(df, "recommendation", ""), error,
        now.alias("created_at"), F.lit(batch).cast("string").alias("batch"), F.to_date(now).alias("day"))


def append_audit(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """One append for the whole batch, partitioned by day. A ``batch`` that the log has already is not written again (an append
    that failed has left no rows); whether anything was written is returned."""
    if batch is not None and not read_audit(df.sparkSession, path).filter(F.col("batch") == batch).isEmpty():
        return False
    audit_rows(df, batch).write.mode("append").partitionBy("day").parquet(path)
    return True


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The log so far; an empty table when nothing was written yet."""
    try:
        return spark.read.schema(AUDIT_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], AUDIT_SCHEMA)


def recent_audit(log: DataFrame, limit: int = 20) -> DataFrame:
    return log.orderBy(F.desc("created_at"), "employee_id").limit(limit)


def digest_rows(df: DataFrame) -> DataFrame:
    """Only the HIGH tier goes to the digest."""
    return df.filter(F.col("risk_tier") == "HIGH").select(
        "employee_id", "risk_tier", "p_attrition", "ev", _optional(df, "recommendation", ""),
        F.current_timestamp().alias("added_at"))


def append_digest(df: DataFrame, path: str) -> None:
    digest_rows(df).write.mode("append").parquet(path)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Digest so far; an absent digest is an empty start. A damaged file is an error, for its rows would be lost."""
    try:
        return spark.read.schema(DIGEST_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], DIGEST_SCHEMA)
