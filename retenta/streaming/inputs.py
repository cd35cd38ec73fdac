"""Activity measures from arriving events: counts per day, then total and slope per period.

The functions take a batch table or a stream; on a stream both aggregates keep state per open window only, and give a row once,
when the watermark has passed the end of its period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, user: str = "user_id", time: str = "ts", delay: str = "2 days") -> DataFrame:
    """``(user, day, n)``: events per user and day (``day`` is a window). Events later than ``delay`` are not counted on a stream;
    rows without a user or a time never are."""
    at = F.col(time).cast("timestamp")
    rows = events.select(F.col(user).alias("user"), at.alias("at")).dropna().withWatermark("at", delay)
    return rows.groupBy("user", F.window("at", "1 day").alias("day")).agg(F.count("*").alias("n"))


def period_inputs(daily: DataFrame, period: str = "30 days") -> DataFrame:
    """``(user, start, active_days, total, slope)`` per user and period: the least-squares slope of the daily counts over the days
    with events, from sums alone; null with fewer than two such days."""
    placed = daily.select("user", "n", F.window_time("day").alias("at"))
    day = F.unix_date(F.to_date("at"))
    x, y = (day - F.unix_date(F.to_date(F.col("span.start")))).cast("double"), F.col("n").cast("double")
    spans = placed.withColumn("span", F.window("at", period)).withColumn("x", x)
    sums = spans.groupBy("user", "span").agg(
        F.count("*").alias("active_days"), F.sum("n").alias("total"), F.sum("x").alias("sx"), F.sum(y).alias("sy"),
        F.sum(F.col("x") * y).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    k = F.col("active_days")
    slope = F.try_divide(k * F.col("sxy") - F.col("sx") * F.col("sy"), k * F.col("sxx") - F.col("sx") * F.col("sx"))
    return sums.select("user", F.col("span.start").alias("start"), "active_days", "total", slope.alias("slope"))


def append_inputs(events: DataFrame, path: str, checkpoint: str, delay: str = "2 days", period: str = "30 days", **trigger) -> StreamingQuery:
    """Write the measures of every closed period of a stream, each once."""
    return (period_inputs(daily_counts(events, delay=delay), period).writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
