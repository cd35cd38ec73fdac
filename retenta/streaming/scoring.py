"""The batch operators over arriving files.

The reference work is batch only. Cleaning, feature and scoring operators are stateless column expressions, so they
take a streaming table as they are; this module only connects them to a source and an append-only sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from retenta.operators.explain import with_route
from retenta.operators.scoring import score_upload
from retenta.sources.logs import audit_rows


def arriving_ids(spark: SparkSession, folder: str, columns: str = "employee_id string") -> DataFrame:
    """Id files dropped into a folder."""
    return spark.readStream.schema(columns).option("header", True).csv(folder)


def each_once(arrivals: DataFrame, keys: Sequence[str] = ("request_id",), time: str = "sent_at", delay: str = "1 day") -> DataFrame:
    """Requests without those seen before: a file that is sent again under another name, or a request that stands in two files,
    counts once. State is kept for ``delay`` behind the latest ``time``."""
    return arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def score_arrivals(arrivals: DataFrame, scored: DataFrame) -> DataFrame:
    """Left join of arriving ids to the scored table: the batch upload operator on a stream."""
    return with_route(score_upload(arrivals, scored))


def append_arrivals(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append audit records of scored arrivals, each source file once."""
    return (audit_rows(rows).writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint).partitionBy("day")
            .trigger(**(trigger or {"availableNow": True})).start())
