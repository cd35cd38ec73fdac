"""Session defaults and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "retenta") -> SparkSession:
    """Single-machine session used by the tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session; a temporary one only for a local session without any."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="retenta-"))
    return context.getCheckpointDir()


_SCRATCH: list[list[str]] = []


def stage(df: DataFrame, label: str = "stage", lasting: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several passes read one derived table: the lineage ends at files that outlive an executor, later
    scans prune columns and push filters down, and the planner sees the true size of small results. Inside ``scratch``
    the files go when the block ends, unless they are ``lasting``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/retenta/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    if _SCRATCH and not lasting:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose staged tables are removed at its end. What it hands on must be staged as ``lasting``."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for name in _SCRATCH.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
