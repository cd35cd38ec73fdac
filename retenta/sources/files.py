"""Readers and writers of tables, contracts, texts and reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

SEPARATORS = (",", ";", "\t", "|")
CORRUPT = "_corrupt_row"


class UnreadableFile(ValueError):
    """No separator gives more than one column."""


def probe_dialect(spark: SparkSession, path: str, separators: Sequence[str] = SEPARATORS) -> tuple[str, str, bool, list[str]]:
    """Encoding, separator, whether fields hold line breaks, and header of a delimited extract.

    The text is UTF-8 when every line is valid UTF-8, and otherwise Latin-1, which reads any bytes. A line with an odd number
    of quotation marks shows a quoted field that goes on in the next line. Both come from one pass over all lines. The
    separator is the first one whose header row has more than one column.
    """
    lines = spark.read.text(path)
    marks = F.length("value") - F.length(F.translate("value", '"', ""))
    valid, broken = lines.agg(F.bool_and(F.is_valid_utf8("value")), F.bool_or(marks % 2 == 1)).first()
    encoding = "ISO-8859-1" if valid is False else "UTF-8"
    reader = spark.read.options(header=False, encoding=encoding, ignoreLeadingWhiteSpace=True)
    for sep in separators:
        rows = reader.option("sep", sep).csv(path).head(1)
        header = ["" if v is None else str(v) for v in rows[0]] if rows else []
        if len(header) > 1:
            return encoding, sep, bool(broken), header
    raise UnreadableFile(f"no separator fits {path}")


def records(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> DataFrame:
    """Logical rows of delimited files: ``(file, record, text)``, numbered from 1 per file, with line breaks inside quoted fields.

    Files are read line by line in as many splits as they have. For each line it is worked out, from its own text, whether a
    quoted field is open behind it if none is open before it, and if one is. A line for which both answers agree settles the
    state; others keep or change it. The states before each split follow from one such summary per split, so no task reads
    another's lines.
    """
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("at"), value.alias("value"))
    field = rf"(^|{re.escape(sep)})[ \t]*\""

    def open_behind(text):
        return F.regexp_replace(text, field + r'(?:[^"]|"")*+"', "$1x").rlike(field).cast("int")

    closing = r'^(?:[^"]|"")*+"'
    inside = F.when(F.col("value").rlike(closing), open_behind(F.regexp_replace("value", closing, "x"))).otherwise(1)
    judged = lines.select("*", open_behind(F.col("value")).alias("s0"), inside.alias("s1"))

    def states(df: DataFrame, window) -> DataFrame:
        """``open``: whether a quoted field is open before each row, if none is before the first row of the window."""
        swap = F.sum(((F.col("s0") == 1) & (F.col("s1") == 0)).cast("int")).over(window)
        settled = F.last(F.when(F.col("s0") == F.col("s1"), F.struct(F.col("s0").alias("value"), "swaps")), ignorenulls=True)
        behind = df.withColumn("swaps", swap).withColumn("settled", settled.over(window)).withColumn(
            "behind", F.pmod(F.coalesce("settled.value", F.lit(0)) + F.col("swaps") - F.coalesce("settled.swaps", F.lit(0)), F.lit(2)))
        return behind.withColumn("free", F.col("settled").isNull())

    inner = Window.partitionBy("file", "block").orderBy("at")
    running = states(judged, inner)
    ends = running.groupBy("file", "block").agg(F.max_by(F.struct("behind", "free"), "at").alias("end")) \
        .select("file", "block", F.col("end.behind").alias("s0"), F.when(F.col("end.free"), 1 - F.col("end.behind")).otherwise(F.col("end.behind")).alias("s1"))
    outer = Window.partitionBy("file").orderBy("block")
    before = states(ends, outer).select("file", "block", F.coalesce(F.lag("behind").over(outer), F.lit(0)).alias("entered"))
    lagged = F.lag("behind").over(inner)
    free = F.coalesce(F.lag("free").over(inner), F.lit(True))
    opened = F.when(lagged.isNull(), F.col("entered")).when(free, F.pmod(lagged + F.col("entered"), F.lit(2))).otherwise(lagged)
    marked = running.join(before, ["file", "block"]).withColumn("begins", (opened == 0).cast("int"))
    counts = marked.groupBy("file", "block").agg(F.sum("begins").alias("n"))
    bases = counts.select("file", "block", (F.sum("n").over(outer) - F.col("n")).alias("base"))
    placed = marked.withColumn("nth", F.sum("begins").over(inner)).join(bases, ["file", "block"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"])
    return placed.groupBy("file", (F.col("base") + F.col("nth")).alias("record")).agg(F.array_join(parts, "\n").alias("text"))


def read_delimited(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw extract as text columns, and the rows with more fields than the header, kept apart instead of lost.

    Missing fields at the end of a row are null, and line breaks in quoted fields stay. Files are split as usual, those with
    such breaks too (``records``).
    """
    encoding, sep, broken, header = probe_dialect(spark, path)
    seen: dict[str, int] = {}
    names = []
    for raw in header:
        name = raw.lstrip("\ufeff")
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"', "ignoreLeadingWhiteSpace": "true"}
    if broken:
        ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in [*names, CORRUPT])
        rows = records(spark, path, sep, encoding).filter((F.col("record") > 1) & (F.trim("text") != "")) \
            .select(F.from_csv("text", ddl, options).alias("row")).select("row.*")
    else:
        rows = spark.read.schema(schema).options(header=True, encoding=encoding, enforceSchema=True, columnPruning=False, **options).csv(path)
    # Rows of another length than the header are marked. Those with as many separators as the header has names, or more,
    # have a field too many; the others were filled up with nulls.
    outside = F.regexp_replace(CORRUPT, r'"(?:[^"]|"")*"', "")
    long_ = F.coalesce(F.length(outside) - F.length(F.replace(outside, F.lit(sep), F.lit(""))) >= len(names), F.lit(False))
    # The CSV source refuses scans of the marked column alone, so both sides also touch a data column.
    read = F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0
    return rows.filter(~long_ & read).drop(CORRUPT), rows.filter(long_ & read).select(CORRUPT)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def read_contract(spark: SparkSession, path: str) -> list[str]:
    """Ordered feature names, one per line."""
    text = spark.read.text(path, wholetext=True).first()
    return [] if text is None else [line.strip() for line in text[0].splitlines() if line.strip()]


def write_contract(spark: SparkSession, names: Sequence[str], path: str) -> None:
    spark.createDataFrame([("\n".join(names),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Whole files of a folder: ``(source, text)`` with the file name without its extension.

    Undecodable bytes are dropped.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    body = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("source"), body.alias("text"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    df.write.mode("overwrite").json(path)
