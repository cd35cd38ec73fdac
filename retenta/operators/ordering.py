"""Order-dependent work without a global window: running totals, exact quantiles, ordered splits, top-k.

Values are spread over buckets whose edges come from approximate percentiles, so a bucket holds about
``rows_per_bucket`` rows whatever the distribution. The edges are a few numbers fixed once per call, which keeps
the bucket of a row the same under retries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BUCKET = 1_000_000
_BUCKET = "__bucket"


def bucket_edges(df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET,
                 n: int | None = None) -> list[float]:
    """Inner edges cutting ``column`` into buckets of about ``rows_per_bucket`` rows; empty for small input.

    ``n`` is the number of rows, or an upper bound, when the caller knows it.
    """
    k = min(math.ceil((df.count() if n is None else n) / rows_per_bucket), 10_000)
    if k <= 1:
        return []
    probs = [i / k for i in range(1, k)]
    edges = df.agg(F.percentile_approx(F.col(column).cast("double"), probs, max(10_000, 10 * k))).first()[0]
    return sorted(set(edges or []))


def with_bucket(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Add the bucket number of ``column``: a monotone function of its value."""
    if not edges:
        return df.withColumn(_BUCKET, F.lit(0))
    splits = [-math.inf, *edges, math.inf]
    cutter = Bucketizer(splits=splits, inputCol="__x", outputCol="__b", handleInvalid="keep")
    return (cutter.transform(df.withColumn("__x", F.col(column).cast("double")))
            .withColumn(_BUCKET, F.col("__b").cast("int")).drop("__x", "__b"))


def running_totals(df: DataFrame, order_col: str, sums: Sequence[str], groups: Sequence[str] = (),
                   descending: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET,
                   edges: Sequence[float] | None = None) -> DataFrame:
    """Add ``cum_<c>``: the sum of ``c`` over the rows of the group up to and including this one.

    ``order_col`` must be unique inside a group. Each bucket is summed by its own task; the totals of earlier
    buckets (one row per group and bucket) are then added. ``edges`` may come from an earlier call.
    """
    edges = bucket_edges(df, order_col, rows_per_bucket) if edges is None else edges
    bucketed = with_bucket(df, order_col, edges)
    turn = F.desc if descending else F.asc
    inside = (Window.partitionBy(*groups, _BUCKET).orderBy(turn(order_col))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = bucketed.select("*", *[F.sum(c).over(inside).alias(f"cum_{c}") for c in sums])
    if not edges:
        return summed.drop(_BUCKET)

    earlier = (Window.partitionBy(*groups).orderBy(turn(_BUCKET))
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        bucketed.groupBy(*groups, _BUCKET).agg(*[F.sum(c).alias(c) for c in sums])
        .select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(_BUCKET).alias("__gb"),
                *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__o_{c}") for c in sums])
    )
    match = F.col(_BUCKET) == F.col("__gb")
    for i, g in enumerate(groups):
        match &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = summed.join(offsets, match, "left")
    return joined.select(*df.columns, *[(F.col(f"cum_{c}") + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in sums])


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Linear-interpolated quantiles: one row ``(column, n, q)`` per column, ``q`` in the order of ``probs``.

    Large input is handled by selection, not by sorting: one pass counts rows per bucket, and only the buckets
    that hold a wanted rank are shuffled. Null and NaN are ignored.
    """
    columns = list(columns)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = (values.unpivot([], columns, "column", "value")
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))
    edges = bucket_edges(long, "value", rows_per_bucket, df.count() * len(columns))
    bucketed = with_bucket(long, "value", edges)
    inside = (Window.partitionBy("column", _BUCKET).orderBy("value")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not edges:
        counted = bucketed.groupBy("column", _BUCKET, "value").agg(F.count("*").alias("n"))
        placed = counted.withColumn("upto", F.sum("n").over(inside)).withColumn(
            "size", F.sum("n").over(Window.partitionBy("column", _BUCKET)))
        return _interpolated(placed, probs)

    # Rows per column and bucket: at most len(columns) x len(edges) numbers.
    per_bucket = bucketed.groupBy("column", _BUCKET).agg(F.count("*").alias("n")).collect()
    total: dict[str, int] = {}
    for r in per_bucket:
        total[r["column"]] = total.get(r["column"], 0) + r["n"]
    ranks = {c: sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)})
             for c, n in total.items()}
    before = {}
    for c in total:
        seen = 0
        for b, n in sorted((r[_BUCKET], r["n"]) for r in per_bucket if r["column"] == c):
            if any(seen <= rank < seen + n for rank in ranks[c]):
                before[f"{c}/{b}"] = seen
            seen += n
    if not before:
        return df.sparkSession.createDataFrame([], "column string, n bigint, q array<double>")
    where = F.concat_ws("/", "column", F.col(_BUCKET))
    offset = F.create_map(*[F.lit(x) for cell in before.items() for x in cell])
    size = F.create_map(*[F.lit(x) for c, n in total.items() for x in (c, n)])
    picked = (bucketed.filter(where.isin(*before)).groupBy("column", _BUCKET, "value").agg(F.count("*").alias("n")))
    placed = picked.withColumn("upto", F.sum("n").over(inside) + offset[where]).withColumn("size", size[F.col("column")])
    return _interpolated(placed, probs)


def _interpolated(placed: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Quantiles from distinct values with their count ``n``, the count ``upto`` and including them, and the ``size``."""
    def at(rank: Column) -> Column:
        holds = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(holds, F.col("value")))

    def position(p: float) -> Column:
        return (F.col("size") - 1) * F.lit(float(p))

    found = placed.groupBy("column").agg(F.max("size").alias("size"), *[
        x for i, p in enumerate(probs)
        for x in (at(F.floor(position(p))).alias(f"lo{i}"), at(F.ceil(position(p))).alias(f"hi{i}"))])
    quantiles = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (position(p) - F.floor(position(p)))
                 for i, p in enumerate(probs)]
    return found.select("column", F.col("size").cast("bigint").alias("n"), F.array(*quantiles).alias("q"))


def quantile_map(df: DataFrame, columns: Sequence[str], probs: Sequence[float], **kw) -> Column:
    """:func:`exact_quantiles` as one scalar ``map<column, array<double>>`` (one entry per column)."""
    table = exact_quantiles(df, columns, probs, **kw)
    return table.agg(F.map_from_entries(F.collect_list(F.struct("column", "q"))).alias("m")).scalar()


def values_at_ranks(df: DataFrame, column: str, ranks: Sequence[int],
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> dict[int, object]:
    """Exact values of ``column`` at 1-based ranks in ascending order. Only buckets holding a rank are sorted."""
    data = df.select(column).filter(F.col(column).isNotNull())
    n = data.count()
    edges = bucket_edges(data, column, rows_per_bucket, n)
    bucketed = with_bucket(data, column, edges)
    sizes = sorted(tuple(r) for r in bucketed.groupBy(_BUCKET).count().collect()) if edges else [(0, n)]
    seen, before, home = 0, {}, {}
    for b, size in sizes:
        for k in ranks:
            if seen < k <= seen + size:
                home[k] = b
                before[b] = seen
        seen += size
    if not home:
        return {}
    offset = F.create_map(*[F.lit(x) for b, s in before.items() for x in (b, s)])
    inside = (bucketed.filter(F.col(_BUCKET).isin(*before)).groupBy(_BUCKET, column)
              .agg(F.count("*").alias("n")))
    w = Window.partitionBy(_BUCKET).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = inside.withColumn("upto", F.sum("n").over(w) + offset[F.col(_BUCKET)])
    found = placed.agg(*[F.min(F.when(F.col("upto") >= k, F.col(column))).alias(f"k{k}") for k in home]).first()
    return {k: found[f"k{k}"] for k in home}


def kth_smallest(df: DataFrame, column: str, k: int, rows_per_bucket: int = ROWS_PER_BUCKET):
    """Exact k-th smallest value (1-based) of ``column``, or None when there is none."""
    return values_at_ranks(df, column, [k], rows_per_bucket).get(k)


def ordered_split(df: DataFrame, order_col: str, fraction: float = 0.80, name: str = "is_train") -> DataFrame:
    """Flag the first ``int(n * fraction)`` rows by ``order_col``, which must be unique."""
    size = int(df.count() * fraction)
    cut = kth_smallest(df, order_col, size) if size else None
    if cut is None:
        return df.withColumn(name, F.lit(False))
    return df.withColumn(name, F.col(order_col) <= F.lit(cut))


def top_k(df: DataFrame, k: int, order: Sequence[Column], groups: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows by ``order``, per group when groups are given.

    The rank filter lets Spark keep only ``k`` rows per group and task before the shuffle.
    """
    if not groups:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
