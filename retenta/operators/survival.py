"""Survival analysis on per-duration sums.

Rows are reduced to one record per distinct duration first (a map-side combine), and everything ordered by time works
on those records with bucketed running totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from retenta.operators.ordering import (ROWS_PER_BUCKET, bucket_edges, running_totals, with_bucket, _BUCKET)
from retenta.session import stage

LN2 = math.log(2.0)


# --------------------------------------------------------------- Kaplan-Meier and log-rank
def kaplan_meier(df: DataFrame, duration: str, event: str, group: str | None = None, z: float = 1.959963984540054,
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Survival per group and duration with an exponential Greenwood band.

    ``(group, t, n_events, n_at_risk, survival, lower, upper)``; at risk means duration >= t.
    """
    if group == event:
        raise ValueError("the group must not be the event itself")
    key = F.col(group).cast("string") if group else F.lit("all")
    per_t = stage(df.filter(F.col(duration).isNotNull() & F.col(event).isNotNull())
                  .groupBy(key.alias("group"), F.col(duration).cast("double").alias("t"))
                  .agg(F.sum(F.col(event).cast("bigint")).alias("d"), F.count("*").alias("c")), "per-duration")
    edges = bucket_edges(per_t, "t", rows_per_bucket)
    risk = running_totals(per_t, "t", ["c"], ["group"], descending=True, edges=edges)
    n, d = F.col("cum_c"), F.col("d")
    steps = risk.select(
        "group", "t", "d", n.alias("n"),
        F.when(d < n, F.log(1 - d / n)).otherwise(0.0).alias("log_step"),
        (d >= n).cast("bigint").alias("emptied"),
        F.coalesce(F.try_divide(d.cast("double"), n * (n - d)), F.lit(0.0)).alias("green"))
    s = running_totals(steps, "t", ["log_step", "emptied", "green"], ["group"], edges=edges)
    survival = F.when(F.col("cum_emptied") > 0, 0.0).otherwise(F.exp("cum_log_step"))
    inner = (survival > 0) & (survival < 1)
    width = z * F.sqrt("cum_green") / F.abs(F.col("cum_log_step"))
    lower = F.when(inner, F.exp(F.col("cum_log_step") * F.exp(width))).otherwise(survival)
    upper = F.when(inner, F.exp(F.col("cum_log_step") * F.exp(-width))).otherwise(survival)
    return s.select("group", "t", F.col("d").alias("n_events"), F.col("n").alias("n_at_risk"),
                    survival.alias("survival"), lower.alias("lower"), upper.alias("upper"))


#: Tied events of one duration that are summed in one row.
TIES_PER_ROW = 4096


def log_rank(df: DataFrame, duration: str, event: str, group: str, first, second,
             rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Two-group log-rank statistic (chi-square, one degree of freedom) and its p-value."""
    if group == event:
        raise ValueError("the group must not be the event itself")
    e, g = F.col(event).cast("bigint"), F.col(group)
    per_t = stage(df.filter(g.isin(first, second) & F.col(duration).isNotNull())
                  .groupBy(F.col(duration).cast("double").alias("t")).agg(
        F.sum(F.when(g == first, e).otherwise(0)).alias("d1"), F.sum(F.when(g == second, e).otherwise(0)).alias("d2"),
        F.count_if(g == first).alias("c1"), F.count_if(g == second).alias("c2")), "per-duration")
    risk = running_totals(per_t, "t", ["c1", "c2"], descending=True, rows_per_bucket=rows_per_bucket)
    d, n1, n = F.col("d1") + F.col("d2"), F.col("cum_c1"), F.col("cum_c1") + F.col("cum_c2")
    expected = d * n1 / n
    variance = F.coalesce(F.try_divide(d * (n1 / n) * (1 - n1 / n) * (n - d), n - 1), F.lit(0.0))
    sums = risk.agg(F.sum("d1").alias("observed"), F.sum(expected).alias("expected"), F.sum(variance).alias("v"))
    out = sums.select("observed", "expected",
                      F.try_divide(F.pow(F.col("observed") - F.col("expected"), 2), F.col("v")).alias("chi2"))
    return out.withColumn("p_value", chi2_tail(F.col("chi2")))


def chi2_tail(chi2: Column) -> Column:
    """Probability of a larger chi-square with one degree of freedom: ``erfc(sqrt(chi2 / 2))``, as a column.

    The series of the error function below a root of 1.5, where few digits cancel, its continued fraction above.
    """
    x = F.sqrt(chi2 / 2)
    terms = F.sequence(F.lit(1), F.lit(60))
    series = F.aggregate(terms, F.struct(x.alias("term"), x.alias("total")), lambda s, n: F.struct(
        (s["term"] * x * x * -1 / n).alias("term"), (s["total"] - s["term"] * x * x / n / (2 * n + 1)).alias("total")), lambda s: s["total"])
    fraction = F.aggregate(F.reverse(terms), x, lambda s, n: x + n / 2 / s)
    root_pi = math.sqrt(math.pi)
    return F.when(x < 1.5, 1 - series * 2 / root_pi).otherwise(F.exp(-x * x) / root_pi / fraction)


# --------------------------------------------------------------- proportional hazards
@dataclass
class CoxModel:
    covariates: list[str]
    coefficients: list[float]          # per original unit
    means: list[float]
    gradient_norm: float
    log_likelihood: float
    iterations: int
    baseline: DataFrame = field(repr=False)   # (t, h0): cumulative baseline hazard at the covariate means
    gradient: list[float] = field(default_factory=list)   # per row, of the standardised covariates; empty when loaded

    def log_hazard(self) -> Column:
        """Log partial hazard of a row, relative to the covariate means."""
        out = F.lit(0.0)
        for c, b, m in zip(self.covariates, self.coefficients, self.means):
            out = out + (F.col(c) - F.lit(m)) * F.lit(b)
        return out

    def table(self, spark) -> DataFrame:
        rows = [(c, b, math.exp(b), m) for c, b, m in zip(self.covariates, self.coefficients, self.means)]
        return spark.createDataFrame(rows, "covariate string, coefficient double, hazard_ratio double, mean double")


def cox_fit(df: DataFrame, covariates: Sequence[str], duration: str, event: str, ridge: float = 0.1,
            allow_duration: bool = False, max_iter: int = 25, tol: float = 1e-7,
            rows_per_bucket: int = ROWS_PER_BUCKET, ties_per_row: int = TIES_PER_ROW) -> CoxModel:
    """Newton steps on the partial likelihood with Efron's ties and the penalty n * ridge/2 * |beta|² on standardised
    covariates.

    Each step is one pass: rows are summed per duration, sums at risk are running totals over durations, and only the
    gradient and the covariates-by-covariates Hessian reach the driver. The second-order risk sums need no running
    total: they are weighted by the hazard accumulated up to their own duration. A duration with more than
    ``ties_per_row`` tied events is split into rows of so many of them, which are summed apart and then together.
    """
    if duration in covariates and not allow_duration:
        raise ValueError("the duration cannot be a covariate; pass allow_duration=True to override")
    names = list(covariates)
    p = len(names)
    base = df.select(F.col(duration).cast("double").alias("__t"), F.col(event).cast("int").alias("__e"),
                     *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    base = stage(base, "cox-input")
    xs = [f"x{i}" for i in range(p)]
    # A predictable scale: sample deviation; a constant covariate keeps its unit.
    moments = base.agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m_{x}") for x in xs],
                       *[F.stddev_samp(x).alias(f"s_{x}") for x in xs]).first()
    n = moments["n"]
    means = [moments[f"m_{x}"] or 0.0 for x in xs]
    sds = [moments[f"s_{x}"] or 1.0 for x in xs]
    data = base.select("__t", "__e", *[((F.col(x) - m) / s).alias(x) for x, m, s in zip(xs, means, sds)]).persist()
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    # Durations do not change between steps, so neither do the buckets of their running totals.
    edges = bucket_edges(data.select("__t").distinct(), "__t", rows_per_bucket)
    most = data.filter("__e = 1").groupBy("__t").agg(F.count("*").alias("d")).agg(F.max("d")).first()[0] or 0

    def step(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = sum((F.col(x) * F.lit(float(b)) for x, b in zip(xs, beta)), F.lit(0.0))
        rows = data.select("*", F.exp(eta).alias("w"), eta.alias("eta"))
        dead = F.col("__e") == 1

        def of_dead(v: Column) -> Column:
            return F.sum(F.when(dead, v).otherwise(0.0))

        per_t = rows.groupBy("__t").agg(
            F.count_if(dead).alias("d"), of_dead(F.col("eta")).alias("deta"),
            F.sum("w").alias("s0"), of_dead(F.col("w")).alias("e0"),
            *[F.sum(F.col("w") * F.col(x)).alias(f"s1_{i}") for i, x in enumerate(xs)],
            *[of_dead(F.col("w") * F.col(x)).alias(f"e1_{i}") for i, x in enumerate(xs)],
            *[of_dead(F.col(x)).alias(f"ex_{i}") for i, x in enumerate(xs)],
            *[F.sum(F.col("w") * F.col(xs[i]) * F.col(xs[j])).alias(f"s2_{i}_{j}") for i, j in pairs],
            *[of_dead(F.col("w") * F.col(xs[i]) * F.col(xs[j])).alias(f"e2_{i}_{j}") for i, j in pairs])
        risk = running_totals(per_t, "__t", ["s0", *[f"s1_{i}" for i in range(p)]], descending=True,
                              edges=edges)
        ties = _tie_sums(risk, most, ties_per_row)
        acc = running_totals(ties, "__t", ["a"], edges=edges)

        def s(i):
            return F.col(f"cum_s1_{i}")

        def e(i):
            return F.col(f"e1_{i}")

        out = acc.agg(
            (F.sum("deta") - F.sum("logs")).alias("ll"),
            *[(F.sum(f"ex_{i}") - F.sum(s(i) * F.col("a") - e(i) * F.col("b"))).alias(f"g{i}") for i in range(p)],
            *[F.sum(F.col(f"s2_{i}_{j}") * F.col("cum_a") - F.col(f"e2_{i}_{j}") * F.col("b")
                    - s(i) * s(j) * F.col("c0") + (s(i) * e(j) + e(i) * s(j)) * F.col("c1")
                    - e(i) * e(j) * F.col("c2")).alias(f"h{i}_{j}") for i, j in pairs]).first()
        grad = np.array([out[f"g{i}"] for i in range(p)]) - n * ridge * beta
        hess = np.zeros((p, p))
        for i, j in pairs:
            hess[i, j] = hess[j, i] = out[f"h{i}_{j}"]
        return out["ll"] - n * ridge / 2 * float(beta @ beta), grad, hess + n * ridge * np.eye(p)

    try:
        beta = np.zeros(p)
        value, grad, hess = step(beta)
        used = 0
        for used in range(1, max_iter + 1):
            move = np.linalg.lstsq(hess, grad, rcond=None)[0]
            size = 1.0
            while True:
                candidate = beta + size * move
                new_value, new_grad, new_hess = step(candidate)
                if new_value >= value - 1e-9 * abs(value) or size < 1e-4:
                    break
                size /= 2
            beta, value, grad, hess = candidate, new_value, new_grad, new_hess
            if np.abs(grad).max() / n < tol:
                break
        eta = sum((F.col(x) * F.lit(float(b)) for x, b in zip(xs, beta)), F.lit(0.0))
        per_t = data.groupBy(F.col("__t").alias("t")).agg(
            F.count_if(F.col("__e") == 1).alias("d"), F.sum(F.exp(eta)).alias("w"))
        risk = running_totals(per_t, "t", ["w"], descending=True, edges=edges)
        hazard = risk.filter("d > 0").select("t", (F.col("d") / F.col("cum_w")).alias("h"))
        baseline = stage(running_totals(hazard, "t", ["h"], edges=edges).select("t", F.col("cum_h").alias("h0")),
                         "cox-baseline")
    finally:
        data.unpersist()
    return CoxModel(names, [float(b / s) for b, s in zip(beta, sds)], means, float(np.abs(grad).max() / n),
                    float(value), used, baseline, [float(g) / n for g in grad])


def _tie_sums(risk: DataFrame, most: int, per_row: int) -> DataFrame:
    """``risk`` with Efron's sums over the tied events of each duration: the k-th of d sees the risk set less k/d of their weight.

    Rows have ``__t``, ``d``, ``cum_s0`` and ``e0``; ``most`` is the largest d. If that is over ``per_row``, ties become rows of
    (duration, block of k), spread over tasks, and are summed in two levels.
    """
    d = F.col("d")

    def sums(first: Column, count: Column) -> list[Column]:
        shares = F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda k: (first + k) / d)).otherwise(
            F.array().cast("array<double>"))

        def over(f) -> Column:
            return F.aggregate(shares, F.lit(0.0), lambda acc, q: acc + f(q, F.col("cum_s0") - q * F.col("e0")))

        return [over(lambda q, r: 1 / r).alias("a"), over(lambda q, r: q / r).alias("b"), over(lambda q, r: 1 / (r * r)).alias("c0"),
                over(lambda q, r: q / (r * r)).alias("c1"), over(lambda q, r: q * q / (r * r)).alias("c2"),
                over(lambda q, r: F.log(r)).alias("logs")]

    if most <= per_row:
        return risk.select("*", *sums(F.lit(0), d))
    risk = stage(risk, "cox-risk")
    blocks = risk.filter("d > 0").select("__t", "d", "cum_s0", "e0", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.expr(f"(d - 1) div {per_row}"))).alias("block")).repartition("__t", "block")
    first = F.col("block") * per_row
    part = blocks.select("__t", *sums(first, F.least(F.lit(per_row), d - first)))
    names = ["a", "b", "c0", "c1", "c2", "logs"]
    whole = part.groupBy("__t").agg(*[F.sum(c).alias(c) for c in names])
    return risk.join(whole, "__t", "left").select(risk["*"], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


# --------------------------------------------------------------- prediction
def first_at_least(df: DataFrame, target: Column, baseline: DataFrame, name: str,
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the smallest ``t`` of ``baseline(t, h0)`` with ``h0 >= target``; null when the target is never reached.

    The points are merged with the distinct targets in value order, one task per bucket of values; the first point of a later
    bucket fills the gaps.
    """
    points = stage(baseline.groupBy("h0").agg(F.min("t").alias("t")), "points").select(F.col("h0").alias("__y"), F.col("t").alias("__t"))
    rows = df.withColumn("__y", target)
    targets = stage(rows.select("__y").dropna().distinct(), "targets")
    merged = targets.unionByName(points, allowMissingColumns=True)
    edges = bucket_edges(merged, "__y", rows_per_bucket)
    merged = with_bucket(merged, "__y", edges)
    later = Window.orderBy(F.desc(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    nexts = merged.groupBy(_BUCKET).agg(F.min("__t").alias("lo")).select(
        _BUCKET, F.min("lo").over(later).alias("__next"))
    # From the highest value down: a frame that only grows is extended row by row, one that shrinks is read anew for every row.
    ahead = (Window.partitionBy(_BUCKET).orderBy(F.desc("__y"), F.col("__t").isNull())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = merged.withColumn("__f", F.last("__t", ignorenulls=True).over(ahead)).filter(F.col("__t").isNull())
    if edges:
        filled = filled.join(nexts, _BUCKET, "left").withColumn("__f", F.coalesce("__f", "__next"))
    answers = filled.select("__y", F.col("__f").alias(name))        # one bucket has none after it
    return rows.join(answers, "__y", "left").select(*df.columns, name)


def median_survival(df: DataFrame, model: CoxModel, name: str = "median_survival_months", **kw) -> DataFrame:
    """Smallest time with survival <= 0.5; null plus ``survival_is_infinite`` when it is never reached."""
    target = F.lit(LN2) / F.exp(model.log_hazard())
    out = first_at_least(df, target, model.baseline, name, **kw)
    return out.withColumn("survival_is_infinite", F.col(name).isNull() & target.isNotNull())


# --------------------------------------------------------------- concordance
def concordance(df: DataFrame, duration: str, event: str, risk: str,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact Harrell concordance of a risk score (higher risk, shorter time) without forming pairs.

    Distinct risks get dense ranks. Two different ranks first differ at one bit, so each row joins, for every bit, the
    group of rows that share its higher bits; there it counts rows on the other side of the bit that last longer. That
    is about log2(ranks) small records per row, combined map-side, and one set of running totals over time.
    """
    rows = df.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("bigint").alias("e"),
                     F.col(risk).cast("double").alias("r")).dropna()
    cells = stage(rows.groupBy("t", "r").agg(F.sum("e").alias("e"), F.count("*").alias("c")), "concordance")
    ranks = running_totals(stage(cells.groupBy("r").agg(F.lit(1).alias("one")), "risks"), "r", ["one"],
                           rows_per_bucket=rows_per_bucket)
    ranked = cells.join(ranks.select("r", (F.col("cum_one") - 1).alias("rank")), "r")
    top = ranked.agg(F.max("rank")).first()[0] or 0
    bits = max(1, int(top).bit_length())
    rank = F.col("rank")
    levels = ranked.select("t", "e", "c", "rank", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("b"))
    b = F.col("b")
    prefix = F.call_function("shiftright", rank, b + 1)
    high = F.call_function("shiftright", rank, b).bitwiseAND(F.lit(1)) == 1
    e, c = F.col("e"), F.col("c")
    split = levels.groupBy(b.alias("bit"), prefix.alias("prefix"), "t").agg(
        F.sum(F.when(high, e).otherwise(0)).alias("e_hi"), F.sum(F.when(high, 0).otherwise(e)).alias("e_lo"),
        F.sum(F.when(high, c).otherwise(0)).alias("c_hi"), F.sum(F.when(high, 0).otherwise(c)).alias("c_lo"))
    same = ranked.groupBy(F.lit(-1).alias("bit"), rank.alias("prefix"), "t").agg(
        F.sum(e).alias("e_hi"), F.lit(0).cast("bigint").alias("e_lo"),
        F.lit(0).cast("bigint").alias("c_hi"), F.sum(c).alias("c_lo"))
    table = stage(split.unionByName(same), "concordance-levels")
    run = running_totals(table, "t", ["c_hi", "c_lo"], ["bit", "prefix"], descending=True,
                         rows_per_bucket=rows_per_bucket)
    # Later rows, plus rows censored at the same time.
    later_hi = F.col("cum_c_hi") - F.col("e_hi")
    later_lo = F.col("cum_c_lo") - F.col("e_lo")
    real = (F.col("bit") >= 0)
    tie_later = F.col("cum_c_lo") - F.col("e_hi")
    return run.agg(
        F.sum(F.when(real, F.col("e_hi") * later_lo).otherwise(0)).alias("concordant"),
        F.sum(F.when(real, F.col("e_lo") * later_hi).otherwise(0)).alias("discordant"),
        F.sum(F.when(~real, F.col("e_hi") * tie_later).otherwise(0)).alias("tied"),
    ).select("*", F.try_divide(F.col("concordant") + F.col("tied") * 0.5,
                               F.col("concordant") + F.col("discordant") + F.col("tied")).alias("concordance"))
