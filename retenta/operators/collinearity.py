"""Collinearity screening: variance inflation, correlated pairs, L1 selection and the combined recommendation."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from retenta.operators import standardise
from retenta.operators.ordering import values_at_ranks
from retenta.session import stage

DUMMY_PREFIXES = ("dept_", "circle_")


def pair_moments(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Number of rows, sums, sums of squares and cross sums of every pair of columns over the rows that have both: an array of
    shape (4, columns, columns), where entry (i, j) of the sums is that of column i.

    Values are taken from their mean first, so that no digits cancel. Each task reduces its batches to matrix products; what is
    shuffled is one small matrix per task, and only the total reaches the driver.
    """
    d = len(columns)
    numeric = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    middle = np.array([x or 0.0 for x in numeric.agg(*[F.avg(f"c{i}") for i in range(d)]).first()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - middle
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]) & ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4 * d * d)), pa.array(total.ravel())], names=["at", "value"])

    sums = numeric.mapInArrow(work, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(4 * d * d)
    out[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    return out.reshape(4, d, d)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson matrix over the rows that have both columns of a pair; NaN where one is constant there or fewer than two rows have
    both. A constant is a column whose variance is lost in the rounding of its values."""
    n, s, q, c = pair_moments(df, columns)
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = q - s * s / n
        spread = np.where((n > 1) & (spread > 1e-14 * q), spread, np.nan)
        return np.clip((c - s * s.T / n) / np.sqrt(spread * spread.T), -1.0, 1.0)


def _inflation(matrix: np.ndarray) -> list[float | None]:
    """1 / (1 - R²) of each column on the others; None for a constant column, infinite for a dependent one."""
    usable = [i for i in range(len(matrix)) if not np.isnan(np.delete(matrix[i], i)).all() or len(matrix) == 1]
    out: list[float | None] = [None] * len(matrix)
    core = matrix[np.ix_(usable, usable)]
    for k, i in enumerate(usable):
        others = np.delete(np.arange(len(usable)), k)
        r = core[k, others]
        explained = float(r @ np.linalg.pinv(core[np.ix_(others, others)], rcond=1e-10) @ r) if len(others) else 0.0
        out[i] = math.inf if 1 - explained < 1e-9 else 1 / (1 - explained)
    return out


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, vif)`` with 2 decimals, from the correlation matrix."""
    values = _inflation(correlation_matrix(df, columns))
    rows = [(c, None if v is None else (v if math.isinf(v) else round(v, 2))) for c, v in zip(columns, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def inflation_bands(vif: DataFrame) -> DataFrame:
    band = (F.when(F.col("vif") > 10, "critical").when(F.col("vif") > 5, "high")
            .when(F.col("vif") > 2, "moderate").otherwise("clean"))
    return vif.withColumn("band", band)


def correlation_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle of the matrix in long form, without dummy columns."""
    core = [c for c in columns if not c.startswith(DUMMY_PREFIXES)]
    m = correlation_matrix(df, core)
    rows = [(i, j, core[i], core[j], None if np.isnan(m[i, j]) else float(m[i, j]))
            for i in range(len(core)) for j in range(i + 1, len(core))]
    return df.sparkSession.createDataFrame(
        rows, "position_1 int, position_2 int, feature_1 string, feature_2 string, r double")


def high_pairs(correlations: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs with |r| strictly above the threshold, strongest first; the test comes before rounding."""
    return (correlations.filter(F.abs("r") > threshold)
            .select("feature_1", "feature_2", F.bround("r", 3).alias("r"), F.bround(F.abs("r"), 3).alias("abs_r"))
            .orderBy(F.desc("abs_r"), "feature_1", "feature_2"))


def correlated_drops(pairs: DataFrame, vif: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Of each pair above the threshold, the feature with the higher inflation (the second one on a tie)."""
    first = vif.select(F.col("feature").alias("feature_1"), F.col("vif").alias("vif_1"))
    second = vif.select(F.col("feature").alias("feature_2"), F.col("vif").alias("vif_2"))
    both = (pairs.filter(F.col("abs_r") > threshold).join(first, "feature_1", "left").join(second, "feature_2", "left"))
    worse = F.coalesce("vif_1", F.lit(0.0)) > F.coalesce("vif_2", F.lit(0.0))
    return both.select(F.when(worse, F.col("feature_1")).otherwise(F.col("feature_2")).alias("feature")).distinct()


def recommend_drops(flags: DataFrame, protected_prefix: str = "interact_") -> DataFrame:
    """Features flagged by inflation and by another method, interactions excepted.

    ``flags`` has ``(feature, by_vif, by_l1, by_corr)``.
    """
    return flags.filter(F.col("by_vif") & (F.col("by_l1") | F.col("by_corr"))
                        & ~F.startswith("feature", F.lit(protected_prefix))).select("feature")


def remaining_features(contract: DataFrame, drops: DataFrame) -> DataFrame:
    return contract.join(drops, "feature", "left_anti")


# --------------------------------------------------------------- L1 selection
def stratified_folds(df: DataFrame, label: str, order_col: str, folds: int = 5, name: str = "fold") -> DataFrame:
    """Consecutive folds inside each class by ``order_col``; class sizes per fold differ by at most one.

    The fold borders are values selected by rank, so no class is sorted in one task.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    expr, start = None, 0
    for value in sorted(sizes):
        n, borders, upto = sizes[value], [], 0
        for f in range(folds - 1):
            upto += len(range((f - start) % folds, n, folds))
            borders.append(upto)
        found = values_at_ranks(df.filter(F.col(label) == value), order_col, [b for b in borders if b])
        inside = F.lit(folds - 1)
        for f in reversed(range(folds - 1)):
            if borders[f]:
                inside = F.when(F.col(order_col) <= F.lit(found[borders[f]]), f).otherwise(inside)
        expr = (F.when(F.col(label) == value, inside) if expr is None else expr.when(F.col(label) == value, inside))
        start = (start + n) % folds
    return df.withColumn(name, expr)


#: Rows whose products of columns are held at once, slope outside the penalty at which a fit ends, and halvings of a step.
_ROWS, _GAP, _HALVINGS = 2048, 1e-9, 30


def _pass(data: DataFrame, p: int, betas: np.ndarray, held: np.ndarray, size: int, sums) -> np.ndarray:
    """``sums(x, y, w, margin, taken)`` added up over all rows, one line of ``size`` numbers per model.

    ``betas`` has one model per line, its intercept first; ``x`` has one column per line, after a line of ones, so that products of
    columns run along memory, and ``margin`` and ``taken`` have one model per line. A row is ``taken`` by the models that hold out
    another fold than its own. Each task reduces its batches; what is shuffled is one line per task and model, and only the totals
    reach the driver.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(betas), size))
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float, copy=False)
            if np.isnan(table).any():
                raise ValueError("a column, the label or its weight is null or not a number")
            for lo in range(0, table.shape[1], _ROWS):
                rows = table[:, lo:lo + _ROWS]
                x = np.vstack([np.ones(rows.shape[1]), rows[:p]])
                total += sums(x, rows[p], rows[p + 1], betas @ x, rows[p + 2] != held[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    found = data.mapInArrow(work, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(len(betas) * size)
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return out.reshape(len(betas), size)


def _slopes(data: DataFrame, p: int, betas: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted mean loss of every model, its first and its second derivatives, in one pass."""
    upper = np.triu_indices(p + 1)
    ends = np.cumsum([0, *range(p + 1, 0, -1)])

    def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray, taken: np.ndarray) -> np.ndarray:
        low = np.exp(-np.abs(margin))
        loss = np.maximum(margin, 0.0) + np.log1p(low) - y * margin
        q, w = np.where(margin >= 0, 1.0, low) / (1.0 + low), w * taken
        pairs = np.empty((ends[-1], x.shape[1]))
        for i in range(p + 1):
            np.multiply(x[i], x[i:], out=pairs[ends[i]:ends[i + 1]])
        return np.column_stack([w.sum(1), (w * loss).sum(1), (w * (q - y)) @ x.T, (w * q * (1 - q)) @ pairs.T])

    found = _pass(data, p, betas, held, 2 + p + 1 + len(upper[0]), sums)
    found = found[:, 1:] / found[:, :1]
    curves = np.zeros((len(betas), p + 1, p + 1))
    curves[:, upper[0], upper[1]] = curves[:, upper[1], upper[0]] = found[:, p + 2:]
    return found[:, 0], found[:, 1:p + 2], curves


def _outside(betas: np.ndarray, slopes: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """How far each slope lies outside what the penalty allows at its coefficient (none on the intercept)."""
    limit = np.column_stack([np.zeros(len(betas)), np.repeat(strength[:, None], betas.shape[1] - 1, axis=1)])
    return np.where(betas != 0, np.abs(slopes + limit * np.sign(betas)), np.maximum(0.0, np.abs(slopes) - limit))


def _descent(curve: np.ndarray, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Move to the minimum of a quadratic with that curvature that falls along ``pull``; and the direction without curvature (columns
    that add up to one another) along which it falls, if any."""
    size = np.sqrt(np.where(np.diag(curve) > 1e-14, np.diag(curve), 1.0))
    bend, ways = np.linalg.eigh(curve / np.outer(size, size))
    along, firm = ways.T @ (pull / size), bend > 1e-14 * bend[-1]
    level = ways[:, ~firm] @ along[~firm]
    falls = np.abs(level * size).max(initial=0.0) > _GAP
    return ways[:, firm] @ (along[firm] / bend[firm]) / size, level / size if falls else None


def _reach(at: np.ndarray, sign: np.ndarray, move: np.ndarray) -> np.ndarray:
    """How many times the move takes each coefficient with a sign to zero; infinite where it leads away from it."""
    closing = move * sign < 0
    return np.where(closing, -at / np.where(closing, move, 1.0), np.inf)


def _quadratic_minimum(start: np.ndarray, slope: np.ndarray, curve: np.ndarray, strength: float) -> np.ndarray:
    """Exact minimum of a quadratic, given by its slope and curvature at ``start``, with the penalty (none on the intercept, the first).

    Feature-sign search: the coefficients with a sign go to their common minimum and stop where the first one reaches zero, which
    then drops out; when none does, the coefficient at zero whose slope is farthest outside the penalty joins. The value falls with
    every turn, and collinear columns cost no more turns than others. The bound on the turns is met only where columns are dependent
    to within rounding; the point reached then is still lower than the start.
    """
    cost, barred = np.full(len(start), strength), np.zeros(len(start), dtype=bool)
    cost[0] = 0.0
    at, sign, active, whole_steps = start.copy(), np.sign(start), start != 0, 0
    active[0], sign[0] = True, 0.0
    for _ in range(20 * len(start)):
        now, joined = slope + curve @ (at - start), -1
        left = np.abs(now + cost * sign)[active].max()
        if whole_steps > 2 or whole_steps and left <= _GAP / 100:       # further whole steps would only clear rounding
            outside = np.where(active | barred, -np.inf, np.abs(now) - cost)
            joined = int(np.argmax(outside))
            if outside[joined] <= _GAP / 100:
                break
            active[joined], sign[joined], whole_steps = True, -np.sign(now[joined]), 0
        on = np.flatnonzero(active)
        move, level = _descent(curve[np.ix_(on, on)], -(now + cost * sign)[on])
        reach, step = _reach(at[on], sign[on], move), 1.0
        if level is not None and np.isfinite(far := _reach(at[on], sign[on], level)).any():
            move, reach, step = level, far, np.inf
        step = min(step, reach.min())
        hit = on[reach <= step]
        at[on] += step * move
        at[hit], sign[hit], active[hit] = 0.0, 0.0, False
        if joined in hit:                                               # it turned back at once: what was outside is rounding
            barred[joined] = True
        elif joined >= 0 or len(hit):
            barred[:] = False
        whole_steps = 0 if len(hit) else whole_steps + 1
    return at


def _newton_move(betas: np.ndarray, slopes: np.ndarray, curves: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Move to the minimum of each model's quadratic approximation with its penalty."""
    return np.array([_quadratic_minimum(*model) for model in zip(betas, slopes, curves, strength)]) - betas


def _l1_fits(data: DataFrame, p: int, strength: np.ndarray, held: np.ndarray, max_iter: int, start: np.ndarray | None = None
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (intercept first), slopes of the mean loss there and number of steps of every model, fitted side by side.

    Newton steps on the mean loss with the penalty ``strength * |coefficients|``, halved where they do not lower it. A pass over
    the rows tries one step of all the models that have not ended.
    """
    at = np.zeros((len(strength), p + 1)) if start is None else start.copy()
    loss, slopes, curves = _slopes(data, p, at, held)
    value = loss + strength * np.abs(at[:, 1:]).sum(1)
    steps, sizes, moves = np.zeros(len(at), dtype=int), np.ones(len(at)), np.zeros_like(at)
    fresh, going = np.ones(len(at), dtype=bool), np.ones(len(at), dtype=bool)
    while True:
        going &= (_outside(at, slopes, strength).max(1) > _GAP) & (steps < max_iter) & (sizes > 0.5 ** _HALVINGS)
        live = np.flatnonzero(going)
        if not len(live):
            return at, slopes, steps
        turn = live[fresh[live]]
        if len(turn):
            moves[turn] = _newton_move(at[turn], slopes[turn], curves[turn], strength[turn])
        tried = at[live] + sizes[live, None] * moves[live]
        new_loss, new_slopes, new_curves = _slopes(data, p, tried, held[live])
        new_value = new_loss + strength[live] * np.abs(tried[:, 1:]).sum(1)
        better = new_value <= value[live] + 1e-12 * np.abs(value[live])
        won, lost = live[better], live[~better]
        at[won], value[won], slopes[won], curves[won] = tried[better], new_value[better], new_slopes[better], new_curves[better]
        steps[won] += 1
        sizes[won], sizes[lost] = 1.0, sizes[lost] / 2
        fresh[won], fresh[lost] = True, False


def l1_selection(df: DataFrame, columns: Sequence[str], label: str, order_col: str, strengths: int = 10,
                 folds: int = 5, max_iter: int = 3000, parallelism: int = 4) -> DataFrame:
    """Cross-validated L1 logistic regression on standardised columns: ``(feature, coefficient, zeroed, best_c, gap, iterations,
    converged)``.

    ``strengths`` values of C between 1e-4 and 1e4 compete on accuracy. The weighted loss is averaged, so a given C
    is a penalty of ``1 / (C * total weight)``; balanced weights add up to the number of rows. ``gap`` is how far the slope of the
    mean loss lies outside what the penalty allows at the coefficient (zero at the optimum), found by a pass of its own.

    All fits of the search go over the rows together, so that the number of passes is the number of Newton steps of the slowest
    fit. ``parallelism`` is kept for callers; there are no separate fits to run side by side.
    """
    scaled = standardise.balanced_weights(standardise.scale(df, columns), label)
    p, names = len(columns), [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    data = stage(stratified_folds(scaled, label, order_col, folds).select(
        *names, F.col(label).cast("double").alias("y"), F.col("weight").cast("double").alias("w"), F.col("fold").cast("double").alias("fold")),
        "l1-rows")
    n = data.count()
    grid = [float(c) for c in np.logspace(-4, 4, strengths)]
    held = np.repeat(np.arange(folds), strengths)
    betas, _, _ = _l1_fits(data, p, np.tile([1 / (c * n * (folds - 1) / folds) for c in grid], folds), held, max_iter)

    def right(x: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray, taken: np.ndarray) -> np.ndarray:
        return np.column_stack([(~taken).sum(1), (~taken & ((margin > 0) == (y == 1))).sum(1)])

    counts = _pass(data, p, betas, held, 2, right).reshape(folds, strengths, 2)
    chosen = int(np.argmax((counts[:, :, 1] / np.maximum(counts[:, :, 0], 1)).mean(0)))
    best = grid[chosen]
    strength = np.array([1 / (best * n)])
    nobody = np.array([-1])
    fitted, _, steps = _l1_fits(data, p, strength, nobody, max_iter, betas.reshape(folds, strengths, p + 1)[:, chosen].mean(0)[None])
    _, slopes, _ = _slopes(data, p, fitted, nobody)
    gaps = _outside(fitted, slopes, strength)[0, 1:]
    rows = [(c, float(b), bool(b == 0.0), best, float(g), int(steps[0]), bool(steps[0] < max_iter))
            for c, b, g in zip(columns, fitted[0, 1:], gaps)]
    return df.sparkSession.createDataFrame(
        rows, "feature string, coefficient double, zeroed boolean, best_c double, gap double, iterations int, converged boolean")


def drop_report(vif: DataFrame, l1: DataFrame, pairs: DataFrame, contract: Iterable[str]) -> DataFrame:
    """One row per feature with what each method says and the recommendation."""
    by_corr = correlated_drops(pairs, vif).withColumn("by_corr", F.lit(True))
    names = vif.sparkSession.createDataFrame([(c,) for c in contract], "feature string")
    flags = (names.join(vif.select("feature", (F.col("vif") > 10).alias("by_vif")), "feature", "left")
             .join(l1.select("feature", F.col("zeroed").alias("by_l1")), "feature", "left")
             .join(by_corr, "feature", "left").na.fill(False, ["by_vif", "by_l1", "by_corr"]))
    drops = recommend_drops(flags).withColumn("drop", F.lit(True))
    return flags.join(drops, "feature", "left").na.fill(False, ["drop"])
