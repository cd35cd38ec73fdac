"""Classifiers, scoring, attributions and run metadata."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from retenta.config import DEFAULTS, Settings
from retenta.operators import evaluation, standardise
from retenta.session import shared_dir

LABEL = "attrition_flag"


def _scaler_stage(fitted: dict[str, tuple[float, float]]) -> SQLTransformer:
    """Pipeline stage adding ``z_<column>``; it is saved with the model, so scoring cannot forget it."""
    exprs = ", ".join((f"(CAST(`{c}` AS DOUBLE) - ({m!r}D)) / {sd!r}D" if sd else "0.0D") + f" AS `z_{c}`"
                      for c, (m, sd) in fitted.items())
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


def fit_logistic(train: DataFrame, columns: Sequence[str], label: str = LABEL, c: float = 1.0,
                 max_iter: int = 200) -> PipelineModel:
    """Balanced L2 logistic regression on standardised columns, scaling included in the pipeline.

    Spark averages the weighted loss, so strength C is ``regParam = 1 / (C * total weight)``; balanced weights add up
    to the number of rows.
    """
    fitted = standardise.fitted_numbers(standardise.fit_scale(train, columns))
    weighted = standardise.balanced_weights(train, label)
    n = train.count()
    return Pipeline(stages=[
        _scaler_stage(fitted),
        VectorAssembler(inputCols=[f"z_{x}" for x in columns], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", elasticNetParam=0.0,
                           regParam=1 / (c * n), standardization=False, maxIter=max_iter, tol=1e-9),
    ]).fit(weighted)


def fit_trees(train: DataFrame, columns: Sequence[str], label: str = LABEL, settings: Settings = DEFAULTS,
              seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees with positives weighted by the class ratio.

    Every level of every tree is a pass over the rows, so they are dealt evenly over all cores once, however few files they came in.
    """
    ratio = standardise.class_weights(train, label).select("positive_weight").scalar()
    weighted = train.withColumn("weight", F.when(F.col(label) == 1, ratio).otherwise(1.0)) \
        .repartition(train.sparkSession.sparkContext.defaultParallelism)
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="features"),
        GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=settings.trees,
                      maxDepth=settings.tree_depth, stepSize=settings.learning_rate, seed=seed,
                      checkpointInterval=10),
    ]).fit(weighted)


def score(df: DataFrame, model: PipelineModel, name: str = "p_attrition") -> DataFrame:
    """Add the probability of the positive class."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


def compare_models(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = LABEL,
                   settings: Settings = DEFAULTS, fitted: dict[str, PipelineModel] | None = None
                   ) -> tuple[PipelineModel, dict, DataFrame]:
    """Fit both classifiers (unless ``fitted`` has them), choose by PR-AUC on ``test``; return the winner, its metadata and the
    metrics table."""
    fitted = fitted or {"BoostedTrees": fit_trees(train, columns, label, settings),
              "LogisticRegression": fit_logistic(train, columns, label)}
    metrics = None
    for name, model in fitted.items():
        row = evaluation.curve_areas(score(test, model, "p").select("p", label), "p", label).select(
            F.lit(name).alias("model"), "pr_auc", "roc_auc")
        metrics = row if metrics is None else metrics.unionByName(row)
    found = {r["model"]: r for r in metrics.collect()}
    champion, gap = evaluation.select_champion(found["BoostedTrees"]["pr_auc"],
                                               found["LogisticRegression"]["pr_auc"], settings.champion_gap)
    rows = [(m, r["pr_auc"], r["roc_auc"]) for m, r in found.items()]
    table = train.sparkSession.createDataFrame(rows, "model string, pr_auc double, roc_auc double")
    meta = {"champion": champion, "pr_auc": round(found[champion]["pr_auc"], 4),
            "roc_auc": round(found[champion]["roc_auc"], 4), "threshold": settings.decision_threshold,
            "feature_count": len(columns), "train_size": train.count(), "test_size": test.count(),
            "pr_auc_gap": round(gap, 4), "scaled": champion == "LogisticRegression"}
    return fitted[champion], meta, table


def metadata_row(spark, meta: dict) -> DataFrame:
    schema = ("champion string, pr_auc double, roc_auc double, threshold double, feature_count int, train_size bigint, "
              "test_size bigint, pr_auc_gap double, scaled boolean")
    return spark.createDataFrame([meta], schema)


def logistic_gradient(train: DataFrame, model: PipelineModel, columns: Sequence[str], label: str = LABEL, c: float = 1.0) -> DataFrame:
    """``feature`` and ``gradient`` of the penalised mean loss of :func:`fit_logistic` at its coefficients, in one aggregate."""
    beta = model.stages[-1]
    scaled = model.stages[0].transform(standardise.balanced_weights(train, label))
    margin = sum((F.col(f"z_{x}") * F.lit(float(b)) for x, b in zip(columns, beta.coefficients)), F.lit(float(beta.intercept)))
    pull = F.col("weight") * (1 / (1 + F.exp(-margin)) - F.col(label))
    n = F.count("*")
    rows = [("intercept", F.sum("pull") / n)] + [(x, (F.sum(F.col("pull") * F.col(f"z_{x}")) + F.lit(float(b)) / c) / n)
                                                 for x, b in zip(columns, beta.coefficients)]
    one = scaled.withColumn("pull", pull).agg(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("gradient")) for k, v in rows]).alias("rows"))
    return one.select(F.inline("rows"))


# --------------------------------------------------------------- attributions
def linear_attributions(columns: Sequence[str], coefficients: Sequence[float],
                        means: Sequence[float | Column]) -> list[tuple[str, Column]]:
    """Contribution beta * (x - mean) of every column, in log-odds."""
    return [(c, (F.col(c).cast("double") - m) * F.lit(float(b))) for c, b, m in zip(columns, coefficients, means)]


def logistic_attributions(model: PipelineModel, columns: Sequence[str], train: DataFrame) -> list[tuple[str, Column]]:
    """Attributions of a pipeline from :func:`fit_logistic`, on the original columns."""
    fitted = standardise.fitted_numbers(standardise.fit_scale(train, columns))
    beta = model.stages[-1].coefficients.toArray()
    return linear_attributions(columns, [float(b) / fitted[c][1] if fitted[c][1] else 0.0 for c, b in zip(columns, beta)],
                               [fitted[c][0] for c in columns])


def global_importance(df: DataFrame, attributions: Sequence[tuple[str, Column]], k: int = 15) -> DataFrame:
    """Mean magnitude per feature, the ``k`` largest first."""
    named = df.select(*[c.alias(n) for n, c in attributions])
    rows = [F.struct(F.lit(n).alias("feature"), F.avg(F.abs(F.col(f"`{n}`"))).alias("mean_abs")) for n, _ in attributions]
    return named.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).orderBy(F.desc("mean_abs"), "feature").limit(k)


def _tree_paths(model: GBTClassificationModel, columns: Sequence[str], spark) -> list[tuple[float, list[tuple]]]:
    """Leaves of all trees: ``(weighted value, [(feature, low, high, cover share)])`` with one entry per feature.

    Read from the saved model, whose size is set by the tree settings and not by the data.
    """
    path = f"{shared_dir(spark).rstrip('/')}/retenta/{spark.sparkContext.applicationId}/trees-{model.uid}"
    model.write().overwrite().save(path)
    nodes: dict[int, dict[int, T.Row]] = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    leaves: list[tuple[float, list[tuple]]] = []

    def walk(tree, node, bounds, weight):
        if node["leftChild"] < 0:
            leaves.append((weight * node["prediction"], [(f, lo, hi, z) for f, (lo, hi, z) in bounds.items()]))
            return
        f = node["split"]["featureIndex"]
        cut = node["split"]["leftCategoriesOrThreshold"][0]
        lo, hi, z = bounds.get(f, (-math.inf, math.inf, 1.0))
        for child, box in ((tree[node["leftChild"]], (lo, min(hi, cut))), (tree[node["rightChild"]], (max(lo, cut), hi))):
            walk(tree, child, {**bounds, f: (*box, z * child["rawCount"] / node["rawCount"])}, weight)

    for t, tree in nodes.items():
        walk(tree, tree[0], {}, float(model.treeWeights[t]))
    return leaves


def _leaf_shapley(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the product game of one leaf: rows by features on its path.

    A feature inside the coalition contributes whether the row satisfies its interval; outside, its cover share.
    """
    rows, m = inside.shape
    out = np.empty((rows, m))
    weights = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    for i in range(m):
        poly = np.zeros((rows, m))
        poly[:, 0] = 1.0
        for j in range(m):
            if j != i:
                poly[:, 1:] = poly[:, 1:] * share[j] + poly[:, :-1] * inside[:, [j]]
                poly[:, 0] *= share[j]
        out[:, i] = (inside[:, i] - share[i]) * (poly @ weights)
    return out


_TABLES: dict[str, list[tuple]] = {}


def _leaf_tables(name: str, leaves: list[tuple[float, list[tuple]]]) -> list[tuple]:
    """Per leaf the features and intervals of its path, and per feature the Shapley values of each of the 2^m patterns of satisfied
    intervals; worked out once per worker."""
    if name not in _TABLES:
        _TABLES.clear()
        out = []
        for value, path in leaves:
            if path:
                m = len(path)
                patterns = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
                values = _leaf_shapley(patterns, np.array([z for *_, z in path])) * (2 * value)
                out.append(([(f, lo, hi) for f, lo, hi, _ in path], np.ascontiguousarray(values.T)))
        _TABLES[name] = out
    return _TABLES[name]


def _phi(x: np.ndarray, leaves: list[tuple]) -> np.ndarray:
    """Shapley values, features by rows, of ``x`` (features by rows), leaf by leaf of :func:`_leaf_tables`.

    A cut is compared with the rows once, however many leaves it borders; a leaf then costs a few passes over bytes to find the
    code of every row, and one look-up and one addition per feature of its path.
    """
    d, rows = x.shape
    phi, picked, above = np.zeros((d, rows)), np.empty(rows), {}

    def over(f: int, cut: float) -> np.ndarray:
        if (f, cut) not in above:
            above[f, cut] = x[f] > cut
        return above[f, cut]

    for path, values in leaves:
        code = np.zeros(rows, dtype=np.uint8 if len(path) <= 8 else np.int64)
        for k, (f, lo, hi) in enumerate(path):
            inside = over(f, lo) > over(f, hi)
            code |= inside.astype(code.dtype) << code.dtype.type(k)
        at = code.astype(np.intp)
        for (f, _, _), of_feature in zip(path, values, strict=True):
            phi[f] += np.take(of_feature, at, out=picked, mode="clip")
    return phi


def tree_attributions(df: DataFrame, model: PipelineModel, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, ``base`` and ``phi`` (one Shapley value per column, in log-odds) for every row.

    Rows stay in their partitions. For each leaf a row is a code of the intervals it satisfies, by which its values are looked
    up in a table; the tables are bounded by the tree settings.
    """
    spark = df.sparkSession
    leaves = _tree_paths(model.stages[-1], columns, spark)
    base = 2 * sum(v * math.prod(z for *_, z in path) for v, path in leaves)
    shared, name = spark.sparkContext.broadcast(leaves), f"{model.uid}-{uuid.uuid4().hex}"

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.ascontiguousarray(pdf[list(columns)].to_numpy(dtype=float).T)
            phi = _phi(x, _leaf_tables(name, shared.value)).T
            out = pdf[list(keep)].copy()
            out["base"] = base
            out["phi"] = list(np.ascontiguousarray(phi))
            yield out

    fields = [df.schema[k] for k in keep] + [T.StructField("base", T.DoubleType()),
                                             T.StructField("phi", T.ArrayType(T.DoubleType()))]
    return df.select(*keep, *[c for c in columns if c not in keep]).mapInPandas(explain, T.StructType(fields))


def attribution_columns(columns: Sequence[str], phi: str = "phi") -> list[tuple[str, Column]]:
    return [(c, F.col(phi)[i]) for i, c in enumerate(columns)]
