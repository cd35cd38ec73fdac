import dataclasses
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.config import DEFAULTS
from retenta.operators import collinearity, evaluation, models, standardise
from retenta.sources.models import load_classifier, save_classifier


def test_areas(spark):
    df = spark.createDataFrame([(.9, 0), (.9, 1), (.7, 1), (.2, 0)], "p double, label int")
    r = evaluation.curve_areas(df).first()
    # Points (0,1), (.5,.5), (1,2/3), (1,.5).
    assert r["pr_auc"] == pytest.approx(.5 * .75 + .5 * (.5 + 2 / 3) / 2)
    assert r["roc_auc"] == pytest.approx(.625)
    perfect = spark.createDataFrame([(.9, 1)] * 10 + [(.1, 0)] * 10, "p double, label int")
    r = evaluation.curve_areas(perfect, rows_per_bucket=1).first()
    assert r["pr_auc"] == 1.0 and r["roc_auc"] == 1.0


def test_areas_do_not_depend_on_buckets(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 2), int(rng.random() < .3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "p double, label int")
    a, b = evaluation.curve_areas(df).first(), evaluation.curve_areas(df.repartition(7), rows_per_bucket=9).first()
    assert a["pr_auc"] == pytest.approx(b["pr_auc"]) and a["roc_auc"] == pytest.approx(b["roc_auc"])


@pytest.mark.parametrize("a,b,gap,want", [(.90, .85, .02, "BoostedTrees"), (.86, .85, .02, "LogisticRegression"),
                                          (.75, .5, .25, "LogisticRegression"), (.70, .85, .02, "LogisticRegression")])
def test_champion(a, b, gap, want):
    assert evaluation.select_champion(a, b, gap)[0] == want


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in standardise.scale(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_pairs_and_drops(spark):
    pairs = spark.createDataFrame([("a", "b", .85), ("a", "c", .1), ("b", "c", -.9)], "feature_1 string, feature_2 string, r double")
    got = [(r["feature_1"], r["feature_2"], r["r"], r["abs_r"]) for r in collinearity.high_pairs(pairs).collect()]
    assert got == [("b", "c", -.9, .9), ("a", "b", .85, .85)]
    vif = spark.createDataFrame([("a", 15.0), ("b", 3.0)], "feature string, vif double")

    def pick(r):
        p = spark.createDataFrame([("a", "b", r)], "feature_1 string, feature_2 string, abs_r double")
        return [x[0] for x in collinearity.correlated_drops(p, vif).collect()]
    assert pick(.9) == ["a"] and pick(.75) == []
    tie = spark.createDataFrame([("x", "y", .9)], "feature_1 string, feature_2 string, abs_r double")
    assert [r[0] for r in collinearity.correlated_drops(tie, vif).collect()] == ["y"]
    flags = spark.createDataFrame([("v", True, False, False), ("vl", True, True, False), ("vc", True, False, True),
                                   ("interact_x", True, True, True)], "feature string, by_vif boolean, by_l1 boolean, by_corr boolean")
    assert sorted(r[0] for r in collinearity.recommend_drops(flags).collect()) == ["vc", "vl"]


def test_inflation(spark):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=400), rng.normal(size=400)
    y = x + .5 * z
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y)], "x double, y double")
    r = np.corrcoef(x, y)[0, 1]
    got = {v["feature"]: v["vif"] for v in collinearity.variance_inflation(df, ["x", "y"]).collect()}
    assert got["x"] == got["y"] == pytest.approx(1 / (1 - r * r), abs=.006)
    more = df.withColumn("twin", F.col("x") * 2).withColumn("flat", F.lit(1.0))
    got = {v["feature"]: v["vif"] for v in collinearity.variance_inflation(more, ["x", "y", "twin", "flat"]).collect()}
    assert math.isinf(got["x"]) and math.isinf(got["twin"]) and got["flat"] is None and not math.isinf(got["y"])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))).astype(int)
    rows = [(i, f"E{i}", float(a), float(b), float(c), int(v)) for i, ((a, b, c), v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "order_col bigint, employee_id string, a double, b double, c double, attrition_flag int").cache()


def test_folds_match_round_robin_sizes(spark, table):
    folds = collinearity.stratified_folds(table, "attrition_flag", "order_col").collect()
    y = sorted(r["attrition_flag"] for r in folds)
    for f in range(5):
        for v in (0, 1):
            assert sum(r["fold"] == f and r["attrition_flag"] == v for r in folds) == y[f::5].count(v)
    for v in (0, 1):
        seq = [r["fold"] for r in sorted(folds, key=lambda r: r["order_col"]) if r["attrition_flag"] == v]
        assert seq == sorted(seq)


def test_logistic_optimum_and_round_trip(spark, table, tmp_path):
    cols = ["a", "b", "c"]
    model = models.fit_logistic(table, cols)
    scored = models.score(table, model).toPandas()
    # C * sum of weighted losses + half the squared norm is stationary.
    x = scored[cols].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    y, p = scored["attrition_flag"].to_numpy(), scored["p_attrition"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta = model.stages[-1].coefficients.toArray()
    assert np.abs(z.T @ (w * (p - y)) + beta).max() < 1e-3
    # Additivity of the linear attributions.
    phi = models.logistic_attributions(model, cols, table)
    total = table.select("employee_id", sum((c for _, c in phi), F.lit(0.0)).alias("s")).toPandas().merge(scored, on="employee_id")
    margin = np.log(total["p_attrition"] / (1 - total["p_attrition"]))
    assert np.allclose(total["s"] + model.stages[-1].intercept, margin, atol=1e-8)
    save_classifier(model, str(tmp_path / "m"))
    again = models.score(table, load_classifier(str(tmp_path / "m"))).toPandas()
    assert np.allclose(again["p_attrition"], p)


def test_tree_attributions_are_shapley_values(spark, table):
    cols = ["a", "b", "c"]
    light = dataclasses.replace(DEFAULTS, trees=4, tree_depth=3, learning_rate=.3)
    model = models.fit_trees(table, cols, settings=light)
    got = models.tree_attributions(table, model, cols, ["employee_id"]).toPandas()
    p = models.score(table, model).select("employee_id", "p_attrition").toPandas()
    both = got.merge(p, on="employee_id")
    margin = np.log(both["p_attrition"] / (1 - both["p_attrition"]))
    assert np.allclose(both["phi"].map(sum) + both["base"], margin, atol=1e-6)
    # Against the definition: average over feature orders of the change in the cover-weighted expectation.
    from itertools import permutations
    leaves = models._tree_paths(model.stages[-1], cols, spark)
    x = table.filter("employee_id = 'E7'").select(*cols).first()

    def value(known):
        return sum(2 * v * math.prod((1.0 if lo < x[f] <= hi else 0.0) if f in known else z for f, lo, hi, z in path)
                   for v, path in leaves)
    want = np.zeros(3)
    for order in permutations(range(3)):
        for k, f in enumerate(order):
            want[f] += (value(set(order[:k + 1])) - value(set(order[:k]))) / 6
    assert np.allclose(got[got["employee_id"] == "E7"]["phi"].iloc[0], want, atol=1e-9)


def test_l1_selection(spark, table):
    out = {r["feature"]: r for r in collinearity.l1_selection(table, ["a", "b", "c"], "attrition_flag", "order_col", strengths=3,
                                                              max_iter=30).collect()}
    assert set(out) == {"a", "b", "c"} and all(r["zeroed"] == (r["coefficient"] == 0) for r in out.values())
    assert out["a"]["coefficient"] > 0 > out["b"]["coefficient"]


def test_l1_fits_share_their_passes(spark, table, monkeypatch):
    """The search goes over the rows a few times, not once per fit and step, and ends at the optimum that Spark's own solver finds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    passes, plain = [], collinearity._pass

    def counted(data, p, betas, held, size, sums):
        passes.append(len(betas))
        return plain(data, p, betas, held, size, sums)

    monkeypatch.setattr(collinearity, "_pass", counted)
    cols = ["a", "b", "c"]
    rows = table.withColumn("flat", F.lit(2.0))
    out = {r["feature"]: r for r in collinearity.l1_selection(rows, [*cols, "flat"], "attrition_flag", "order_col").collect()}
    assert passes[0] == 50 and len(passes) < 40
    assert out["flat"]["zeroed"] and all(r["gap"] < 1e-8 and r["converged"] for r in out.values())
    weighted = standardise.balanced_weights(standardise.scale(table, cols), "attrition_flag")
    vectors = VectorAssembler(inputCols=cols, outputCol="v").transform(weighted)
    fit = LogisticRegression(featuresCol="v", labelCol="attrition_flag", weightCol="weight", elasticNetParam=1.0, standardization=False,
                             regParam=1 / (out["a"]["best_c"] * 400), maxIter=500, tol=1e-12).fit(vectors)
    assert [out[c]["coefficient"] for c in cols] == pytest.approx(list(fit.coefficients), abs=1e-5)


def test_l1_moves_end_at_the_minimum():
    """Of columns that nearly or wholly add up to one another, too: the slope of the quadratic lies inside the penalty after one move."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    x = np.column_stack([np.ones(400), x, x[:, 0] + x[:, 1] + 1e-4 * rng.normal(size=400), x[:, 2] + x[:, 3], x[:, 4], np.zeros(400)])
    curve = x.T @ x / 400
    strength = np.array([1e-1, 1e-3, 1e-7, 1e-7])
    slopes = np.array([x.T @ rng.normal(size=400) / 400 for _ in strength])
    betas = np.vstack([np.zeros((3, x.shape[1])), rng.normal(size=x.shape[1])])
    ends = betas + collinearity._newton_move(betas, slopes, np.array([curve] * 4), strength)
    gaps = collinearity._outside(ends, slopes + (ends - betas) @ curve, strength)
    assert gaps.max() < 1e-9 and (ends[:3, -1] == 0).all() and (ends[0, 1:] == 0).any()


def test_l1_pass_totals(spark, monkeypatch):
    """Loss, slopes and curvatures are those of the definition, for far margins too, and reach the driver as one table."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 3)), (rng.random(300) < 0.4).astype(float)
    w, fold = rng.uniform(0.5, 2.0, 300), np.arange(300) % 2.0
    data = spark.createDataFrame(np.column_stack([x, y, w, fold]).tolist(), "x0 double, x1 double, x2 double, y double, w double, fold double")
    betas, held = np.array([[0.1, 1.0, -2.0, 0.5], [0.0, 900.0, 0.0, 0.0]]), np.array([0, -1])

    def refused(frame):
        raise AssertionError("totals were collected row by row")

    monkeypatch.setattr(type(data), "collect", refused)
    loss, slopes, curves = collinearity._slopes(data, 3, betas, held)
    ones = np.column_stack([np.ones(300), x])
    for k, (beta, out) in enumerate(zip(betas, held)):
        margin, weight = ones @ beta, w * (fold != out)
        q, weight = 1 / (1 + np.exp(-margin.clip(-700, 700))), weight / weight.sum()
        assert loss[k] == pytest.approx(weight @ (np.logaddexp(0, margin) - y * margin), rel=1e-12)
        assert np.allclose(slopes[k], ones.T @ (weight * (q - y)), rtol=1e-10, atol=1e-13)
        assert np.allclose(curves[k], ones.T @ (ones * (weight * q * (1 - q))[:, None]), rtol=1e-10, atol=1e-13)


def test_l1_search_scores_as_a_cross_validator(spark, table):
    """The best C is that of Spark's cross-validation over the same folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    cols = ["a", "b", "c"]
    got = collinearity.l1_selection(table, cols, "attrition_flag", "order_col", strengths=4, folds=3).first()["best_c"]
    data = collinearity.stratified_folds(standardise.balanced_weights(standardise.scale(table, cols), "attrition_flag"), "attrition_flag",
                                         "order_col", 3)
    fit = LogisticRegression(featuresCol="v", labelCol="attrition_flag", weightCol="weight", elasticNetParam=1.0, standardization=False,
                             maxIter=300, tol=1e-10)
    grid = [float(c) for c in np.logspace(-4, 4, 4)]
    maps = ParamGridBuilder().addGrid(fit.regParam, [1 / (c * 400 * 2 / 3) for c in grid]).build()
    search = CrossValidator(estimator=fit, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(
        labelCol="attrition_flag", metricName="accuracy"), foldCol="fold", numFolds=3)
    found = search.fit(VectorAssembler(inputCols=cols, outputCol="v").transform(data)).avgMetrics
    assert got == grid[int(np.argmax(found))]


def test_trees_use_all_cores(spark, table, monkeypatch):
    """Rows that came in one file are dealt over all cores before the passes of the training."""
    seen = []

    class Watched(models.Pipeline):
        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            return super().fit(rows)

    monkeypatch.setattr(models, "Pipeline", Watched)
    light = dataclasses.replace(DEFAULTS, trees=2, tree_depth=2)
    models.fit_trees(table.coalesce(1), ["a", "b", "c"], settings=light)
    assert seen == [spark.sparkContext.defaultParallelism]


def test_full_report(spark):
    vif = spark.createDataFrame([("a", 20.0), ("b", 1.0)], "feature string, vif double")
    l1 = spark.createDataFrame([("a", True), ("b", True)], "feature string, zeroed boolean")
    pairs = spark.createDataFrame([], "feature_1 string, feature_2 string, abs_r double")
    got = {r["feature"]: r["drop"] for r in collinearity.drop_report(vif, l1, pairs, ["a", "b"]).collect()}
    assert got == {"a": True, "b": False}


def test_leaf_look_up_by_cuts():
    """Shared, missing and infinite cuts, rows on a cut and NaN; a cut is compared with the rows once for all leaves."""
    inf = math.inf
    leaves = [(1.5, [(0, -inf, 1.0, .4), (2, 0.0, 2.0, .3)]), (-.5, [(0, 1.0, inf, .6)]), (2.0, [(1, 0.5, 1.0, .2), (0, 1.0, 3.0, .5), (2, -inf, 2.0, .9)]), (9.0, [])]
    x = np.array([[1.0, 0.7, 2.0], [1.5, 0.5, 0.0], [4.0, 1.0, -1.0], [np.nan, np.nan, 1.0], [2.0, 0.8, 5.0]])
    tables = models._leaf_tables("test", leaves)
    want = np.zeros(x.shape)
    for value, path in leaves:
        for r, row in enumerate(x):
            if path:
                inside = np.array([[float(lo < row[f] <= hi) for f, lo, hi, _ in path]])
                want[r, [f for f, *_ in path]] += 2 * value * models._leaf_shapley(inside, np.array([z for *_, z in path]))[0]
    compared = []

    class Rows(np.ndarray):
        def __gt__(self, other):
            compared.append(other)
            return np.asarray(self) > other

    got = models._phi(np.ascontiguousarray(x.T).view(Rows), tables)
    assert np.allclose(got.T, want, atol=1e-12) and len(compared) == 9


def test_round_trip_reads_the_subjects_once(spark, data, monkeypatch, tmp_path):
    """The hazard fit takes the given tenure from the staged features; subjects without one take no part in it."""
    from retenta.plans import catalog, features as plan
    from retenta.plans.catalog import models as queries
    from retenta.plans.subjects import subjects
    for name in ("customer", "lineitem", "events", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{data}/{name}.parquet")
    orders = spark.read.parquet(f"{data}/orders.parquet").filter("o_custkey <> 7")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    data = str(tmp_path)
    seen, fits = [], []
    plain_fit = queries.survival.cox_fit
    for module in (plan, queries):
        monkeypatch.setattr(module, "subjects", lambda s, d, *a: seen.append(a) or subjects(s, d, *a))
    monkeypatch.setattr(queries.survival, "cox_fit", lambda df, *a: fits.append((df, a[1])) or plain_fit(df, *a))
    monkeypatch.setattr(catalog, "_FITTED", {})
    assert catalog.QUERIES["S10_model_round_trip"](spark, data).count() == spark.read.parquet(f"{data}/customer.parquet").count()
    assert len(seen) == 1
    (df, duration), = fits
    got = {r[0]: r[1] for r in df.select("employee_id", duration).collect()}
    assert got == {r[0]: r[1] for r in subjects(spark, data, ["employee_id", "tenure_months"]).collect()}
    assert [k for k, v in got.items() if v is None] == ["C7"]
