"""Classifier, attribution and scoring-model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from retenta.functions.arrays import top_drivers
from retenta.operators import collinearity, models, survival
from retenta.operators.ordering import ordered_split
from retenta.plans import pipeline
from retenta.plans.catalog import on_subjects, once, query, rounded
from retenta.plans.features import imputed_features
from retenta.plans.subjects import CIRCLE_REFERENCE, CIRCLES, DEPARTMENT_REFERENCE, DEPARTMENTS, subjects
from retenta.session import shared_dir, stage
from retenta.sources.models import load_classifier, load_cox, save_classifier, save_cox

#: Columns of the classifiers: the feature contract without what gives the label away.
MODEL_COLUMNS = (
    "trend_login", "trend_performance", "trend_training", "volatility_leave", "volatility_performance", "org_peer_attrition",
    "org_manager_attrition", "org_team_shrink", "comp_compa_ratio", "comp_hike_vs_median", "career_promotion_velocity",
    "is_new_joiner", "interact_underpaid_declining", "band", "perf_rating_current", "login_freq_30d", "training_completions_90d",
    "leave_days_30d", "gender_encoded", *[f"dept_{v}" for v in DEPARTMENTS if v != DEPARTMENT_REFERENCE],
    *[f"circle_{v}" for v in CIRCLES if v != CIRCLE_REFERENCE])


def _features(spark, d):
    def make():
        df, contract = imputed_features(spark, d, ["tenure_months"])
        columns = [c for c in contract if c not in pipeline.LEAKING and c != "tenure_months"]
        rows = stage(df.select("order_col", "employee_id", "attrition_flag", "given_tenure_months", *columns), "features")
        return ordered_split(rows, "order_col"), columns                # the split compares with one number: not worth a second copy

    split, columns = once(spark, d, "features", make)
    return split.filter("is_train"), split.filter("NOT is_train"), columns


def _trees(spark, d):
    train, _, columns = _features(spark, d)
    return once(spark, d, "trees", lambda: models.fit_trees(train, columns))


def _logistic(spark, d):
    train, _, columns = _features(spark, d)
    return once(spark, d, "logistic", lambda: models.fit_logistic(train, columns))


@query("M4_boosted_trees")
def _(spark, d):
    train, test, columns = _features(spark, d)
    return models.score(train.unionByName(test), _trees(spark, d)).select("employee_id", "p_attrition")


@query("M5_logistic_regression")
def _(spark, d):
    _, _, columns = _features(spark, d)
    beta = _logistic(spark, d).stages[-1]
    rows = [("intercept", float(beta.intercept))] + [(c, float(b)) for c, b in zip(columns, beta.coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double")


# The slope of the penalised loss, worked out from the rows and the coefficients and not by the solver, is zero at the fit.
@query("M5_logistic_gradient", on_subjects("SELECT feature, CAST(0 AS DOUBLE) AS gradient FROM (VALUES "
                                           + ", ".join(f"('{c}')" for c in ["intercept", *MODEL_COLUMNS]) + ") AS t(feature)"))
def _(spark, d):
    train, _, columns = _features(spark, d)
    return models.logistic_gradient(train, _logistic(spark, d), columns).select("feature", (F.round("gradient", 4) + 0.0).alias("gradient"))


@query("M24_run_metadata")
def _(spark, d):
    train, test, columns = _features(spark, d)
    _, meta, _ = models.compare_models(train, test, columns, fitted={"BoostedTrees": _trees(spark, d), "LogisticRegression": _logistic(spark, d)})
    return models.metadata_row(spark, meta)


@query("M25_score_all")
def _(spark, d):
    train, test, _ = _features(spark, d)
    return models.score(train.unionByName(test), _logistic(spark, d)).select("employee_id", "p_attrition")


@query("S10_model_round_trip")
def _(spark, d):
    """All subjects scored by the classifier and the hazard model after both were saved and loaded."""
    train, test, columns = _features(spark, d)
    path = f"{shared_dir(spark).rstrip('/')}/retenta/{spark.sparkContext.applicationId}/models-{uuid.uuid4().hex}"
    save_classifier(_logistic(spark, d), f"{path}/classifier")
    rows = train.unionByName(test)
    covariates = ["comp_compa_ratio", "org_manager_attrition", "trend_performance"]
    save_cox(survival.cox_fit(rows, covariates, "given_tenure_months", "attrition_flag"), spark, f"{path}/cox")
    scored = models.score(rows, load_classifier(f"{path}/classifier"))
    return survival.median_survival(scored, load_cox(spark, f"{path}/cox")).select(
        "employee_id", "p_attrition", "median_survival_months", "survival_is_infinite")


def _selected(spark, d):
    train, _, columns = _features(spark, d)
    return once(spark, d, "l1", lambda: collinearity.l1_selection(train, columns, "attrition_flag", "order_col", parallelism=8))


@query("M23_l1_selection")
def _(spark, d):
    return _selected(spark, d)


# At the optimum no slope lies outside what the penalty allows, and the search has ended by itself.
@query("M23_l1_subgradient", "SELECT feature, CAST(0 AS DOUBLE) AS gap, true AS converged FROM (VALUES "
       + ", ".join(f"('{c}')" for c in MODEL_COLUMNS) + ") AS t(feature)")
def _(spark, d):
    return _selected(spark, d).select("feature", (F.round("gap", 4) + 0.0).alias("gap"), "converged")


# --------------------------------------------------------------- attributions with given coefficients
_COLS = ("compa_ratio", "perf_rating_current", "manager_attrition_rate_6m", "hike_vs_band_median")
_BETA = (-1.5, 0.3, 2.9, -0.2)
_PHI = "phi AS (SELECT order_col, " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM subjects)) * {b} AS {c}" for c, b in zip(_COLS, _BETA)) + \
    " FROM subjects WHERE compa_ratio IS NOT NULL AND manager_attrition_rate_6m IS NOT NULL)"
_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT order_col, {i} AS pos, '{c}' AS feature, {c} AS shap FROM phi" for i, c in enumerate(_COLS)) + ")"
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY order_col ORDER BY abs(shap) DESC, pos) AS rank FROM long)"""


def _attributed(spark, d):
    df = subjects(spark, d, ["order_col", *_COLS])
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in _COLS])).scalar()
    phi = models.linear_attributions(_COLS, _BETA, [F.col("__means")[c] for c in _COLS])
    return df.withColumn("__means", means).dropna(subset=["compa_ratio", "manager_attrition_rate_6m"]), phi


@query("M10_linear_attributions", on_subjects("SELECT order_col, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _COLS) + " FROM phi", _PHI))
def _(spark, d):
    df, phi = _attributed(spark, d)
    return rounded(df.select("order_col", *[c.alias(n) for n, c in phi]))


@query("M12_global_importance", on_subjects("SELECT feature, round(avg(abs(shap)), 6) AS mean_abs FROM long GROUP BY 1",
                                            _PHI, _LONG))
def _(spark, d):
    df, phi = _attributed(spark, d)
    return rounded(models.global_importance(df, phi))


@query("K6_top_drivers", on_subjects("""
SELECT order_col, CAST(rank AS INTEGER) AS rank, feature, round_even(shap, 4) AS shap FROM ranked WHERE rank <= 3""",
                                     _PHI, _LONG, _RANKED))
def _(spark, d):
    df, phi = _attributed(spark, d)
    named = df.select("order_col", *[c.alias(n) for n, c in phi])
    top = named.select("order_col", F.posexplode(top_drivers([(n, F.col(n)) for n, _ in phi])).alias("rank", "x"))
    return top.select("order_col", (F.col("rank") + 1).alias("rank"), "x.feature", "x.shap")


@query("M11_tree_attributions")
def _(spark, d):
    train, test, columns = _features(spark, d)
    phi = models.tree_attributions(train.unionByName(test), _trees(spark, d), columns, ["employee_id"])
    return phi.select("employee_id", "base", *[c.alias(n) for n, c in models.attribution_columns(columns)])


# Base and contributions add up to the log-odds of the score.
@query("M11_additivity", on_subjects("SELECT employee_id, CAST(0 AS DOUBLE) AS gap FROM subjects"))
def _(spark, d):
    train, test, columns = _features(spark, d)
    scored = models.score(train.unionByName(test), _trees(spark, d))
    both = models.tree_attributions(scored, _trees(spark, d), columns, ["employee_id", "p_attrition"])
    total = F.aggregate("phi", F.col("base"), lambda s, x: s + x)
    odds = F.log(F.col("p_attrition") / (1 - F.col("p_attrition")))
    return both.select("employee_id", (F.round(total - odds, 4) + 0.0).alias("gap"))


@query("E3_model_scored_table")
def _(spark, d):
    df, contract = imputed_features(spark, d)
    base = stage(df)
    trained = pipeline.training_job(base, contract, fitted={"BoostedTrees": _trees(spark, d), "LogisticRegression": _logistic(spark, d)})
    from retenta import schema
    return pipeline.scoring_job(base, subjects(spark, d, ["employee_id", *schema.PROFILE_COLUMNS]), trained)
