"""The batch jobs: clean an extract, build and check features, fit models, score and explain every subject.

Each step takes and returns tables; what several later steps read is staged, so a job can restart from any of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from retenta import schema
from retenta.config import DEFAULTS, Settings
from retenta.functions.arrays import top_drivers
from retenta.operators import explain, ingest, models, retrieval, scoring, survival
from retenta.operators.ordering import ordered_split
from retenta.session import stage

# The bound label is the recency of the last order, so features derived from last-order dates would leak it.
LEAKING = ("comp_months_no_hike", "career_tenure_at_band", "recency_manager_change",
           "interact_post_appraisal_dissatisfied", "interact_new_mgr_peer_left", "interact_high_performer_no_promo")


@dataclass
class Cleaned:
    table: DataFrame
    resolution: DataFrame
    audit: DataFrame


def ingest_job(raw: DataFrame, as_of: Column, min_group: int = 5) -> Cleaned:
    """Names, mapping, dates, null tokens, types, imputation, caps and small groups, in that order.

    Dates are derived before anything is dropped, and values are parsed before they are imputed.
    """
    named = ingest.clean_column_names(raw)
    mapped, resolution = ingest.map_columns(named, keep=("order_col",))
    text_table = stage(mapped, "mapped")
    dated = ingest.derive_months(ingest.normalise_nulls(text_table), as_of)
    typed = stage(ingest.rescale_percent(ingest.coerce_types(dated)) if "compa_ratio" in dated.columns
                  else ingest.coerce_types(dated), "typed")
    filled = stage(ingest.impute_mode(ingest.impute_median(ingest.impute_constant(typed))), "filled")
    capped = ingest.winsorise(filled)
    if {"peer_attrition_count_90d", "department", "circle"} <= set(capped.columns):
        capped = ingest.zero_small_groups(capped, min_size=min_group)
    canonical = [c for c in schema.CANONICAL_NAMES if c in capped.columns]
    extra = ["order_col"] if "order_col" in capped.columns else []
    ints = {"band", "attrition_flag"}
    table = capped.select(*[F.col(c).cast("int").alias(c) if c in ints else F.col(c) for c in canonical],
                          *[F.col(c).cast("bigint").alias(c) for c in extra])
    audit = ingest.audit_trail(text_table.select(*[c for c in schema.CANONICAL_NAMES if c in text_table.columns]), resolution)
    return Cleaned(table, resolution, audit)


@dataclass
class Trained:
    model: PipelineModel
    columns: list[str]
    metadata: dict
    metrics: DataFrame
    cox: survival.CoxModel
    train: DataFrame


def training_job(table: DataFrame, contract: list[str], order_col: str = "order_col",
                 covariates: tuple[str, ...] = schema.COX_COVARIATES, duration: str = "tenure_months",
                 settings: Settings = DEFAULTS, fitted: dict[str, PipelineModel] | None = None) -> Trained:
    """Ordered split, both classifiers (or those ``fitted`` before), the choice between them, and the hazard model on the training
    part."""
    split = ordered_split(table, order_col, settings.train_fraction)
    train, test = split.filter("is_train"), split.filter("NOT is_train")
    columns = [c for c in contract if c not in LEAKING and c != duration]
    model, meta, metrics = models.compare_models(train, test, columns, settings=settings, fitted=fitted)
    cox = survival.cox_fit(train, covariates, duration, models.LABEL, settings.cox_ridge, allow_duration=True)
    return Trained(model, columns, meta, metrics, cox, train)


def scoring_job(table: DataFrame, profile: DataFrame, trained: Trained, settings: Settings = DEFAULTS) -> DataFrame:
    """Probability, median survival, value, tier and top drivers of every subject, with its profile."""
    scored = models.score(table, trained.model)
    timed = survival.median_survival(scored, trained.cox)
    if trained.metadata["scaled"]:
        phi = models.logistic_attributions(trained.model, trained.columns, trained.train)
        explained = timed.withColumn("top_shap_drivers", top_drivers(phi))
    else:
        keep = ["employee_id", "p_attrition", "median_survival_months", "survival_is_infinite"]
        explained = models.tree_attributions(timed, trained.model, trained.columns, keep)
        explained = explained.withColumn("top_shap_drivers", top_drivers(models.attribution_columns(trained.columns)))
    return scoring.scored_table(scoring.add_value_and_tier(explained, settings), profile)


def explain_job(scored: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Labels, passages, request text and route of every scored subject, as one plan over all of them.

    ``chunks`` has ``(id, source, content)``; the passages of each driver's search text are found in it.
    """
    wanted = scored.select(F.explode(retrieval.select_queries(F.col("top_shap_drivers"))).alias("d")).select("d.query")
    hits = retrieval.search(wanted, chunks.withColumnRenamed("id", "chunk_id"), k=settings.results_per_query)
    with_context = retrieval.with_policy_context(scored, hits, chunks)
    labelled = explain.with_driver_labels(with_context)
    months = F.col("median_survival_months")
    survival_text = F.when(months < float("inf"), months) if "median_survival_months" in scored.columns else None
    asked = labelled.withColumn("request", explain.request_text(F.col("p_attrition"), F.col("shap_drivers"),
                                                                F.col("policy_context"), survival_text))
    return explain.with_route(asked)
