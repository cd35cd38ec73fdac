"""Saving and loading fitted models as pipelines and tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from retenta.operators.survival import CoxModel


def save_classifier(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_cox(model: CoxModel, spark: SparkSession, path: str) -> None:
    """Coefficients and baseline hazard as two tables."""
    fit = [(i, c, b, m, model.gradient_norm, model.log_likelihood, model.iterations)
           for i, (c, b, m) in enumerate(zip(model.covariates, model.coefficients, model.means))]
    spark.createDataFrame(fit, "position int, covariate string, coefficient double, mean double, gradient_norm double, "
                               "log_likelihood double, iterations int").coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")
    model.baseline.write.mode("overwrite").parquet(f"{path}/baseline")


def load_cox(spark: SparkSession, path: str) -> CoxModel:
    rows = spark.read.parquet(f"{path}/coefficients").orderBy("position").collect()
    return CoxModel([r["covariate"] for r in rows], [r["coefficient"] for r in rows], [r["mean"] for r in rows],
                    rows[0]["gradient_norm"], rows[0]["log_likelihood"], rows[0]["iterations"],
                    spark.read.parquet(f"{path}/baseline"))
