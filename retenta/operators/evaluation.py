"""Quality of scores against binary labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from retenta.operators.ordering import ROWS_PER_BUCKET, running_totals
from retenta.session import stage


def score_table(df: DataFrame, score: str, label: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Positives and negatives per distinct score, with running totals from the highest score down.

    The counts are read several times, so they are written once.
    """
    counts = stage(df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg")), "scores")
    return running_totals(counts, "score", ["pos", "neg"], descending=True, rows_per_bucket=rows_per_bucket)


def curve_areas(df: DataFrame, score: str = "p", label: str = "label",
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Trapezoid area under the precision-recall curve, which starts at recall 0 and precision 1, and under the ROC
    curve, where tied scores count half."""
    t = score_table(df, score, label, rows_per_bucket)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    precision = tp / (tp + fp)
    before = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    positives, negatives = F.sum("pos"), F.sum("neg")
    return t.agg(
        F.try_divide(F.sum(F.col("pos") * (precision + before) / 2), positives).alias("pr_auc"),
        F.try_divide(F.sum(F.col("neg") * (tp0 + F.col("pos") / 2)), positives * negatives).alias("roc_auc"),
        positives.alias("n_pos"), negatives.alias("n_neg"))


def threshold_report(df: DataFrame, score: str = "p", label: str = "label", threshold: float = 0.40) -> DataFrame:
    """Per class and averaged precision, recall, F1 and support, with accuracy, at ``p >= threshold``."""
    predicted, actual = F.col(score) >= threshold, F.col(label) == 1
    c = df.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
               F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.select(
        "*", ratio(tn, tn + fn).alias("p0"), ratio(tn, tn + fp).alias("r0"), (tn + fp).alias("n0"),
        ratio(tp, tp + fp).alias("p1"), ratio(tp, tp + fn).alias("r1"), (tp + fn).alias("n1"))
    f = {i: ratio(F.col(f"p{i}") * F.col(f"r{i}") * 2, F.col(f"p{i}") + F.col(f"r{i}")) for i in (0, 1)}
    c = c.select("*", f[0].alias("f0"), f[1].alias("f1"))
    n = F.col("n0") + F.col("n1")

    def line(name, values, support):
        return F.struct(F.lit(name).alias("class"), *[v.alias(k) for k, v in zip(("precision", "recall", "f1"), values)],
                        support.alias("support"))

    def mean(k, weighted):
        if weighted:
            return ratio(F.col(f"{k}0") * F.col("n0") + F.col(f"{k}1") * F.col("n1"), n)
        return (F.col(f"{k}0") + F.col(f"{k}1")) / 2

    accuracy = ratio(tp + tn, n)
    return c.select(F.inline(F.array(
        line("stayed", [F.col("p0"), F.col("r0"), F.col("f0")], F.col("n0")),
        line("left", [F.col("p1"), F.col("r1"), F.col("f1")], F.col("n1")),
        line("accuracy", [accuracy, accuracy, accuracy], n),
        line("macro avg", [mean(k, False) for k in "prf"], n),
        line("weighted avg", [mean(k, True) for k in "prf"], n))))


def select_champion(trees_pr_auc: float, linear_pr_auc: float, gap: float = 0.02) -> tuple[str, float]:
    """The boosted trees win only when they lead by strictly more than ``gap``."""
    lead = trees_pr_auc - linear_pr_auc
    return ("BoostedTrees" if lead > gap else "LogisticRegression"), lead


def champion_table(metrics: DataFrame, gap: float = 0.02) -> DataFrame:
    """Choice from a table with rows ``(model, pr_auc)`` for the two models."""
    def of(model):
        return F.max(F.when(F.col("model") == model, F.col("pr_auc")))
    lead = of("BoostedTrees") - of("LogisticRegression")
    return metrics.agg(F.when(lead > gap, "BoostedTrees").otherwise("LogisticRegression").alias("champion"),
                       lead.alias("pr_auc_gap"))
