"""Standardisation, evaluation and collinearity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from retenta.operators import collinearity, evaluation, standardise
from retenta.operators.ordering import ordered_split
from retenta.plans.catalog import on_subjects, query, rounded
from retenta.plans.features import imputed_features
from retenta.plans.scored import SCORED_SQL, rule_scored
from retenta.plans.subjects import subjects, table
from retenta.session import stage

_SCALE = ("tenure_months", "compa_ratio", "perf_rating_current", "hike_vs_band_median", "manager_attrition_rate_6m")


@query("M2_standardise", on_subjects("""
SELECT order_col, """ + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM tr)) / (SELECT stddev_pop({c}) FROM tr), 6) AS {c}" for c in _SCALE) + " FROM subjects", """
tr AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY order_col) AS rn FROM subjects)
  WHERE rn <= CAST(floor((SELECT count(*) FROM subjects) * 0.8) AS BIGINT))"""))
def _(spark, d):
    df = ordered_split(stage(subjects(spark, d, ["order_col", *_SCALE])), "order_col")
    return rounded(standardise.scale(df, _SCALE, df.filter("is_train")).select("order_col", *_SCALE))


@query("M3_class_weights", on_subjects("""
SELECT round(n0 / CAST(n1 AS DOUBLE), 6) AS positive_weight, round(n / (2.0 * n1), 6) AS weight_1, round(n / (2.0 * n0), 6) AS weight_0
FROM (SELECT count(*) AS n, sum(attrition_flag) AS n1, sum(1 - attrition_flag) AS n0 FROM subjects)"""))
def _(spark, d):
    return rounded(standardise.class_weights(subjects(spark, d, ["attrition_flag"])))


_CURVES = """
agg AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM labelled GROUP BY p),
cum AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM agg),
pts AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS prec, tp - pos AS tp0, fp - neg AS fp0 FROM cum),
areas AS (SELECT sum(pos * (prec + CASE WHEN tp0 + fp0 > 0 THEN CAST(tp0 AS DOUBLE) / (tp0 + fp0) ELSE 1 END) / 2) / sum(pos) AS pr_auc,
  sum(CAST(neg AS DOUBLE) * (tp0 + CAST(pos AS DOUBLE) / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc FROM pts)"""
_LABELLED = "labelled AS (SELECT p_attrition AS p, attrition_flag AS y FROM scored)"


def _labelled(spark, d):
    s = rule_scored(spark, d)
    label = subjects(spark, d, ["employee_id", "attrition_flag"])
    return s.select("employee_id", F.col("p_attrition").alias("p")).join(label, "employee_id").select(
        "p", F.col("attrition_flag").alias("label"))


@query("M6_pr_auc", on_subjects("SELECT round(pr_auc, 6) AS pr_auc FROM areas", SCORED_SQL, _LABELLED, _CURVES))
def _(spark, d):
    return rounded(evaluation.curve_areas(stage(_labelled(spark, d)))).select("pr_auc")


@query("M7_roc_auc", on_subjects("SELECT round(roc_auc, 6) AS roc_auc FROM areas", SCORED_SQL, _LABELLED, _CURVES))
def _(spark, d):
    return rounded(evaluation.curve_areas(stage(_labelled(spark, d)))).select("roc_auc")


@query("M6_line_curves", "WITH labelled AS (SELECT l_extendedprice AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),"
       + _CURVES.lstrip() + " SELECT round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM areas")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return rounded(evaluation.curve_areas(lines)).select("pr_auc", "roc_auc")


@query("M8_threshold_report", on_subjects("""
, c AS (SELECT CAST(count(CASE WHEN p >= 0.4 AND y = 1 THEN 1 END) AS DOUBLE) AS tp, count(CASE WHEN p >= 0.4 AND y = 0 THEN 1 END) AS fp,
  count(CASE WHEN p < 0.4 AND y = 1 THEN 1 END) AS fn, CAST(count(CASE WHEN p < 0.4 AND y = 0 THEN 1 END) AS DOUBLE) AS tn FROM labelled),
m AS (SELECT coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0, tn + fp AS n0,
  coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, tp + fn AS n1,
  (tp + tn) / (tp + tn + fp + fn) AS acc FROM c),
f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, n0 + n1 AS n FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
SELECT 'stayed' AS class, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM f
UNION ALL SELECT 'left', p1, r1, f1, n1 FROM f UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n, (f0 * n0 + f1 * n1) / n, n FROM f)""".lstrip(),
                                          SCORED_SQL, _LABELLED).replace("\n, c AS", ",\nc AS"))
def _(spark, d):
    return rounded(evaluation.threshold_report(_labelled(spark, d)))


@query("M9_champion", on_subjects("""
, a2 AS (SELECT pos, neg, p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM (
  SELECT round_even(compa_ratio, 2) AS p, sum(attrition_flag) AS pos, sum(1 - attrition_flag) AS neg FROM scored GROUP BY 1)),
b AS (SELECT sum(pos * (CAST(tp AS DOUBLE) / (tp + fp) + CASE WHEN tp + fp > pos + neg
  THEN CAST(tp - pos AS DOUBLE) / (tp + fp - pos - neg) ELSE 1 END) / 2) / sum(pos) AS pr FROM a2)
SELECT CASE WHEN a.pr_auc - b.pr > 0.02 THEN 'BoostedTrees' ELSE 'LogisticRegression' END AS champion,
  round(a.pr_auc - b.pr, 6) AS pr_auc_gap FROM areas a, b""".lstrip(), SCORED_SQL, _LABELLED, _CURVES).replace("\n, a2 AS", ",\na2 AS"))
def _(spark, d):
    base = stage(rule_scored(spark, d).select("employee_id", "p_attrition", "compa_ratio").join(
        subjects(spark, d, ["employee_id", "attrition_flag"]), "employee_id").select(
        F.col("p_attrition").alias("a"), F.bround("compa_ratio", 2).alias("b"), F.col("attrition_flag").alias("label")))
    rows = [evaluation.curve_areas(base.select(F.col(c).alias("p"), "label").dropna(subset=["p"]) if c == "a" else
                                   base.select(F.col(c).alias("p"), "label"))
            .select(F.lit(n).alias("model"), "pr_auc") for c, n in (("a", "BoostedTrees"), ("b", "LogisticRegression"))]
    return rounded(evaluation.champion_table(rows[0].unionByName(rows[1])))


# --------------------------------------------------------------- collinearity
# Price columns of the lines: strongly related, with one unrelated column.
_LINES = """lines AS (SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, l_discount AS discount, l_tax AS tax FROM lineitem)"""
_COLS = ("price", "net", "gross", "discount")
_THREE = ("price", "net", "discount")
_PAIRS = [(i, j, a, b) for i, a in enumerate(_COLS) for j, b in enumerate(_COLS) if i < j]
_CORR = _LINES + ", corr AS (" + " UNION ALL ".join(
    f"SELECT {i} AS position_1, {j} AS position_2, '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r FROM lines"
    for i, j, a, b in _PAIRS) + ")"
# For three columns, inflation has a closed form in the pairwise correlations.
_VIF3 = """vif AS (SELECT 'price' AS feature, round_even((1 - bc * bc) / det, 2) AS vif FROM k
UNION ALL SELECT 'net', round_even((1 - ac * ac) / det, 2) FROM k
UNION ALL SELECT 'discount', round_even((1 - ab * ab) / det, 2) FROM k)"""
_K3 = """k AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM (
  SELECT corr(price, net) AS ab, corr(price, discount) AS ac, corr(net, discount) AS bc FROM lines))"""


def _lines(spark, d):
    price, off, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").select(
        price.alias("price"), (price * (1 - off)).alias("net"), (price * (1 - off) * (1 + tax)).alias("gross"),
        off.alias("discount"), tax.alias("tax"))


@query("M18_variance_inflation", f"WITH {_LINES}, {_K3}, {_VIF3} SELECT * FROM vif")
def _(spark, d):
    return collinearity.variance_inflation(_lines(spark, d), _THREE)


_BAND = "CASE WHEN vif > 10 THEN 'critical' WHEN vif > 5 THEN 'high' WHEN vif > 2 THEN 'moderate' ELSE 'clean' END"


@query("M19_inflation_bands", f"WITH {_LINES}, {_K3}, {_VIF3} SELECT {_BAND} AS band, count(*) AS n FROM vif GROUP BY 1")
def _(spark, d):
    vif = collinearity.variance_inflation(_lines(spark, d), _THREE)
    return collinearity.inflation_bands(vif).groupBy("band").agg(F.count("*").alias("n"))


@query("M20_correlations", f"WITH {_CORR} SELECT * REPLACE (round(r, 6) AS r) FROM corr")
def _(spark, d):
    return rounded(collinearity.correlation_table(_lines(spark, d), _COLS))


_HIGH = "high AS (SELECT feature_1, feature_2, round_even(r, 3) AS r, round_even(abs(r), 3) AS abs_r FROM corr WHERE abs(r) > 0.7)"


@query("M21_high_pairs", f"WITH {_CORR}, {_HIGH} SELECT * FROM high")
def _(spark, d):
    return collinearity.high_pairs(collinearity.correlation_table(_lines(spark, d), _COLS))


_PICK = """pick AS (SELECT DISTINCT CASE WHEN coalesce(a.vif, 0) > coalesce(b.vif, 0) THEN feature_1 ELSE feature_2 END AS feature
  FROM high LEFT JOIN vif a ON a.feature = feature_1 LEFT JOIN vif b ON b.feature = feature_2 WHERE abs_r > 0.85)"""


def _pairs_and_vif(spark, d):
    lines = _lines(spark, d)
    return (collinearity.high_pairs(collinearity.correlation_table(lines, _COLS)),
            collinearity.variance_inflation(lines, _THREE))


@query("M22_correlated_drops", f"WITH {_CORR}, {_HIGH}, {_K3}, {_VIF3}, {_PICK} SELECT feature FROM pick")
def _(spark, d):
    return collinearity.correlated_drops(*_pairs_and_vif(spark, d))


@query("J5_inflation_lookup", f"""WITH {_CORR}, {_HIGH}, {_K3}, {_VIF3} SELECT feature_1, feature_2,
  coalesce(a.vif, 0) AS vif_1, coalesce(b.vif, 0) AS vif_2 FROM corr LEFT JOIN vif a ON a.feature = feature_1
  LEFT JOIN vif b ON b.feature = feature_2""")
def _(spark, d):
    lines = _lines(spark, d)
    pairs, vif = collinearity.correlation_table(lines, _COLS), collinearity.variance_inflation(lines, _THREE)
    one = vif.select(F.col("feature").alias("feature_1"), F.col("vif").alias("vif_1"))
    two = vif.select(F.col("feature").alias("feature_2"), F.col("vif").alias("vif_2"))
    return pairs.join(one, "feature_1", "left").join(two, "feature_2", "left").select(
        "feature_1", "feature_2", F.coalesce("vif_1", F.lit(0.0)).alias("vif_1"), F.coalesce("vif_2", F.lit(0.0)).alias("vif_2"))


_FLAGGED = """flags AS (SELECT feature, vif > 10 AS by_vif, abs(corr_y) < 0.02 AS by_l1,
  feature IN (SELECT feature FROM pick) AS by_corr FROM vif JOIN (
  SELECT 'price' AS feature, corr(price, tax) AS corr_y FROM lines UNION ALL
  SELECT 'net', corr(net, tax) FROM lines UNION ALL SELECT 'discount', corr(discount, tax) FROM lines) USING (feature))"""


def _flags(spark, d):
    pairs, vif = _pairs_and_vif(spark, d)
    weak = collinearity.correlation_table(_lines(spark, d), (*_THREE, "tax")).filter("feature_2 = 'tax'").select(
        F.col("feature_1").alias("feature"), (F.abs("r") < 0.02).alias("by_l1"))
    picked = collinearity.correlated_drops(pairs, vif).withColumn("by_corr", F.lit(True))
    return (vif.select("feature", (F.col("vif") > 10).alias("by_vif")).join(weak, "feature")
            .join(picked, "feature", "left").na.fill(False, ["by_corr"]))


@query("U1_recommend_drops", f"""WITH {_CORR}, {_HIGH}, {_K3}, {_VIF3}, {_PICK}, {_FLAGGED}
  SELECT feature FROM flags WHERE by_vif AND (by_l1 OR by_corr)""")
def _(spark, d):
    return collinearity.recommend_drops(_flags(spark, d))


@query("U2_remaining_features", f"""WITH {_CORR}, {_HIGH}, {_K3}, {_VIF3}, {_PICK}, {_FLAGGED}
  SELECT feature FROM vif EXCEPT SELECT feature FROM flags WHERE by_vif AND (by_l1 OR by_corr)""")
def _(spark, d):
    flags = _flags(spark, d)
    return collinearity.remaining_features(flags.select("feature"), collinearity.recommend_drops(flags))


@query("M18_feature_inflation")
def _(spark, d):
    df, contract = imputed_features(spark, d)
    return collinearity.variance_inflation(stage(df), contract)


# --------------------------------------------------------------- pairwise complete, on measures with nulls
_WITH_NULLS = ("compa_ratio", "hike_vs_band_median", "perf_rating_current", "login_freq_30d", "login_freq_slope_30d", "leave_days_30d",
               "performance_rating_delta", "manager_attrition_rate_6m", "team_size_change_pct", "tenure_months")


@query("M20_pairwise_correlations", on_subjects(" UNION ALL ".join(
    f"SELECT {i} AS position_1, {j} AS position_2, '{a}' AS feature_1, '{b}' AS feature_2, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM subjects"
    for i, a in enumerate(_WITH_NULLS) for j, b in enumerate(_WITH_NULLS) if i < j)))
def _(spark, d):
    return rounded(collinearity.correlation_table(subjects(spark, d, list(_WITH_NULLS)), _WITH_NULLS))
