"""Shape of the physical plans: what matters at scale and does not show in results."""

import pytest

from retenta.plans import catalog
from retenta.plans.subjects import subjects

catalog.load()


@pytest.fixture(autouse=True, scope="module")
def whole_plan_texts(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(spark, data, name):
    return catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    text = catalog.QUERIES["S2_table_scan"](spark, data)._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,49.0)" in text and "EqualTo(l_returnflag,R)" in text
    assert "l_extendedprice" not in text.split("== Optimized Logical Plan ==")[1].split("ReadSchema: ")[1].splitlines()[0]


@pytest.mark.parametrize("name", ["tier_budget_by_department", "A7_rates_by_dimension", "A17_readiness_rules", "F21_feature_table",
                                  "F22_peer_attrition", "G3_min_max", "P14_winsorise", "M6_line_curves", "J2_score_upload",
                                  "K3_top_per_tier", "T1_chunks", "T3_cosine_top_k", "T5_context_text", "M15_concordance",
                                  "M16_kaplan_meier", "J10_hazard_lookup", "P2_value_mapping_levenshtein"])
def test_no_cross_or_nested_loop_join(spark, data, name):
    text = plan(spark, data, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_is_limited_before_the_shuffle(spark, data):
    text = plan(spark, data, "K3_top_per_tier")
    assert text.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan(spark, data, "K3_top_overall")


def test_scoring_stays_in_the_jvm(spark, data):
    for name in ("tier_budget_by_department", "E4_driver_labelling", "P5_numeric_parse", "T1_chunks", "F21_feature_table"):
        text = plan(spark, data, name)
        assert "Python" not in text and "InPandas" not in text and "InArrow" not in text


def test_only_needed_sources_are_read(spark, data):
    text = plan(spark, data, "A13_rate_pivot")
    assert "lineitem" not in text and "events" not in text


def test_dimensions_share_one_scan(spark, data):
    assert plan(spark, data, "A7_line_rates").count("FileScan") == 1


def test_results_do_not_depend_on_partitioning(spark, data, monkeypatch):
    from retenta.operators import evaluation, profile
    from retenta.plans.scored import rule_scored
    base = rule_scored(spark, data).cache()
    shuffled = base.repartition(7, "gender")
    for fn in (lambda x: profile.describe(x, ("tenure_months", "compa_ratio")).orderBy("column"),
               lambda x: evaluation.curve_areas(x.withColumn("label", (x.order_col % 3 == 0).cast("int")), "p_attrition", "label")):
        a, b = fn(base).collect(), fn(shuffled).collect()
        assert [[round(v, 9) if isinstance(v, float) else v for v in r] for r in a] == \
               [[round(v, 9) if isinstance(v, float) else v for v in r] for r in b]


def test_every_check_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_customers_are_not_broadcast(spark, data):
    """Order facts have a row per customer; their small files must not have them sent through the driver."""
    out = subjects(spark, data, ["employee_id", "compa_ratio", "tenure_months"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
