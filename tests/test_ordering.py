import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.operators import ordering


def frame(spark, n=400, seed=3):
    rng = random.Random(seed)
    # A third of the rows share one value and one group.
    rows = [(i, "hot" if i % 3 == 0 else rng.choice("ab"), 7.0 if i % 3 == 0 else round(rng.gauss(0, 5), 2)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id bigint, g string, v double"), rows


@pytest.mark.parametrize("size", [20, 1_000_000])
def test_quantiles_match_numpy(spark, size):
    df, rows = frame(spark)
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = {r["column"]: r for r in ordering.exact_quantiles(df.withColumn("w", F.col("id") * 0.5), ["v", "w"], probs,
                                                            rows_per_bucket=size).collect()}
    assert got["v"]["q"] == pytest.approx(list(np.quantile([r[2] for r in rows], probs)))
    assert got["w"]["q"] == pytest.approx(list(np.quantile([r[0] * 0.5 for r in rows], probs)))
    assert got["v"]["n"] == len(rows)


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert ordering.exact_quantiles(df, ["v"], [0.5]).first()["q"] == [2.0]
    assert ordering.exact_quantiles(df.filter("v IS NULL"), ["v"], [0.5]).count() == 0


@pytest.mark.parametrize("size", [15, 1_000_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, size, descending):
    df, rows = frame(spark)
    out = ordering.running_totals(df.withColumn("one", F.lit(1)), "id", ["one"], ["g"], descending, size)
    got = {r["id"]: r["cum_one"] for r in out.collect()}
    for g in {r[1] for r in rows}:
        ids = sorted((r[0] for r in rows if r[1] == g), reverse=descending)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_running_totals_keep_null_groups(spark):
    df = spark.createDataFrame([(1, None, 2), (2, None, 3), (3, "a", 5)], "id int, g string, c int")
    got = {r["id"]: r["cum_c"] for r in ordering.running_totals(df, "id", ["c"], ["g"], rows_per_bucket=1).collect()}
    assert got == {1: 2, 2: 5, 3: 5}


@pytest.mark.parametrize("n,train", [(20, 16), (10, 8), (15, 12)])
@pytest.mark.parametrize("size", [4, 1_000_000])
def test_ordered_split_on_shuffled_rows(spark, n, train, size, monkeypatch):
    monkeypatch.setattr(ordering.kth_smallest, "__defaults__", (size,))
    df = spark.createDataFrame(random.Random(1).sample([(i,) for i in range(n)], n), "k bigint").repartition(3)
    rows = ordering.ordered_split(df, "k").collect()
    assert sorted(r["k"] for r in rows if r["is_train"]) == list(range(train))


def test_values_at_ranks(spark):
    df, rows = frame(spark)
    vals = sorted(r[2] for r in rows)
    got = ordering.values_at_ranks(df, "v", [1, 50, 200, 400], rows_per_bucket=30)
    assert got == {k: vals[k - 1] for k in (1, 50, 200, 400)}
    assert ordering.kth_smallest(df, "v", 401) is None


def test_no_global_window_over_rows(spark):
    df, _ = frame(spark)
    plan = ordering.running_totals(df.withColumn("one", F.lit(1)), "id", ["one"], rows_per_bucket=50)
    text = plan._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line and "cum_one" in line]
    assert windows and all("__bucket" in w for w in windows)
