import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.operators import survival
from retenta.sources.models import load_cox, save_cox


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 1), (4.0, 0)], "t double, e int")


@pytest.mark.parametrize("size", [2, 1_000_000])
def test_kaplan_meier(five, size):
    got = {r["t"]: r["survival"] for r in survival.kaplan_meier(five, "t", "e", rows_per_bucket=size).collect()}
    assert got == pytest.approx({1.0: 4 / 5, 2.0: 3 / 5, 3.0: 3 / 10, 4.0: 3 / 10})


def test_survival_falls_and_band_holds(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(float(rng.randint(1, 40)), int(rng.random() < .6), rng.choice("ab")) for _ in range(300)], "t double, e int, g string")
    rows = survival.kaplan_meier(df, "t", "e", "g", rows_per_bucket=10).collect()
    for g in "ab":
        s = [r["survival"] for r in sorted(rows, key=lambda r: r["t"]) if r["group"] == g]
        assert all(x >= y for x, y in zip(s, s[1:]))
    assert all(r["lower"] - 1e-12 <= r["survival"] <= r["upper"] + 1e-12 for r in rows)
    with pytest.raises(ValueError):
        survival.kaplan_meier(df, "t", "e", "e")


def test_log_rank_by_hand(spark):
    rows = [(1.0, 1, "a"), (2.0, 1, "b"), (3.0, 1, "a"), (4.0, 0, "b"), (4.0, 1, "a"), (6.0, 1, "b")]
    r = survival.log_rank(spark.createDataFrame(rows, "t double, e int, g string"), "t", "e", "g", "a", "b").first()
    o = e = v = 0.0
    for t in (1, 2, 3, 4, 6):
        at = [x for x in rows if x[0] >= t]
        n, n1 = len(at), sum(x[2] == "a" for x in at)
        d = sum(x[0] == t and x[1] for x in rows)
        o += sum(x[0] == t and x[1] and x[2] == "a" for x in rows)
        e += d * n1 / n
        v += d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) if n > 1 else 0
    assert r["chi2"] == pytest.approx((o - e) ** 2 / v)
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(r["chi2"] / 2)))


def efron(x, t, e, beta):
    """Log partial likelihood written from its definition."""
    eta = x @ beta
    w, out = np.exp(eta), 0.0
    for u in np.unique(t[e == 1]):
        dead = (t == u) & (e == 1)
        d = dead.sum()
        out += eta[dead].sum()
        for k in range(d):
            out -= math.log(w[t >= u].sum() - k / d * w[dead].sum())
    return out


@pytest.fixture(scope="module")
def cox_data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 2)) * [1.0, 3.0] + [0.0, 5.0]
    t = np.ceil(rng.exponential(1 / np.exp(.8 * x[:, 0] - .2 * (x[:, 1] - 5))) * 10)
    e = (rng.random(240) < .7).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), float(u), int(v)) for i, ((a, b), u, v) in enumerate(zip(x, t, e))],
                               "id int, x double, z double, t double, e int").repartition(5)
    return df, x, t, e


@pytest.mark.parametrize("size", [20, 1_000_000])
def test_cox_reaches_the_optimum(spark, cox_data, size):
    df, x, t, e = cox_data
    ridge = .01
    m = survival.cox_fit(df, ["x", "z"], "t", "e", ridge, rows_per_bucket=size)
    assert m.gradient_norm < 1e-6
    sd = x.std(0, ddof=1)
    z = (x - x.mean(0)) / sd
    beta = np.array(m.coefficients) * sd

    def objective(b):
        return efron(z, t, e, b) - len(t) * ridge / 2 * b @ b
    best = objective(beta)
    assert m.log_likelihood == pytest.approx(best, rel=1e-9)
    for k in range(2):
        for h in (-1e-3, 1e-3):
            assert objective(beta + h * np.eye(2)[k]) < best
    assert m.coefficients[0] > 0 > m.coefficients[1]


def test_cox_rejects_its_duration(spark, cox_data):
    with pytest.raises(ValueError):
        survival.cox_fit(cox_data[0], ["x", "t"], "t", "e")


def test_median_survival_and_round_trip(spark, cox_data, tmp_path):
    df, x, t, e = cox_data
    m = survival.cox_fit(df, ["x", "z"], "t", "e", .01)
    h = sorted((r["t"], r["h0"]) for r in m.baseline.collect())
    eta = (x - x.mean(0)) @ np.array(m.coefficients)
    want = {i: next((u for u, v in h if v >= math.log(2) / math.exp(eta[i])), None) for i in range(len(t))}
    got = {r["id"]: r["median_survival_months"] for r in survival.median_survival(df, m).collect()}
    assert got == want
    # More buckets give the same answer.
    merged = {r["id"]: r["median_survival_months"] for r in survival.median_survival(df, m, rows_per_bucket=15).collect()}
    assert merged == want
    save_cox(m, spark, str(tmp_path / "cox"))
    again = load_cox(spark, str(tmp_path / "cox"))
    assert again.coefficients == m.coefficients
    assert {r["id"]: r["median_survival_months"] for r in survival.median_survival(df, again).collect()} == want


@pytest.mark.parametrize("size", [25, 1_000_000])
def test_concordance_by_pairs(spark, size):
    rng = random.Random(9)
    rows = [(float(rng.randint(1, 30)), int(rng.random() < .6), round(rng.random(), 2)) for _ in range(200)]
    r = survival.concordance(spark.createDataFrame(rows, "t double, e int, r double"), "t", "e", "r", rows_per_bucket=size).first()
    con = dis = tie = 0
    for t1, e1, r1 in rows:
        for t2, e2, r2 in rows:
            if e1 and (t2 > t1 or (t2 == t1 and not e2)):
                con, dis, tie = con + (r1 > r2), dis + (r1 < r2), tie + (r1 == r2)
    assert (r["concordant"], r["discordant"], r["tied"]) == (con, dis, tie)


@pytest.mark.parametrize("per_row", [1, 7])
def test_ties_as_rows_equal_ties_in_place(spark, cox_data, per_row):
    df, *_ = cox_data
    one = survival.cox_fit(df, ["x", "z"], "t", "e", .01)
    many = survival.cox_fit(df, ["x", "z"], "t", "e", .01, ties_per_row=per_row, rows_per_bucket=50)
    assert many.coefficients == pytest.approx(one.coefficients, abs=1e-9)
    assert many.log_likelihood == pytest.approx(one.log_likelihood)
    assert max(map(abs, many.gradient)) == pytest.approx(many.gradient_norm)


def test_a_million_ties_at_one_duration(spark):
    df = spark.range(1_000_200).select(F.when(F.col("id") < 1_000_000, 5.0).otherwise(F.col("id") % 9 + 1.0).alias("t"),
                                       (F.col("id") % 2).cast("double").alias("x"), F.lit(1).alias("e"))
    model = survival.cox_fit(df, ["x"], "t", "e", 0.1, max_iter=2)
    assert model.gradient_norm < 1e-3 and abs(model.coefficients[0]) < 0.05


def test_chi2_tail(spark):
    xs = [0.0, 1e-9, 0.3, 1.0, 3.84, 6.63, 17.9, 18.1, 30.0, 200.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", survival.chi2_tail(F.col("x")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(math.erfc(math.sqrt(r["x"] / 2)), rel=1e-9, abs=1e-14)
    assert spark.createDataFrame([(None,)], "x double").select(survival.chi2_tail(F.col("x"))).first()[0] is None


@pytest.mark.parametrize("size", [3, 1_000_000])
def test_lookup_grows_with_the_targets(spark, size):
    """Targets far outnumber the points, lie on them, between them, beyond them, and alone in their bucket."""
    points = {0.5: 1.0, 1.5: 2.0, 1.75: 4.0, 9.0: 7.0}
    values = [0.1 * k for k in range(100)] + [0.5, 1.75, 9.0, 50.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "id int, y double")
    out = survival.first_at_least(df, F.col("y"), spark.createDataFrame([(t, h) for h, t in points.items()], "t double, h0 double"), "m", size)
    for r in out.collect():
        assert r["m"] == (None if r["y"] is None else next((t for h, t in points.items() if h >= r["y"]), None))
    # A frame that reaches to the end of its bucket is read anew for every row.
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan
