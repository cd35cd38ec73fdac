from pyspark.sql import functions as F

from retenta.operators import profile, validation


def test_nulls_duplicates_labels(spark):
    a = spark.createDataFrame([(1.0, 1), (None, 2), (3.0, 2)], "a double, id int")
    assert [tuple(r) for r in profile.null_profile(a, ["a", "id"]).collect()] == [("a", 1, 33.33)]
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,), (None,)], "id int")
    assert profile.duplicate_keys(ids, "id").first()[0] == 2
    labels = spark.createDataFrame([(0,), (1,), (2,), (None,)], "attrition_flag int")
    assert [r["value"] for r in profile.label_values(labels).filter("NOT is_binary").collect()] == [2.0]


def test_iqr(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 11, 12, 13, 14, 500)], "tenure_months double")
    row = profile.iqr_outliers(df).first()
    assert row["extreme_high"] == 1 and row["upper_fence"] == 21.25 and row["max_value"] == 500.0
    ok = spark.createDataFrame([(float(v),) for v in range(10, 16)], "tenure_months double")
    assert profile.iqr_outliers(ok).count() == 0


def base(spark, n=100, **over):
    cols = {"employee_id": lambda i: f"E{i}", "band": lambda i: 4, "department": lambda i: "d", "circle": lambda i: "c",
            "tenure_months": lambda i: 20.0, "attrition_flag": lambda i: int(i % 100 < 18), "compa_ratio": lambda i: 1.0,
            "perf_rating_current": lambda i: 3.0, "months_since_promotion": lambda i: 5.0, "months_since_hike": lambda i: 5.0,
            "login_freq_30d": lambda i: 10.0} | over
    kinds = {"employee_id": "string", "department": "string", "circle": "string", "band": "int", "attrition_flag": "int"}
    return spark.createDataFrame([tuple(f(i) for f in cols.values()) for i in range(n)],
                                 ", ".join(f"{c} {kinds.get(c, 'double')}" for c in cols))


def outcome(df):
    return profile.verdict(profile.readiness(df)).first()


def test_readiness(spark):
    assert outcome(base(spark))["verdict"] == "READY"
    assert outcome(base(spark).drop("band"))["verdict"] == "BLOCKED"
    assert outcome(base(spark, employee_id=lambda i: f"E{max(i, 5)}"))["verdict"] == "BLOCKED"
    assert outcome(base(spark, compa_ratio=lambda i: None if i < 35 else 1.0))["verdict"] == "BLOCKED"
    off = outcome(base(spark, attrition_flag=lambda i: int(i < 30)))
    assert off["verdict"] == "READY" and off["n_warnings"] == 1


def checks(df, contract=("f",)):
    return validation.Checks(df, contract)


def passed(df, rows):
    return [r["passed"] for r in df.run(rows).collect()]


def test_counts_and_presence(spark):
    for n, ok in ((100, False), (500, True)):
        c = checks(spark.range(n).withColumn("f", F.lit(1.0)))
        assert passed(c, c.row_count()) == [ok]
    c = checks(spark.createDataFrame([(1.0, None), (2.0, 1.0)], "a double, b double"), ("a", "b", "c"))
    present = c.run(c.features_present()).first()
    assert not present["passed"] and present["column"] == "c"
    assert [(r["column"], r["passed"]) for r in c.run(c.no_nulls()).collect()] == [("a", True), ("b", False)]


def test_label(spark):
    for values, ok in (([0, 1, 2], False), ([0, 1, None], False), ([0, 0, 0, 1], True)):
        c = checks(spark.createDataFrame([(v,) for v in values], "attrition_flag int"))
        row = c.run(c.label_valid()).first()
        assert row["passed"] is ok
    assert "25.0%" in row["message"]
    c = checks(spark.range(3))
    assert passed(c, c.label_valid()) == [False]


def test_balance_is_inclusive(spark):
    for share, ok in ((4, False), (65, False), (5, True), (20, True)):
        c = checks(spark.range(100).select((F.col("id") < share).cast("int").alias("attrition_flag")))
        assert passed(c, c.class_balance()) == [ok]


def test_ranges_variance_interactions_dummies(spark):
    for bad, ok in ((10, False), (2, True)):
        c = checks(spark.range(100).select(F.when(F.col("id") < bad, 99).otherwise(4).alias("band")), ("band",))
        assert passed(c, c.ranges()) == [ok]
    flat = spark.range(10).select(F.lit(1.0).alias("f"), F.lit(0).alias("interact_x"))
    c = checks(flat, ("f", "interact_x"))
    assert passed(c, c.variance()) == [False]
    single = checks(flat.limit(1))
    assert passed(single, single.variance()) == [True]
    for n, ok in ((1, False), (50, True)):
        c = checks(spark.range(1000).select((F.col("id") < n).cast("int").alias("interact_x")))
        assert passed(c, c.interactions()) == [ok]
    every = spark.range(9).select(*[(F.col("id") % 3 == k).cast("int").alias(f"dept_{k}") for k in range(3)])
    assert passed(checks(every), checks(every).dummies()) == [False]
    dropped = every.drop("dept_0")
    assert passed(checks(dropped), checks(dropped).dummies()) == [True]


def split(spark, train, test):
    rows = [(i, int(i % 10 < train)) for i in range(80)] + [(80 + i, int(i % 10 < test)) for i in range(20)]
    return validation.split_check(spark.createDataFrame(rows, "k bigint, attrition_flag int").repartition(3), "k").first()


def test_split(spark):
    assert split(spark, 3, 1)["message"] == "large drift"
    assert split(spark, 2, 0)["message"] == "near-empty class"
    assert split(spark, 2, 2)["passed"]


def test_summary(spark):
    df = spark.range(600).select(F.col("id").alias("k"), F.col("id").cast("string").alias("employee_id"),
                                 (F.col("id") % 5 == 0).cast("int").alias("attrition_flag"), F.rand(1).alias("f"))
    ok = validation.summary(validation.validate_features(df, ["f"], "k")).first()
    assert ok["can_proceed"]
    bad = validation.summary(validation.validate_features(df, ["f", "g"], "k")).first()
    assert not bad["can_proceed"] and bad["n_failed"] == 1
