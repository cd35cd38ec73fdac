import pytest
from pyspark.sql import functions as F

from retenta import schema
from retenta.functions import similarity, text
from retenta.operators import ingest


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


NAMES = ["﻿employee_id", " Employee ID ", "Tenure (Months)!", "emp--id"]
CLEAN = ["employee_id", "employee_id", "tenure_months", "emp_id"]


def test_names_as_column_and_on_driver(spark):
    assert column(spark, NAMES, text.normalise_name) == CLEAN
    assert [text.normalise_header(n) for n in NAMES] == CLEAN


def test_clean_column_names_keeps_duplicates_apart(spark):
    df = spark.createDataFrame([("a", "b")], "`Emp ID` string, `emp-id` string")
    out = ingest.clean_column_names(df)
    assert out.columns == ["emp_id", "emp_id_2"]
    assert ingest.renamed_headers(df, out) == [("Emp ID", "emp_id"), ("emp-id", "emp_id_2")]


def test_column_mapping(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")],
                               "employee_id string, grade string, departmnt string, totally_unrelated_garbage_xyz string")
    out, resolved = ingest.map_columns(df)
    assert out.columns == ["employee_id", "band", "department"]
    by = {r["raw"]: r for r in resolved.collect()}
    assert by["employee_id"]["method"] == "exact" and by["grade"]["method"] == "alias"
    assert by["departmnt"]["method"] == "fuzzy" and by["departmnt"]["score"] == pytest.approx(94.7, abs=0.05)
    assert by["totally_unrelated_garbage_xyz"]["method"] == "unmapped"


def test_two_headers_for_one_name_and_reserved_dates(spark):
    df = spark.createDataFrame([("1", "2", "2020-01-01")], "emp_id string, employee_id string, last_promotion_date string")
    out, _ = ingest.map_columns(df)
    assert out.columns == ["employee_id", "last_promotion_date"]
    assert out.first()["employee_id"] == "2"


@pytest.mark.parametrize("a,b,want", [("promotion_date", "promotion_gap", 81.5), ("last_promotion_date", "last_promotion_months", 80.0),
                                      ("", "", 100.0), ("abc", "xyz", 0.0), ("abc", "abc", 100.0)])
def test_similarity(a, b, want):
    assert similarity.similarity(a, b) == pytest.approx(want, abs=0.05)


def test_similarity_against_plain_recursion():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], (prev + 1 if x == y else max(row[j], row[j - 1]))
        return row[-1]
    words = ["department", "departmnt", "dept", "salary_revision_gap", "a", "tenure_months", "mothns", "ab" * 40]
    for a in words:
        for b in words:
            assert similarity.similarity(a, b) == pytest.approx(200.0 * lcs(a, b) / (len(a) + len(b)))


def test_parse_number(spark):
    got = column(spark, ["₹9,80,000", "8.5%", "−5", "not_a_number", None, "5d", "nan", "inf", "1_000", " 1e3 ", "-.5"],
                 text.parse_number)
    assert got == [980000.0, 8.5, -5.0, None, None, None, None, None, None, 1000.0, -0.5]


def test_null_tokens(spark):
    got = column(spark, [" N/A ", "?", "Unknown", "", " nil\t", "x", None, "none of"], text.null_tokens)
    assert got == [None, None, None, None, None, "x", None, "none of"]


def test_labels_and_gender(spark):
    assert column(spark, ["Resigned", "Active", " YES ", "0", "maybe"], text.parse_label) == [1, 0, 1, 0, None]
    assert column(spark, ["Male", "f", "1", "Woman", "other"], text.parse_gender) == ["M", "F", "M", "F", "other"]


def test_percentages_are_rescaled(spark):
    df = spark.createDataFrame([(85.0,), (90.0,), (95.0,)], "compa_ratio double")
    assert ingest.rescale_percent(df).agg(F.max("compa_ratio")).first()[0] < 2.0
    small = spark.createDataFrame([(0.85,), (0.9,)], "compa_ratio double")
    assert ingest.rescale_percent(small).agg(F.max("compa_ratio")).first()[0] == 0.9


def test_dates_to_months(spark):
    df = spark.createDataFrame([("2001-01-01",), ("01/02/2001",), ("03-04-97",), ("rubbish",)], "hire_date string")
    as_of = F.lit("2001-08-01").cast("date")
    got = [r[0] for r in ingest.derive_months(df, as_of).collect()]
    assert got == [7.0, 5.9, 52.9, None]
    kept = df.withColumn("tenure_months", F.lit("12"))
    assert ingest.derive_months(kept, as_of).agg(F.min("tenure_months")).first()[0] == 12.0


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "a", None, 3), (2.0, "b", None, 10), (None, "b", None, 3), (4.0, "a", None, 10), (None, None, None, None)],
                               "tenure_months double, department string, circle string, band int")
    out = ingest.impute_mode(ingest.impute_median(df)).collect()
    assert sorted(r["tenure_months"] for r in out) == [1.0, 2.0, 2.0, 2.0, 4.0]
    assert [r["department"] for r in out].count("a") == 3      # smallest of the tied modes
    assert {r["circle"] for r in out} == {"Unknown"}
    assert sorted(r["band"] for r in out) == [3, 3, 3, 10, 10]


def test_winsorise(spark):
    df = spark.createDataFrame([(float(v),) for v in [10, 11, 12, 13, 14] * 20 + [5000]], "tenure_months double")
    assert ingest.winsorise(df).agg(F.max("tenure_months")).first()[0] < 5000
    flat = spark.createDataFrame([(15.0,)] * 50, "tenure_months double")
    bounds = ingest.winsor_bounds(flat).first()
    assert bounds["n_low"] + bounds["n_high"] == 0
    assert ingest.winsorise(flat, approximate=True).distinct().count() == 1


def test_small_groups(spark):
    rows = [("s", "n", 3.0)] * 5 + [("t", "n", 2.0), (None, "n", 4.0)]
    df = spark.createDataFrame(rows, "department string, circle string, peer_attrition_count_90d double")
    got = {(r[0], r[2]) for r in ingest.zero_small_groups(df).collect()}
    assert got == {("s", 3.0), ("t", 0.0), (None, 4.0)}


def test_schema_issues(spark):
    one = ingest.schema_issues(spark.createDataFrame([("x",)], "employee_id string")).collect()
    assert any(r["column"] == "band" and r["severity"] == "CRITICAL" for r in one)
    full = {r.name: r for r in schema.CANONICAL}
    ddl = ", ".join(f"{n} {'string' if r.dtype == 'str' else 'double'}" for n, r in full.items())
    good = [tuple(("x" if r.dtype == "str" else 1.0) for r in full.values())] * 2
    assert ingest.schema_issues(spark.createDataFrame(good, ddl)).count() == 0
    bad = [tuple((None if n == "band" else v) for n, v in zip(full, good[0]))]
    issues = ingest.schema_issues(spark.createDataFrame(bad, ddl)).collect()
    assert [(r["column"], r["issue"], r["n"]) for r in issues] == [("band", "nulls", 1)]


def test_whole_ingest_job(spark, data):
    from retenta.plans.dirty import dirty_subjects
    from retenta.plans.pipeline import ingest_job
    from retenta.plans.subjects import as_of_date
    raw = dirty_subjects(spark, data).withColumnsRenamed({"employee_id": "Emp ID", "department": "Dept"})
    done = ingest_job(raw, as_of_date(spark, data))
    assert set(done.table.columns) - {"order_col"} <= set(schema.CANONICAL_NAMES)
    assert done.table.count() == 150
    filled = [c for c in schema.FILL_MEDIAN if c in done.table.columns]
    assert done.table.dropna(subset=filled).count() == 150
    assert done.audit.filter("step = 'cap'").count() > 0
    assert done.audit.filter("step = 'map' AND column = 'dept' AND action = 'alias'").count() == 1
