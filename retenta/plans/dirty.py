"""A messy text extract of the subject table, for the cleaning operators. The dirt depends only on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from retenta.plans.subjects import ALL_COLUMNS, subjects, table

NUMERIC_DIRTY = ("tenure_months", "months_since_promotion", "months_since_hike", "months_since_manager_changed",
                 "compa_ratio", "hike_vs_band_median", "perf_rating_current", "login_freq_30d",
                 "login_freq_slope_30d", "training_completions_90d", "leave_days_30d", "performance_rating_delta",
                 "manager_attrition_rate_6m", "team_size_change_pct")


def dirty_number(value: Column, key: Column) -> Column:
    x = value.cast("decimal(18,6)").cast("string")
    return (F.when(key % 10 == 0, "N/A").when(key % 10 == 1, " ? ")
            .when(key % 10 == 2, F.concat(F.lit("₹"), x)).when(key % 10 == 3, F.concat(x, F.lit("%")))
            .when(key % 10 == 4, F.replace(x, F.lit("-"), F.lit("−"))).when(key % 10 == 5, "not_a_number")
            .otherwise(x))


def dirty_label(value: Column, key: Column) -> Column:
    yes = F.when(key % 3 == 0, "Resigned").when(key % 3 == 1, "Yes").otherwise(" TRUE ")
    no = F.when(key % 3 == 0, "Active").when(key % 3 == 1, "no").otherwise("0")
    return F.when(value == 1, yes).otherwise(no)


def dirty_gender(value: Column, key: Column) -> Column:
    m = F.when(key % 4 == 0, "Male").when(key % 4 == 1, "m ").when(key % 4 == 2, "1").otherwise("M")
    f = F.when(key % 4 == 0, "FEMALE").when(key % 4 == 1, " woman").when(key % 4 == 2, "0").otherwise("other")
    return F.when(value == "M", m).otherwise(f)


def dirty_date(value: Column, key: Column) -> Column:
    return (F.when(key % 3 == 0, F.date_format(value, "yyyy-MM-dd"))
            .when(key % 3 == 1, F.date_format(value, "dd/MM/yyyy")).otherwise(F.date_format(value, "MM-dd-yy")))


def dirty_subjects(spark: SparkSession, sf_dir: str, columns=ALL_COLUMNS) -> DataFrame:
    columns = [c for c in columns if c != "order_col"]
    key = F.col("order_col")
    exprs = {c: F.col(c).cast("string") for c in columns}
    exprs |= {c: dirty_number(F.col(c), key) for c in columns if c in NUMERIC_DIRTY}
    if "attrition_flag" in exprs:
        exprs["attrition_flag"] = dirty_label(F.col("attrition_flag"), key)
    if "gender" in exprs:
        exprs["gender"] = dirty_gender(F.col("gender"), key)
    if "department" in exprs:
        exprs["department"] = F.when(key % 10 == 7, " Not Available ").otherwise(F.col("department"))
    base = subjects(spark, sf_dir, ["order_col", *columns])
    return base.select("order_col", *[e.alias(c) for c, e in exprs.items()])


def dirty_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("d"))
    return first.select(F.col("o_custkey").alias("order_col"), dirty_date(F.col("d"), F.col("o_custkey")).alias("hire_date"))


def _number_sql(c: str) -> str:
    x = f"CAST(CAST({c} AS DECIMAL(18,6)) AS VARCHAR)"
    return (f"CASE order_col % 10 WHEN 0 THEN 'N/A' WHEN 1 THEN ' ? ' WHEN 2 THEN '₹' || {x} WHEN 3 THEN {x} || '%' "
            f"WHEN 4 THEN replace({x}, '-', '−') WHEN 5 THEN 'not_a_number' ELSE {x} END AS {c}")


DIRTY_SQL = f"""
dirty AS (
  SELECT order_col, employee_id, CAST(band AS VARCHAR) AS band, circle,
         CASE WHEN order_col % 10 = 7 THEN ' Not Available ' ELSE department END AS department,
         CASE WHEN gender = 'M' THEN CASE order_col % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'm ' WHEN 2 THEN '1' ELSE 'M' END
              ELSE CASE order_col % 4 WHEN 0 THEN 'FEMALE' WHEN 1 THEN ' woman' WHEN 2 THEN '0' ELSE 'other' END END AS gender,
         CASE WHEN attrition_flag = 1
              THEN CASE order_col % 3 WHEN 0 THEN 'Resigned' WHEN 1 THEN 'Yes' ELSE ' TRUE ' END
              ELSE CASE order_col % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'no' ELSE '0' END END AS attrition_flag,
         {", ".join(_number_sql(c) for c in NUMERIC_DIRTY)}
  FROM subjects)
"""


def parse_sql(c: str) -> str:
    """SQL form of the numeric parse, for the check."""
    bare = f"replace(regexp_replace({c}, '[₹$,%\\s]', '', 'g'), '−', '-')"
    return (f"CASE WHEN regexp_matches({bare}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') "
            f"THEN TRY_CAST({bare} AS DOUBLE) END")


def null_sql(c: str) -> str:
    tokens = ("'na','n/a','nan','null','none','-','?','.','#n/a','#na','missing','unknown','',"
              "'not available','not applicable','nil'")
    return f"CASE WHEN lower(trim({c})) IN ({tokens}) THEN NULL ELSE {c} END"


# Parsed table: null tokens, then numbers.
TYPED_SQL = f"""
typed AS (
  SELECT order_col, employee_id, CAST(band AS DOUBLE) AS band, {null_sql('department')} AS department, circle,
         CASE lower(trim(attrition_flag)) WHEN 'resigned' THEN 1 WHEN 'yes' THEN 1 WHEN 'true' THEN 1
              WHEN 'active' THEN 0 WHEN 'no' THEN 0 WHEN '0' THEN 0 END AS attrition_flag,
         CASE lower(trim(gender)) WHEN 'male' THEN 'M' WHEN 'm' THEN 'M' WHEN '1' THEN 'M' WHEN 'man' THEN 'M'
              WHEN 'female' THEN 'F' WHEN 'f' THEN 'F' WHEN '0' THEN 'F' WHEN 'woman' THEN 'F' ELSE gender END AS gender,
         {", ".join(parse_sql(c) + " AS " + c for c in NUMERIC_DIRTY)}
  FROM dirty)
"""
