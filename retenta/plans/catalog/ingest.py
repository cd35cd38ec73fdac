"""Cleaning and mapping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from retenta import schema
from retenta.functions import text
from retenta.operators import ingest
from retenta.operators.features import peer_attrition
from retenta.plans.catalog import on_subjects, query, rounded
from retenta.plans.dirty import (DIRTY_SQL, NUMERIC_DIRTY, TYPED_SQL, dirty_dates, dirty_subjects, null_sql,
                                 parse_sql)
from retenta.plans.subjects import as_of_date, subjects, table
from retenta.session import stage

PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def typed(spark, d, columns):
    return ingest.coerce_types(ingest.normalise_nulls(dirty_subjects(spark, d, columns)))


@query("P1_name_normalisation", r"""
WITH raw AS (SELECT p_partkey, '  ' || upper(replace(p_name, ' ', ' -. ')) || ' (' || p_brand || ')!__' AS raw FROM part)
SELECT p_partkey, raw,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '[\s\-\.]+', '_', 'g'),
    '[^\p{L}\p{N}_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM raw""")
def _(spark, d):
    raw = F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit(" -. "))), F.lit(" ("),
                   F.col("p_brand"), F.lit(")!__"))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn(
        "name", text.normalise_name(F.col("raw")))


def _dropped_types(spark, d):
    k = (F.col("p_partkey") % 7).cast("int")
    t = F.col("p_type")
    return table(spark, d, "part").select(
        F.concat(F.substring(t, F.lit(1), k), F.substring(t, k + 2, F.length(t))).alias("raw"))


@query("P2_value_mapping_levenshtein", f"""
WITH raws AS (SELECT DISTINCT substr(p_type, 1, CAST(p_partkey % 7 AS INTEGER))
                || substr(p_type, CAST(p_partkey % 7 AS INTEGER) + 2) AS raw FROM part),
dict AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(PART_TYPES))}) t(pos, cand)),
scored AS (SELECT raw, pos, cand, CAST(100.0 AS DOUBLE) * (greatest(length(raw), length(cand)) - levenshtein(raw, cand))
             / greatest(length(raw), length(cand)) AS score FROM raws CROSS JOIN dict),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, pos) = 1)
SELECT raw, CASE WHEN raw = cand OR score >= 80 THEN cand END AS target,
       CASE WHEN raw = cand THEN 'exact' WHEN score >= 80 THEN 'fuzzy' ELSE 'unmapped' END AS method,
       round(score, 6) AS score, cand AS nearest FROM best""")
def _(spark, d):
    return rounded(ingest.match_names(_dropped_types(spark, d), canonical=PART_TYPES, aliases={},
                                      method="levenshtein"))


# The longest common subsequence, one character of the raw value at a time, as bits of a number.
@query("P2_value_mapping_indel", f"""
WITH RECURSIVE raws AS (SELECT raw, array_to_string(list_sort(regexp_extract_all(lower(raw), '\\S+')), ' ') AS key FROM (
  SELECT DISTINCT substr(p_type, 1, CAST(p_partkey % 7 AS INTEGER)) || substr(p_type, CAST(p_partkey % 7 AS INTEGER) + 2) AS raw FROM part)),
dict AS (SELECT pos, cand, lower(cand) AS key FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(PART_TYPES))}) t(pos, cand)),
masks AS (SELECT pos, ch, bit_or(CAST(1 AS BIGINT) << CAST(i - 1 AS INTEGER)) AS mask FROM (
  SELECT pos, unnest(string_split(key, '')) AS ch, generate_subscripts(string_split(key, ''), 1) AS i FROM dict) GROUP BY 1, 2),
run AS (SELECT raw, r.key, pos, d.key AS goal, 0 AS i, (CAST(1 AS BIGINT) << length(d.key)) - 1 AS state FROM raws r CROSS JOIN dict d
  UNION ALL SELECT raw, key, run.pos, goal, i + 1, ((state + (state & coalesce(mask, 0))) | (state - (state & coalesce(mask, 0)))) & ((CAST(1 AS BIGINT) << length(goal)) - 1)
  FROM run LEFT JOIN masks ON masks.pos = run.pos AND ch = substr(key, i + 1, 1) WHERE i < length(key)),
scored AS (SELECT raw, run.pos, cand, CAST(200.0 AS DOUBLE) * (length(goal) - bit_count(state)) / (length(goal) + length(run.key)) AS score
  FROM run JOIN dict USING (pos) WHERE i = length(run.key)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, pos) = 1)
SELECT raw, CASE WHEN raw = cand OR score >= 80 THEN cand END AS target,
       CASE WHEN raw = cand THEN 'exact' WHEN score >= 80 THEN 'fuzzy' ELSE 'unmapped' END AS method,
       round(score, 6) AS score, cand AS nearest FROM best""")
def _(spark, d):
    return rounded(ingest.match_names(_dropped_types(spark, d), canonical=PART_TYPES, aliases={}))


@query("J6_alias_resolution", """
WITH alias(a, t) AS (VALUES ('src0', 'north'), ('src1', 'north'), ('src2', 'south'))
SELECT source AS raw, t AS target, count(*) AS n_rows FROM documents LEFT JOIN alias ON source = a GROUP BY 1, 2""")
def _(spark, d):
    sizes = table(spark, d, "documents").groupBy(F.col("source").alias("raw")).agg(F.count("*").alias("n_rows"))
    found = ingest.match_names(sizes, canonical=("north", "south"), method="levenshtein",
                               aliases={"src0": "north", "src1": "north", "src2": "south"}, threshold=101.0)
    return sizes.join(found.select("raw", "target"), "raw", "left").select("raw", "target", "n_rows")


@query("P3_drop_unmapped", on_subjects("""
SELECT employee_id, band, department, gender, round(tenure_months, 6) AS tenure_months FROM subjects"""))
def _(spark, d):
    base = subjects(spark, d, ["employee_id", "band", "department", "gender", "tenure_months"])
    raw = base.withColumnsRenamed({"employee_id": "emp_id", "band": "grade", "department": "departmnt",
                                   "tenure_months": "total_tenure"}).withColumn("zz_unrelated_note", F.lit("x"))
    mapped, _ = ingest.map_columns(raw)
    return rounded(mapped.select("employee_id", "band", "department", "gender", "tenure_months"))


@query("P4_null_tokens", on_subjects(f"""
SELECT order_col, {null_sql('department')} AS department, {null_sql('tenure_months')} AS tenure_months,
       {null_sql('compa_ratio')} AS compa_ratio FROM dirty""", DIRTY_SQL))
def _(spark, d):
    cols = ["department", "tenure_months", "compa_ratio"]
    return ingest.normalise_nulls(dirty_subjects(spark, d, cols), cols)


@query("P5_numeric_parse", on_subjects(f"""
SELECT order_col, {", ".join(parse_sql(c) + " AS " + c for c in ("tenure_months", "hike_vs_band_median", "compa_ratio"))}
FROM dirty""", DIRTY_SQL))
def _(spark, d):
    cols = ["tenure_months", "hike_vs_band_median", "compa_ratio"]
    raw = dirty_subjects(spark, d, cols)
    return raw.select("order_col", *[text.parse_number(F.col(c)).alias(c) for c in cols])


@query("P6_coercion_losses", on_subjects("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(x) AS n_present, count(CASE WHEN x IS NOT NULL AND {parse_sql('x')} IS NULL THEN 1 END) "
    f"AS n_lost FROM (SELECT {null_sql(c)} AS x FROM dirty)" for c in NUMERIC_DIRTY), DIRTY_SQL))
def _(spark, d):
    raw = ingest.normalise_nulls(dirty_subjects(spark, d, NUMERIC_DIRTY), NUMERIC_DIRTY)
    return ingest.coercion_losses(raw, NUMERIC_DIRTY)


@query("P7_label_parse", on_subjects("SELECT order_col, attrition_flag FROM typed", DIRTY_SQL, TYPED_SQL))
def _(spark, d):
    return dirty_subjects(spark, d, ["attrition_flag"]).select(
        "order_col", text.parse_label(F.col("attrition_flag")).alias("attrition_flag"))


# Order states stand in for a label column with spellings that nobody knows.
@query("P7_label_rejects", """
SELECT 'state ' || o_orderstatus || o_custkey % 3 AS value, count(*) AS n_rejected FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def _(spark, d):
    state = F.col("o_orderstatus")
    label = F.when(state == "F", " Resigned ").otherwise(F.concat(F.lit("state "), state, (F.col("o_custkey") % 3).cast("string")))
    return ingest.label_rejects(table(spark, d, "orders").select(label.alias("attrition_flag")))


@query("P8_category_standardisation", on_subjects("SELECT order_col, gender FROM typed", DIRTY_SQL, TYPED_SQL))
def _(spark, d):
    return dirty_subjects(spark, d, ["gender"]).select("order_col", text.parse_gender(F.col("gender")).alias("gender"))


@query("P9_unit_rescale", on_subjects("""
SELECT order_col, round(CASE WHEN (SELECT quantile_cont(compa_ratio * 100, 0.5) FROM subjects) > 5
  THEN compa_ratio * 100 / 100 ELSE compa_ratio * 100 END, 6) AS compa_ratio FROM subjects"""))
def _(spark, d):
    raw = stage(subjects(spark, d, ["order_col", "compa_ratio"]))
    return rounded(ingest.rescale_percent(raw.withColumn("compa_ratio", F.col("compa_ratio") * 100)))


@query("P10_date_to_months", """
WITH ref_day AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders),
raw AS (SELECT o_custkey AS order_col, CASE o_custkey % 3 WHEN 0 THEN strftime(min(o_orderdate), '%Y-%m-%d')
          WHEN 1 THEN strftime(min(o_orderdate), '%d/%m/%Y') ELSE strftime(min(o_orderdate), '%m-%d-%y') END AS hire_date
        FROM orders GROUP BY o_custkey)
SELECT order_col, round_even(date_diff('day', CAST(CASE order_col % 3
    WHEN 0 THEN strptime(hire_date, '%Y-%m-%d') WHEN 1 THEN strptime(hire_date, '%d/%m/%Y')
    ELSE strptime(hire_date, '%m-%d-%y') END AS DATE), d) / CAST(30.44 AS DOUBLE), 1) AS tenure_months
FROM raw CROSS JOIN ref_day""")
def _(spark, d):
    return ingest.derive_months(dirty_dates(spark, d), as_of_date(spark, d))


@query("P11_constant_imputation", on_subjects("SELECT order_col, " + ", ".join(
    f"round(coalesce({c}, 0.0), 6) AS {c}" for c in ("login_freq_slope_30d", "training_completions_90d",
                                                      "performance_rating_delta", "team_size_change_pct")) + " FROM typed",
    DIRTY_SQL, TYPED_SQL))
def _(spark, d):
    cols = ["login_freq_slope_30d", "training_completions_90d", "performance_rating_delta", "team_size_change_pct"]
    return rounded(ingest.impute_constant(typed(spark, d, cols)))


@query("P12_median_imputation", on_subjects("SELECT order_col, " + ", ".join(
    f"round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM typed)), 6) AS {c}" for c in schema.FILL_MEDIAN)
    + " FROM typed", DIRTY_SQL, TYPED_SQL))
def _(spark, d):
    return rounded(ingest.impute_median(stage(typed(spark, d, schema.FILL_MEDIAN))).select(
        "order_col", *schema.FILL_MEDIAN))


@query("P13_mode_imputation", on_subjects("""
, m AS (SELECT department AS v FROM typed WHERE department IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, department LIMIT 1)
SELECT order_col, coalesce(department, (SELECT v FROM m)) AS department FROM typed""".lstrip(), DIRTY_SQL, TYPED_SQL)
    .replace("\n, m AS", ",\nm AS"))
def _(spark, d):
    return ingest.impute_mode(typed(spark, d, ["department"]))


_CAPS = ("tenure_months", "compa_ratio", "perf_rating_current", "months_since_hike", "manager_attrition_rate_6m")


@query("P14_winsorise", on_subjects("SELECT order_col, " + ", ".join(
    f"round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, (SELECT quantile_cont({c}, 0.01) FROM subjects)), "
    f"(SELECT quantile_cont({c}, 0.99) FROM subjects)) END, 6) AS {c}" for c in _CAPS) + " FROM subjects"))
def _(spark, d):
    return rounded(ingest.winsorise(stage(subjects(spark, d, ["order_col", *_CAPS])), _CAPS))


@query("P14_winsor_bounds", on_subjects("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(lo, 6) AS low, round(hi, 6) AS high, count(CASE WHEN {c} < lo THEN 1 END) AS n_low, "
    f"count(CASE WHEN {c} > hi THEN 1 END) AS n_high FROM subjects, (SELECT quantile_cont({c}, 0.01) AS lo, "
    f"quantile_cont({c}, 0.99) AS hi FROM subjects) GROUP BY lo, hi" for c in _CAPS)))
def _(spark, d):
    return rounded(ingest.winsor_bounds(stage(subjects(spark, d, _CAPS)), _CAPS))


_PEERS_SQL = """
peers AS (SELECT order_col, department, circle,
  CAST(coalesce(sum(attrition_flag) OVER (PARTITION BY department, circle), 0) - attrition_flag AS DOUBLE) AS peer_attrition_count_90d,
  count(*) OVER (PARTITION BY department, circle) AS n FROM subjects)"""


@query("P15_zero_small_groups", on_subjects("""
SELECT order_col, CASE WHEN n < 60 THEN 0.0 ELSE peer_attrition_count_90d END AS peer_attrition_count_90d FROM peers""",
                                            _PEERS_SQL))
@query("J4_small_group_mask", on_subjects("""
SELECT order_col, CASE WHEN n < 60 THEN 0.0 ELSE peer_attrition_count_90d END AS peer_attrition_count_90d FROM peers""",
                                          _PEERS_SQL))
def _(spark, d):
    base = peer_attrition(subjects(spark, d, ["order_col", "department", "circle", "attrition_flag"]))
    return ingest.zero_small_groups(base, min_size=60).select("order_col", "peer_attrition_count_90d")


@query("S9_audit_trail", on_subjects("\nUNION ALL\n".join([
    f"SELECT * FROM (SELECT 'nulls' AS step, '{c}' AS \"column\", 'null_token' AS action, "
    f"count(CASE WHEN {c} IS NOT NULL AND ({null_sql(c)}) IS NULL THEN 1 END) AS n_rows FROM dirty)"
    for c in ("department", "tenure_months", "compa_ratio")] + [
    f"SELECT * FROM (SELECT 'types' AS step, '{c}' AS \"column\", 'unparsed' AS action, "
    f"count(CASE WHEN ({null_sql(c)}) IS NOT NULL AND {parse_sql(null_sql(c))} IS NULL THEN 1 END) AS n_rows FROM dirty)"
    for c in ("tenure_months", "compa_ratio")] + [
    f"SELECT * FROM (SELECT 'impute' AS step, '{c}' AS \"column\", 'median' AS action, count(*) - count({c}) AS n_rows FROM typed)"
    for c in ("tenure_months", "compa_ratio")] + [
    f"SELECT * FROM (SELECT 'cap' AS step, '{c}' AS \"column\", 'winsorised' AS action, "
    f"count(CASE WHEN {c} < (SELECT quantile_cont({c}, 0.01) FROM typed) OR {c} > (SELECT quantile_cont({c}, 0.99) FROM typed) "
    f"THEN 1 END) AS n_rows FROM typed)" for c in ("tenure_months", "compa_ratio")]), DIRTY_SQL, TYPED_SQL))
def _(spark, d):
    raw = stage(dirty_subjects(spark, d, ["department", "tenure_months", "compa_ratio"])).drop("order_col")
    return ingest.audit_trail(raw).select("step", "column", "action", "n_rows")


@query("A5_unexpected_categories", on_subjects("""
SELECT CAST(band AS VARCHAR) AS value, count(*) AS n_rows FROM
  (SELECT CASE WHEN order_col % 11 = 0 THEN 9 WHEN order_col % 13 = 0 THEN NULL ELSE band END AS band FROM subjects)
WHERE band IS NULL OR band NOT IN (3,4,5,6,7) GROUP BY 1"""))
def _(spark, d):
    k = F.col("order_col")
    raw = subjects(spark, d, ["order_col", "band"]).withColumn(
        "band", F.when(k % 11 == 0, 9).when(k % 13 == 0, None).otherwise(F.col("band")))
    return ingest.unexpected_categories(raw)


@query("A18_schema_issues", on_subjects("""
SELECT 'CRITICAL' AS severity, c AS "column", 'missing' AS issue, CAST(NULL AS BIGINT) AS n
  FROM (VALUES ('circle'), ('months_since_promotion'), ('months_since_hike'), ('perf_rating_current'), ('login_freq_30d')) t(c)
UNION ALL SELECT 'WARNING', 'band', 'nulls', count(*) FROM subjects WHERE order_col % 13 = 0
UNION ALL SELECT * FROM (SELECT 'WARNING', 'tenure_months', 'nulls', count(*) AS n FROM subjects WHERE tenure_months IS NULL) WHERE n > 0
UNION ALL SELECT 'WARNING', 'attrition_flag', 'non_binary', count(*) FROM subjects WHERE order_col % 17 = 0"""))
def _(spark, d):
    k = F.col("order_col")
    raw = subjects(spark, d, ["order_col", "employee_id", "band", "department", "tenure_months", "compa_ratio",
                              "attrition_flag"])
    raw = raw.withColumns({"band": F.when(k % 13 != 0, F.col("band")),
                           "attrition_flag": F.when(k % 17 == 0, 2).otherwise(F.col("attrition_flag"))})
    return ingest.schema_issues(raw)


@query("G5_bound_columns", on_subjects("""
SELECT order_col, round(CASE WHEN compa_ratio * 40 - 20 IS NOT NULL
  THEN least(greatest(compa_ratio * 40 - 20, 0.0), tenure_months) END, 6) AS months FROM subjects"""))
def _(spark, d):
    from retenta.operators.features import bound_columns
    raw = subjects(spark, d, ["order_col", "compa_ratio", "tenure_months"]).withColumn(
        "months", F.col("compa_ratio") * 40 - 20)
    return rounded(bound_columns(raw, ["months"]).select("order_col", "months"))


@query("G5_bound_violations", on_subjects("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(CASE WHEN {c} < 0 THEN 1 END) AS n_below, "
    f"count(CASE WHEN {c} > tenure_months THEN 1 END) AS n_above FROM subjects"
    for c in ("months_since_promotion", "months_since_hike", "hike_vs_band_median"))))
def _(spark, d):
    from retenta.operators.features import bound_violations
    cols = ["months_since_promotion", "months_since_hike", "hike_vs_band_median"]
    return bound_violations(subjects(spark, d, [*cols, "tenure_months"]), cols)
