"""From a raw extract of text columns to the canonical subject table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from retenta import schema
from retenta.functions import text
from retenta.functions.numeric import clamp
from retenta.functions.similarity import best_levenshtein, best_match
from retenta.operators.grouping import attach_group_stats, stat_rows
from retenta.operators.ordering import exact_quantiles, quantile_map

FUZZY_THRESHOLD = 80.0
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM-dd-yy")
AUDIT_SCHEMA = "step string, column string, action string, n_rows bigint, detail string"


# --------------------------------------------------------------- names
def clean_column_names(df: DataFrame) -> DataFrame:
    """Snake-case headers; a name that would repeat gets a numeric suffix."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = text.normalise_header(raw)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def renamed_headers(before: DataFrame, after: DataFrame) -> list[tuple[str, str]]:
    return [(a, b) for a, b in zip(before.columns, after.columns) if a != b]


def match_names(names: DataFrame, column: str = "raw", threshold: float = FUZZY_THRESHOLD,
                method: str = "indel", canonical: Sequence[str] = schema.CANONICAL_NAMES,
                aliases: dict[str, str] | None = None, reserved: Iterable[str] = ()) -> DataFrame:
    """Resolve each name to a canonical one: exact, then alias, then the most similar at or above the threshold.

    Returns ``(raw, target, method, score, nearest)``; unresolved names keep a null target and their nearest
    candidate, resolved ones by the dictionary are their own. The dictionary is a closed list held as literals, so each
    distinct name is resolved in place, without pairing names and candidates in a join; only names that are neither exact
    nor an alias are compared. ``reserved`` names are never matched by similarity.
    """
    aliases = schema.ALIAS_TO_CANONICAL if aliases is None else aliases
    pool = [*canonical, *[a for a in aliases if a not in canonical]]
    raw = F.col(column)
    exact = F.when(raw.isin(*canonical), raw)
    alias = text.literal_map(aliases)[raw] if aliases else F.lit(None).cast("string")
    asked = F.when(F.coalesce(exact, alias).isNull(), raw)
    best = best_match(asked, pool) if method == "indel" else best_levenshtein(asked, pool)
    to_canonical = text.literal_map({**{c: c for c in canonical},
                                     **{a: t for a, t in aliases.items() if a not in canonical}})
    scored = (names.select(column).distinct()
              .withColumn("__exact", exact).withColumn("__alias", alias).withColumn("__best", best))
    known = F.coalesce("__exact", "__alias")
    fuzzy = F.when((F.col("__best.score") >= threshold) & ~raw.isin(*reserved) if reserved
                   else F.col("__best.score") >= threshold, to_canonical[F.col("__best.candidate")])
    return scored.select(
        raw.alias("raw"),
        F.coalesce(known, fuzzy).alias("target"),
        F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__alias").isNotNull(), "alias")
         .when(fuzzy.isNotNull(), "fuzzy").otherwise("unmapped").alias("method"),
        F.when(known.isNotNull(), F.lit(100.0)).otherwise(F.col("__best.score")).alias("score"),
        F.coalesce("__best.candidate", F.when(known.isNotNull(), raw)).alias("nearest"),
    )


def map_columns(df: DataFrame, keep: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rename the columns of ``df`` to canonical names and drop the rest; also return the resolution table.

    When several headers resolve to one name, the better method, then the higher score, then the earlier header
    wins. Date headers that feed an elapsed-month column stay as they are.
    """
    spark = df.sparkSession
    reserved = set(schema.DATE_TARGETS) | set(keep)
    names = spark.createDataFrame([(c,) for c in df.columns], "raw string")
    resolved = match_names(names, reserved=sorted(reserved))
    order = {"exact": 0, "alias": 1, "fuzzy": 2}
    chosen: dict[str, str] = {}
    # One row per header of the file.
    rows = sorted((r for r in resolved.collect() if r["target"]),
                  key=lambda r: (order[r["method"]], -r["score"], df.columns.index(r["raw"])))
    for r in rows:
        chosen.setdefault(r["target"], r["raw"])
    sources = {raw: target for target, raw in chosen.items()}
    out = [F.col(f"`{c}`").alias(sources.get(c, c)) for c in df.columns
           if c in sources or (c in reserved and c not in sources)]
    return df.select(*out), resolved


# --------------------------------------------------------------- values
def normalise_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = [c for c, t in df.dtypes if t == "string"] if columns is None else columns
    return df.withColumns({c: text.null_tokens(F.col(c)) for c in columns})


def _numeric_columns(df: DataFrame) -> list[str]:
    numeric = {r.name for r in schema.CANONICAL if r.dtype in ("int", "float") and r.name != "attrition_flag"}
    return [c for c in df.columns if c in numeric]


def coerce_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns parsed, label to 0/1, gender to M/F."""
    columns = _numeric_columns(df) if columns is None else columns
    types = dict(df.dtypes)
    parsed = {c: text.parse_number(F.col(c)) if types[c] == "string" else F.col(c).cast("double") for c in columns}
    if "attrition_flag" in df.columns:
        parsed["attrition_flag"] = text.parse_label(F.col("attrition_flag"))
    if "gender" in df.columns:
        parsed["gender"] = text.parse_gender(F.col("gender"))
    return df.withColumns(parsed)


def coercion_losses(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: values present, and values that parsing would turn into null. One aggregate."""
    columns = _numeric_columns(df) if columns is None else columns
    return stat_rows(df, columns, lambda c: {
        "n_present": F.count(F.col(c)),
        "n_lost": F.count_if(F.col(c).isNotNull() & text.parse_number(F.col(c)).isNull()),
    })


def label_rejects(df: DataFrame, column: str = "attrition_flag") -> DataFrame:
    """``(value, n_rejected)``: texts that are no spelling of a binary label, as they stand, and how many rows have them."""
    unknown = F.col(column).isNotNull() & text.parse_label(F.col(column)).isNull()
    return df.filter(unknown).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n_rejected"))


def rescale_percent(df: DataFrame, column: str = "compa_ratio", above: float = 5.0) -> DataFrame:
    """Divide the whole column by 100 when its median shows that it was stored as a percentage."""
    median = quantile_map(df, [column], [0.5])[column][0]
    return (df.withColumn("__m", median)
            .withColumn(column, F.when(F.col("__m") > above, F.col(column) / 100).otherwise(F.col(column))).drop("__m"))


def parse_date(value: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that reads the text. Ambiguous texts follow the order of ``formats``; two-digit years from 69 on
    belong to the last century."""
    def one(fmt: str) -> Column:
        day = F.try_to_date(value, fmt)
        return day if "yyyy" in fmt else F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)

    return F.coalesce(*[one(f) for f in formats])


def elapsed_months(day: Column, as_of: Column) -> Column:
    return F.bround(F.datediff(as_of, day) / F.lit(schema.DAYS_PER_MONTH), 1)


def derive_months(df: DataFrame, as_of: Column, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Fill elapsed-month columns from date columns unless more than half of the target is already present."""
    sources = [c for c in schema.DATE_TARGETS if c in df.columns]
    for c in sources:
        target = schema.DATE_TARGETS[c]
        months = elapsed_months(parse_date(F.col(c), formats), as_of)
        if target in df.columns:
            present = df.agg(F.count(target) > 0.5 * F.count("*")).scalar()
            months = F.when(present, F.col(target).cast("double")).otherwise(months)
        df = df.withColumn(target, months)
    return df.drop(*sources)


# --------------------------------------------------------------- imputation
def mode_map(df: DataFrame, columns: Sequence[str]) -> Column:
    """Most frequent value per column as text; the smallest wins a tie. Counts are combined map-side."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = long.dropna().groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("value").try_cast("double").alias("num"), "value")).alias("b"))
    return best.agg(F.map_from_entries(F.collect_list(F.struct("column", "b.value")))).scalar()


def impute_constant(df: DataFrame, values: dict[str, float] = schema.FILL_CONSTANT) -> DataFrame:
    return df.na.fill({c: v for c, v in values.items() if c in df.columns})


def impute_median(df: DataFrame, columns: Sequence[str] = schema.FILL_MEDIAN) -> DataFrame:
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    medians = F.col("__medians")
    return (df.withColumn("__medians", quantile_map(df, columns, [0.5]))
            .withColumns({c: F.coalesce(F.col(c), medians[c][0]) for c in columns}).drop("__medians"))


def impute_mode(df: DataFrame, columns: Sequence[str] = schema.FILL_MODE) -> DataFrame:
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    modes = F.col("__modes")
    types = dict(df.dtypes)

    def fill(c: str) -> Column:
        value = modes[c] if types[c] == "string" else modes[c].try_cast(types[c])
        last = [F.lit("Unknown")] if types[c] == "string" else []
        return F.coalesce(F.col(c), value, *last)

    return (df.withColumn("__modes", mode_map(df, columns)).withColumns({c: fill(c) for c in columns})
            .drop("__modes"))


# --------------------------------------------------------------- outliers, small groups
def winsor_bounds(df: DataFrame, columns: Sequence[str] = schema.CAP_COLUMNS, low: float = 0.01,
                  high: float = 0.99) -> DataFrame:
    """Per column: bounds and the number of values strictly outside them."""
    columns = [c for c in columns if c in df.columns]
    bounds = F.col("__bounds")
    return stat_rows(df.withColumn("__bounds", quantile_map(df, columns, [low, high])), columns, lambda c: {
        "low": F.first(bounds[c][0]), "high": F.first(bounds[c][1]),
        "n_low": F.count_if(F.col(c) < bounds[c][0]), "n_high": F.count_if(F.col(c) > bounds[c][1]),
    })


def winsorise(df: DataFrame, columns: Sequence[str] = schema.CAP_COLUMNS, low: float = 0.01, high: float = 0.99,
              approximate: bool = False) -> DataFrame:
    """Limit columns to their percentiles; ``approximate`` trades exact bounds for a single sketch pass."""
    columns = [c for c in columns if c in df.columns]
    if approximate:
        bounds = df.agg(*[F.percentile_approx(c, [low, high]).alias(c) for c in columns])
        bound = bounds.select(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("array<double>"))]))
        m = bound.scalar()
    else:
        m = quantile_map(df, columns, [low, high])
    bounds = F.col("__bounds")
    return (df.withColumn("__bounds", m)
            .withColumns({c: clamp(F.col(c), bounds[c][0], bounds[c][1]) for c in columns}).drop("__bounds"))


def zero_small_groups(df: DataFrame, measure: str = "peer_attrition_count_90d",
                      keys: Sequence[str] = ("department", "circle"), min_size: int = 5) -> DataFrame:
    """Set ``measure`` to zero in groups below ``min_size``; rows with a null key keep their value."""
    sized = attach_group_stats(df, keys, {"__n": F.count("*")})
    return sized.withColumn(measure, F.when(F.col("__n") < min_size, F.lit(0.0)).otherwise(F.col(measure))).drop("__n")


# --------------------------------------------------------------- audit and final check
def unexpected_categories(df: DataFrame, column: str = "band", allowed: Sequence = schema.BANDS) -> DataFrame:
    """Distinct values outside the allowed list, null included, with their row counts."""
    bad = F.col(column).isNull() | ~F.col(column).isin(*allowed)
    return df.filter(bad).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n_rows"))


def schema_issues(df: DataFrame, rules: Sequence[schema.Rule] = schema.CANONICAL) -> DataFrame:
    """Missing required columns, nulls where none may be, and non-binary labels: ``(severity, column, issue, n)``."""
    spark = df.sparkSession
    present = set(df.columns)
    missing = [("CRITICAL", r.name, "missing", None) for r in rules if r.required and r.name not in present]
    out = spark.createDataFrame(missing, "severity string, column string, issue string, n bigint")
    strict = [r.name for r in rules if r.name in present and not r.nullable]
    if strict:
        nulls = stat_rows(df, strict, lambda c: {"n": F.count_if(F.col(c).isNull())}).filter("n > 0")
        out = out.unionByName(nulls.select(F.lit("WARNING").alias("severity"), "column",
                                           F.lit("nulls").alias("issue"), "n"))
    if "attrition_flag" in present:
        bad = df.agg(F.count_if(~F.col("attrition_flag").cast("double").isin(0.0, 1.0)).alias("n")).filter("n > 0")
        out = out.unionByName(bad.select(F.lit("WARNING").alias("severity"), F.lit("attrition_flag").alias("column"),
                                         F.lit("non_binary").alias("issue"), "n"))
    return out


def audit_trail(raw: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """What cleaning does to ``raw`` (canonical names, text values): ``(step, column, action, n_rows, detail)``.

    One aggregate covers null tokens and parse losses of every column; a second one the winsorising bounds.
    """
    numeric = _numeric_columns(raw)
    nulled = normalise_nulls(raw)
    tokens = stat_rows(raw, raw.columns, lambda c: {
        "n_rows": F.count_if(F.col(c).isNotNull() & text.null_tokens(F.col(c)).isNull())})
    losses = coercion_losses(nulled, numeric)
    typed = coerce_types(nulled)
    capped = winsor_bounds(typed, [c for c in schema.CAP_COLUMNS if c in numeric])
    medians = exact_quantiles(typed, [c for c in schema.FILL_MEDIAN if c in numeric], [0.5])
    nulls = stat_rows(typed, [c for c in schema.FILL_MEDIAN if c in numeric],
                      lambda c: {"n_rows": F.count_if(F.col(c).isNull())})

    def rows(src: DataFrame, step: str, action: str, n: Column, detail: Column) -> DataFrame:
        return src.select(F.lit(step).alias("step"), "column", F.lit(action).alias("action"),
                          n.cast("bigint").alias("n_rows"), detail.cast("string").alias("detail"))

    none = F.lit(None)
    out = (
        rows(tokens, "nulls", "null_token", F.col("n_rows"), none)
        .unionByName(rows(losses, "types", "unparsed", F.col("n_lost"), none))
        .unionByName(rows(nulls.join(medians, "column"), "impute", "median", F.col("n_rows"),
                          F.format_string("%.4f", F.col("q")[0])))
        .unionByName(rows(capped, "cap", "winsorised", F.col("n_low") + F.col("n_high"),
                          F.format_string("[%.4f, %.4f]", F.col("low"), F.col("high"))))
        .filter("n_rows > 0")
    )
    if resolved is not None:
        out = out.unionByName(resolved.select(
            F.lit("map").alias("step"), F.col("raw").alias("column"), F.col("method").alias("action"),
            F.lit(None).cast("bigint").alias("n_rows"), F.coalesce("target", "nearest").alias("detail")))
    return out
