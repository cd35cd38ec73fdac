"""Quality rules: statistics of texts as native expressions, and a decision list learned from labelled statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 5
#: Statistics that conditions may use. All are ratios or counts of one text.
STATISTICS = ("n_words", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", "upper_ratio", "digit_ratio",
              "mark_ratio", "distinct_ratio", "lines_per_word")


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.name] >= self.value if self.at_least else row[self.name] < self.value

    def column(self) -> Column:
        return F.col(self.name) >= F.lit(self.value) if self.at_least else F.col(self.name) < F.lit(self.value)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(f"{c.name} {'>=' if c.at_least else '<'} {c.value:.6g}" for c in self.conditions)


def _with_repeated_words(texts: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in a window of five words found twice or more in the text, first one included.

    Windows are compared by their 64-bit hash. Most texts repeat none, which counting distinct hashes shows. For the
    others, windows are sorted by hash, those equal to a neighbour kept and their stretches added up, so that the work
    grows with n log n. Each step is a column of its own: inside a lambda an expression would run once per element.
    """
    n = F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    hashed = texts.withColumn("hashes", hashes)
    repeats = F.size("hashes") > F.size(F.array_distinct("hashes"))
    ordered = F.when(repeats, F.array_sort(F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.alias("at")))))
    sorted_ = hashed.withColumn("ordered", ordered).drop("hashes")
    twice = F.filter("ordered", lambda x, i: ((i > 0) & (F.get("ordered", i - 1)["h"] == x["h"]))
                     | F.coalesce(F.get("ordered", i + 1)["h"] == x["h"], F.lit(False)))
    at = sorted_.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["at"]))).drop("ordered")
    new = F.transform("at", lambda p, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get("at", i - 1))))
    total = F.aggregate(new, F.lit(0), lambda a, x: a + x)
    return at.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("bigint")).drop("at")


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: Column) -> DataFrame:
    """Kept columns, ``doc_id``, the counts of a text and the ratios made of them.

    Null texts count as empty and have no words; ratios of texts without words are 0. Repeated rows and null ids stay,
    other columns are not read, an empty table gives an empty result. Whole texts are counted, however long.
    """
    texts = docs.select(*keep, F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kept = texts.columns[:len(keep)]
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    parts = texts.select(*kept, "doc_id", "text", words.alias("words"), lines.alias("lines"))
    parts = _with_repeated_words(parts)

    def without(signs: str) -> Column:
        return F.length("text") - F.length(F.translate("text", signs, ""))

    counts = F.struct(
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        without("#*$%&|<>").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), "n_repeat_words",
        F.size(F.array_distinct("words")).alias("n_distinct"), F.size("lines").alias("n_lines"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), without("0123456789").alias("n_digits"),
        without(".,;:!?").alias("n_marks"))
    # A generator, not a projection: later filters on the counts stay above it and are not written into the lambdas.
    counted = parts.select(*kept, "doc_id", F.inline(F.array(counts)))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))

    return counted.select(
        *kept, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio("n_symbols", "n_words").alias("symbol_ratio"), ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"), ratio("word_chars", "n_words").alias("mean_word"),
        ratio("n_upper", "word_chars").alias("upper_ratio"), ratio("n_digits", "word_chars").alias("digit_ratio"),
        ratio("n_marks", "n_words").alias("mark_ratio"), ratio("n_distinct", "n_words").alias("distinct_ratio"),
        ratio("n_lines", "n_words").alias("lines_per_word"))


def base_failed() -> Column:
    """The fixed rule: fewer than ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = 6_000, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "quality") -> list[dict]:
    """Statistics and label of at most ``limit`` labelled documents, those first in the order of a hash of the id.

    Rows without an id or label are left out; of repeated labels of one document the smallest counts.
    """
    chosen = (labels.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
              .dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = texts.join(chosen, "doc_id").select("doc_id", "text", "label")
    rows = with_statistics(found).join(chosen, "doc_id").collect()
    return [r.asDict() for r in rows]


def _laplace(bad: int, all_: int) -> float:
    return (bad + 1) / (all_ + 2)


def learn(rows: list[dict], min_precision: float = 0.9, min_cover: int = 5, max_rules: int = 12,
          max_conditions: int = 3) -> list[Rule]:
    """An ordered list of rules for label 0, by sequential covering.

    Rows are mixed by a hash of their id. Two thirds of them grow a rule, condition by condition, by the information it gains; the rest prunes it from
    the end while its precision there does not fall. Rules below ``min_precision`` over all remaining rows end the
    search; rows that a rule covers are taken out before the next.
    """
    import math
    import zlib
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["label"]))
    left = list(rows)
    out: list[Rule] = []
    while len(out) < max_rules and any(r["label"] == 0 for r in left):
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        conditions: list[Condition] = []
        inside = grow
        while len(conditions) < max_conditions and any(r["label"] for r in inside):
            bad, size = sum(r["label"] == 0 for r in inside), len(inside)
            best, chosen = 0.0, None
            for name in STATISTICS:
                order = sorted((r[name], r["label"]) for r in inside)
                below = 0
                for i in range(1, size):
                    below += order[i - 1][1] == 0
                    if order[i][0] == order[i - 1][0]:
                        continue
                    for at_least, b, n in ((True, bad - below, size - i), (False, below, i)):
                        if b < min_cover:
                            continue
                        gain = b * (math.log2(_laplace(b, n)) - math.log2(_laplace(bad, size)))
                        if gain > best + 1e-9:
                            best, chosen = gain, Condition(name, at_least, (order[i][0] + order[i - 1][0]) / 2)
            if chosen is None:
                break
            conditions.append(chosen)
            inside = [r for r in inside if chosen.holds(r)]
        while len(conditions) > 1:
            def precision(cs, among):
                hit = [r for r in among if all(c.holds(r) for c in cs)]
                return _laplace(sum(r["label"] == 0 for r in hit), len(hit))
            if precision(conditions[:-1], prune) < precision(conditions, prune):
                break
            conditions.pop()
        if not conditions:
            break
        rule = Rule(tuple(conditions))
        hit = [r for r in left if rule.holds(r)]
        bad = sum(r["label"] == 0 for r in hit)
        if bad < min_cover or bad / len(hit) < min_precision:
            break
        out.append(rule)
        left = [r for r in left if not rule.holds(r)]
    return out


def rejected_by(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, counted from 1, as one conditional expression; null if none does."""
    number = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        number = F.when(rules[i - 1].column(), F.lit(i)).otherwise(number)
    return number


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", *keep: Column) -> DataFrame:
    """Kept columns and statistics with ``base_failed``, ``rule`` (number of the learned rule, else null) and ``kept``."""
    rows = with_statistics(docs, id_col, text_col, *keep).withColumn("base_failed", base_failed())
    rows = rows.withColumn("rule", rejected_by(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def accepted(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return judge(docs, rules, id_col, text_col, row).filter("kept").select("row.*")
