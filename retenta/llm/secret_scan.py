"""Secret scans in native expressions: broad candidates, then a random forest that removes false findings."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LEAST = 12
# Words that announce a secret, words that announce something else, openings of known keys, and word parts.
ANNOUNCE = r"(?i)pass(word|wd|phrase)?|pwd|secret|token|api_?key|access|private|credential|auth|bearer"
OTHERWISE = r"(?i)commit|sha|hash|checksum|digest|uuid|guid|version|order|isbn|invoice|card|file|page|url|http|mail|phone|ref"
OPENINGS = r"^(AKIA|ASIA|ghp_|gho_|sk_live_|sk_test_|xox[bp]-|glpat-|AIza|eyJ)"
SAMPLE_PATHS = r"(?i)test|example|sample|fixture|mock|demo|docs?/"
PARTS = ("example", "sample", "test", "report", "final", "image", "photo", "index", "version", "file", "page", "data", "user",
         "name", "item", "list", "the", "tion", "ing", "ment", "able", "and", "for", "ent", "ion", "est", "com", "www", "html")
FEATURES = ("length", "digit_share", "upper_share", "lower_share", "mark_share", "transition_share", "distinct_share",
            "vowel_share", "dictionary_share", "only_hex", "only_digits", "dotted", "uuid", "opening", "announced", "otherwise",
            "sample_path")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``doc_id``, ``path``, ``at`` (word of the text, from 0), ``candidate``, ``before`` and ``after`` of every long word with
    a digit. Words are split at ASCII white space; a key name before ``=`` or ``:`` counts as a word before.

    Null texts have no candidates, a null path counts as empty, null ids and repeated rows stay, each row for itself.
    """
    words = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")).alias("path"),
                        F.filter(F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"),
                                 lambda w: w != "").alias("words"))
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))

    def near(i: Column, k: int) -> Column:
        return F.coalesce(F.when(i + k >= 0, F.get("words", i + k)), F.lit(""))

    long_ = F.filter(places, lambda i: (F.length(F.get("words", i)) >= LEAST) & F.get("words", i).rlike("[0-9]"))
    rows = words.select("doc_id", "path", F.inline(F.transform(long_, lambda i: F.struct(
        i.alias("at"), F.get("words", i).alias("word"), F.concat_ws(" ", near(i, -2), near(i, -1)).alias("before"),
        near(i, 1).alias("after")))))
    key = F.regexp_extract("word", r"^([A-Za-z_.-]{2,40})[=:]", 1)
    body = F.regexp_replace(F.regexp_replace("word", r"^[A-Za-z_.-]{2,40}[=:]+", ""), r"^[\"'(\[{<]+|[\"')\]}>.,;:!?]+$", "")
    return rows.select("doc_id", "path", "at", body.alias("candidate"), F.concat_ws(" ", "before", key).alias("before"), "after") \
        .filter((F.length("candidate") >= LEAST) & F.col("candidate").rlike("[0-9]"))


def with_features(found: DataFrame) -> DataFrame:
    """Adds the columns of ``FEATURES`` to rows of ``candidate``, ``before``, ``after`` and ``path``."""
    text, n = F.col("candidate"), F.length("candidate")

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(text, pattern, ""))) / n

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    runs = F.length(F.regexp_replace(kinds, r"(?s)(.)\1*", "x"))
    values = {
        "length": F.least(n, F.lit(200)), "digit_share": share("[0-9]"), "upper_share": share("[A-Z]"), "lower_share": share("[a-z]"),
        "mark_share": share("[^A-Za-z0-9]"), "transition_share": (runs - 1) / n,
        "distinct_share": F.size(F.array_distinct(F.split(text, ""))) / n, "vowel_share": share("(?i)[aeiou]"),
        "dictionary_share": share("(?i)" + "|".join(sorted(PARTS, key=len, reverse=True))),
        "only_hex": text.rlike("^[0-9a-fA-F]+$"), "only_digits": text.rlike("^[0-9.,:/()+-]+$"), "dotted": text.rlike(r"[.@]|://"),
        "uuid": text.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), "opening": text.rlike(OPENINGS),
        "announced": F.col("before").rlike(ANNOUNCE), "otherwise": F.col("before").rlike(OTHERWISE) | F.col("after").rlike(OTHERWISE),
        "sample_path": F.col("path").rlike(SAMPLE_PATHS)}
    return found.select("*", *[values[f].cast("double").alias(f) for f in FEATURES])


def labelled_findings(spark: SparkSession, each: int = 40) -> DataFrame:
    """The labelled table: ``each`` findings of every kind below, with words around them and 1 for a secret.

    Letters of a finding come from hashes of its number, so that the table is the same on every run.
    """
    i = F.col("id")
    hexa, other = F.sha2(F.concat(F.lit("a"), i.cast("string")).cast("binary"), 256), F.sha2(F.concat(F.lit("b"), i.cast("string")).cast("binary"), 256)
    mixed = F.translate(F.base64(F.unhex(hexa)), "=", "")
    upper = F.translate(F.upper(hexa), "0189", "GKQX")
    number = F.translate(hexa, "abcdef", "493857")
    word = F.translate(hexa, "0123456789", "etaoinshrd")
    kinds = (
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), "the of", "and"), (1, F.substring(hexa, 1, 18), "is password", "and"),
        (1, F.substring(hexa, 1, 40), "token =", "in"), (1, F.substring(mixed, 1, 32), "my secret", "the"),
        (1, F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), "with the", "to"), (1, F.substring(mixed, 1, 24), "api_key :", "on"),
        (1, F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), "a of", "is"), (1, F.substring(mixed, 1, 20), "the pwd", "was"),
        (0, F.substring(hexa, 1, 40), "commit id", "by"), (0, F.substring(hexa, 1, 32), "sha checksum", "of"),
        (0, F.concat_ws("-", F.substring(hexa, 1, 8), F.substring(hexa, 9, 4), F.substring(hexa, 13, 4), F.substring(hexa, 17, 4), F.substring(other, 1, 12)), "the uuid", "is"),
        (0, F.substring(number, 1, 16), "the on", "at"), (0, F.concat_ws(".", F.substring(number, 1, 3), F.substring(number, 4, 3), F.substring(number, 7, 3), F.substring(number, 10, 2)), "in a", "the"),
        (0, F.concat(F.substring(word, 1, 5), F.lit("."), F.substring(number, 1, 2), F.lit("@mail"), F.substring(number, 3, 1), F.lit(".example.com")), "of it", "and"),
        (0, F.concat(F.lit("https://www."), F.substring(word, 1, 7), F.lit(".com/en/"), F.substring(number, 1, 4), F.lit(".html")), "see the", "for"),
        (0, F.concat(F.lit("report_"), F.substring(number, 1, 4), F.lit("_final.pdf")), "in file", "from"),
        (0, F.concat(F.substring(word, 1, 14), F.substring(number, 1, 1)), "was the", "that"),
        (0, F.concat(F.lit("20"), F.substring(number, 1, 2), F.lit("-0"), F.substring(number, 3, 1), F.lit("-1"), F.substring(number, 4, 1), F.lit("T00:00:00")), "on the", "at"),
        (0, F.substring(hexa, 1, 24), "the order", "of"))
    rows = [spark.range(each).select(value.alias("candidate"), F.lit(b).alias("before"), F.lit(a).alias("after"),
                                     F.when(i % 7 == 0, "tests/example.py" if not y else "app/settings.py").otherwise(F.concat(F.lit("src"), (i % 20).cast("string"))).alias("path"),
                                     F.lit(float(y)).alias("label")) for y, value, b, a in kinds]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def train(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 11) -> PipelineModel:
    """A random forest over the features of labelled findings (``candidate``, ``before``, ``after``, ``path``, ``label``)."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features")
    return PipelineModel([assembler, forest.fit(assembler.transform(with_features(findings)))])


def scan(docs: DataFrame, model: PipelineModel, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Every candidate as ``doc_id``, ``at``, ``candidate``, ``score`` (probability that it is a secret) and ``secret``."""
    scored = model.transform(with_features(candidates(docs, id_col, text_col, path_col)))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "at", "candidate", score.alias("score"), (score >= 0.5).alias("secret"))
