"""Registered queries of the subpackage and the SQL each is checked against, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op5_bpe")
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from retenta.llm.bpe import encode
    rows = encode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                  public_tokenizers.PATTERN, decoded=True)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_pii")
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    from retenta.llm.pii import KINDS, find

    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return find(table(spark, folder, "documents")).select(
        "doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query("op8_quality")
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    from retenta.llm.quality import judge, labelled_sample, learn
    docs = table(spark, folder, "documents")
    rules = learn(labelled_sample(docs, table(spark, folder, "labels")))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                     "base_failed", "kept")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from retenta.llm.toxicity import fit, held_out, score, training_rows
    docs = table(spark, folder, "documents")
    machine = fit(training_rows(docs, table(spark, folder, "labels")))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score",
                                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_simhash")
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from retenta.llm.simhash import near_copies
    return near_copies(table(spark, folder, "documents"))


def _leaks_sql() -> str:
    """All windows of all items at all places, over words; no masks."""
    from retenta.llm.decontaminate import SAME, WINDOW

    def words(table_: str, key: str) -> str:
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        low = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
        return (f"SELECT {key}, len(words) AS size, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM (SELECT {key}, "
                f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {table_} WHERE {key} IS NOT NULL)")

    return f"""
WITH docs AS ({words("documents", "doc_id")}), items AS ({words("benchmark", "item_id")}),
lines AS (SELECT doc_id, item_id, d.p - i.p AS start, list(i.p) AS equal, any_value(d.size) AS there, any_value(i.size) AS size, least({WINDOW}, any_value(i.size)) AS n
          FROM docs d JOIN items i USING (w) WHERE i.size >= 3 GROUP BY ALL HAVING count(*) >= {SAME} * least({WINDOW}, any_value(i.size))),
places AS (SELECT doc_id, item_id, start, n, len(list_filter(equal, lambda e: e >= k AND e < k + n)) AS same
           FROM lines, unnest(range(greatest(0, -start), least(size, there - start) - n + 1)) AS t(k)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY same DESC, start) AS r FROM places WHERE same >= {SAME} * n)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(same AS INTEGER) AS n_same, CAST(n AS INTEGER) AS n_words FROM best WHERE r = 1"""


@query("op2_decontaminate", _leaks_sql())
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from retenta.llm.decontaminate import leaks
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_licenses")
def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    from retenta.llm.licenses import scan
    at = F.transform("places", lambda x: x["at"].cast("bigint"))
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    more = F.transform("stretches", lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("stretches", lambda x: x["cover"])), F.lit(0.0))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.least(F.lit(1.0), best))
    return scan(table(spark, folder, "documents")).select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"), score.alias("score"))


@query("op10_urls")
def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    from retenta.llm.url_filter import Rule, judge
    rules = (Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
             Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
    return judge(table(spark, folder, "pages"), rules).drop("ratio")


@query("op6_secrets")
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from retenta.llm.secret_scan import labelled_findings, scan, train
    return scan(table(spark, folder, "documents"), train(labelled_findings(spark)))


@query("op9_substrings", r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM texts, unnest(range(1, len(words) - 11)) AS t(i)),
firsts AS (SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w),
gone AS (SELECT DISTINCT doc_id, p FROM windows JOIN firsts USING (w), unnest(range(i, i + 13)) AS t(p) WHERE first_doc < doc_id),
placed AS (SELECT doc_id, p, words[p] AS word FROM texts, unnest(range(1, len(words) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY placed.p) FILTER (gone.p IS NULL) AS kept
         FROM placed LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)""")
def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    from retenta.llm.substrings import without_repeats
    return without_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op11_pieces")
def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from retenta.llm.pieces import encode
    rows = encode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")


@query("op13_alignment")
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from retenta.llm.alignment import align
    return align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"), digest=True).withColumnRenamed("groups", "groups_sha256")


@query("op12_collocations", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
known AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
          FROM split, unnest(range(1, 5)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, f AS a FROM known WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS BIGINT) AS score
         FROM (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS tail
               FROM candidates, unnest(range(1, size)) AS t(k)) c
         JOIN known x ON x.lang = c.lang AND x.phrase = c.head JOIN known y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around
                  FROM candidates, unnest(range(2, size)) AS s(m), unnest(range(1, size - m + 2)) AS t(i) GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN inner_phrases i USING (lang, phrase) WHERE i.around IS NULL OR 100 * CAST(i.around AS HUGEINT) < 80 * l.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM
    (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000""")
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from retenta.llm.collocations import collocations
    return collocations(table(spark, folder, "documents"))
