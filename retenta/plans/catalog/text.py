"""Driver labels, routing, message texts, chunks and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from retenta import schema
from retenta.functions.arrays import cosine, top_drivers
from retenta.operators import explain, retrieval
from retenta.operators.ordering import top_k
from retenta.plans.catalog import on_subjects, query, rounded
from retenta.plans.features import FEATURE_SQL, PEERS_SQL, subject_base
from retenta.plans.scored import SCORED_SQL, rule_scored
from retenta.plans.subjects import table
from retenta.session import stage

# --------------------------------------------------------------- drivers from a fixed linear rule over features
_RULE = {"org_manager_attrition": 2.9, "trend_performance": -0.8, "interact_high_performer_no_promo": 0.9,
         "comp_compa_ratio": -1.2, "volatility_performance": 0.4, "band": 0.01}
_RULE_FEATURES = tuple(_RULE)
_DRIVERS_SQL = ("raw AS (" + " UNION ALL ".join(
    f"SELECT employee_id, {i} AS pos, '{c}' AS feature, coalesce({FEATURE_SQL.get(c, c)}, 0) * CAST({w} AS DOUBLE) AS v FROM based"
    for i, (c, w) in enumerate(_RULE.items())) + """),
drivers AS (SELECT employee_id, feature, round_even(v, 4) AS shap, row_number() OVER (PARTITION BY employee_id
  ORDER BY abs(v) DESC, pos) AS rank FROM raw QUALIFY rank <= 3),
labels_of(feature, label) AS (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in schema.DRIVER_LABELS.items())
                + "),\nqueries_of(feature, query) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in schema.DRIVER_QUERIES.items()) + ")")


def drivers_of(spark, d):
    """The three strongest rule terms of every subject as its drivers."""
    from retenta.operators.features import feature_columns
    base = subject_base(spark, d)
    exprs = feature_columns(base.columns)
    phi = [(c, F.coalesce(exprs.get(c, F.col(c)).cast("double"), F.lit(0.0)) * w) for c, w in _RULE.items()]
    return base.select("employee_id", *[c.alias(n) for n, c in phi]).select(
        "employee_id", top_drivers([(n, F.col(n)) for n, _ in phi]).alias("top_shap_drivers"))


def driven(spark, d):
    """Rule-scored subjects with their drivers."""
    return rule_scored(spark, d).join(drivers_of(spark, d), "employee_id")


@query("J7_driver_labels", on_subjects("""
SELECT employee_id, CAST(rank AS INTEGER) AS rank, d.feature AS feature, coalesce(label, replace(d.feature, '_', ' ')) AS label,
  CASE WHEN shap > 0 THEN 'RISK FACTOR' ELSE 'PROTECTIVE' END AS direction FROM drivers d LEFT JOIN labels_of l ON d.feature = l.feature""",
                                       PEERS_SQL, _DRIVERS_SQL))
@query("E4_driver_labelling", on_subjects("""
SELECT employee_id, CAST(rank AS INTEGER) AS rank, d.feature AS feature, coalesce(label, replace(d.feature, '_', ' ')) AS label,
  CASE WHEN shap > 0 THEN 'RISK FACTOR' ELSE 'PROTECTIVE' END AS direction FROM drivers d LEFT JOIN labels_of l ON d.feature = l.feature""",
                                          PEERS_SQL, _DRIVERS_SQL))
def _(spark, d):
    out = explain.with_driver_labels(drivers_of(spark, d))
    return out.select("employee_id", F.posexplode("shap_drivers").alias("r", "x")).select(
        "employee_id", (F.col("r") + 1).alias("rank"), "x.feature", "x.label", "x.direction")


_WANTED = "w AS (SELECT employee_id, rank, d.feature, coalesce(query, replace(d.feature, '_', ' ')) AS query FROM drivers d LEFT JOIN queries_of q ON d.feature = q.feature WHERE shap > 0)"


@query("T4_driver_queries", on_subjects("SELECT employee_id, feature, query FROM w", PEERS_SQL, _DRIVERS_SQL, _WANTED))
@query("J8_query_lookup", on_subjects("SELECT employee_id, feature, query FROM w", PEERS_SQL, _DRIVERS_SQL, _WANTED))
def _(spark, d):
    out = drivers_of(spark, d).select("employee_id", F.explode(retrieval.select_queries(F.col("top_shap_drivers"))).alias("q"))
    return out.select("employee_id", "q.feature", "q.query")


@query("W8_positive_drivers", on_subjects("SELECT employee_id, count(*) AS n FROM drivers WHERE shap > 0 GROUP BY 1",
                                          PEERS_SQL, _DRIVERS_SQL))
def _(spark, d):
    n = F.size(F.filter("top_shap_drivers", lambda x: x["shap"] > 0)).cast("bigint")
    return drivers_of(spark, d).select("employee_id", n.alias("n")).filter("n > 0")


_ROUTE_SQL = """CASE WHEN order_col % 50 = 0 THEN 'ERROR_LOG' WHEN risk_tier = 'CRITICAL' THEN 'SLACK_ALERT'
  WHEN risk_tier = 'HIGH' THEN 'WEEKLY_DIGEST' WHEN risk_tier = 'MEDIUM' THEN 'MANAGER_AWARENESS' ELSE 'AUDIT_LOG_ONLY' END"""


@query("E5_routing", on_subjects(f"SELECT employee_id, {_ROUTE_SQL} AS routed_to FROM scored", SCORED_SQL))
def _(spark, d):
    s = rule_scored(spark, d).withColumn("error", F.when(F.col("order_col") % 50 == 0, "unreadable row"))
    return explain.with_route(s).select("employee_id", "routed_to")


@query("E6_batch_run", on_subjects(f"""
SELECT employee_id, {_ROUTE_SQL} AS routed_to, CASE WHEN order_col % 50 = 0 THEN 'driver list could not be read' END AS error
FROM scored WHERE risk_tier IN ('CRITICAL', 'HIGH', 'MEDIUM')""", SCORED_SQL))
def _(spark, d):
    s = rule_scored(spark, d)
    text = F.when(F.col("order_col") % 50 == 0, "not json").otherwise(
        F.to_json(F.array(F.struct(F.lit("trend_login").alias("feature"), F.col("p_attrition").alias("shap")))))
    return explain.run_batch(s.withColumn("top_shap_drivers", text), None, ("CRITICAL", "HIGH", "MEDIUM")).select(
        "employee_id", "routed_to", "error")


@query("P16_reply_parse", """
WITH replies AS (SELECT conv_id, turn, replace(replace(replace(text, '\\', ''), '"', ''), '`', '') AS body FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 4 = 3 THEN body ELSE regexp_replace(body, '[\\x00-\\x1f]', ' ', 'g') END AS narrative,
  CASE WHEN conv_id % 4 = 3 THEN 'ASAP' ELSE 'week ' || turn END AS timeline FROM replies""")
def _(spark, d):
    body = F.regexp_replace("text", r'[\\"`]', "")
    clean = F.regexp_replace(body, r"[\x00-\x1f]", " ")
    doc = F.concat(F.lit('{"narrative": "'), clean, F.lit('", "timeline": "week '), F.col("turn").cast("string"), F.lit('"}'))
    k = F.col("conv_id") % 4
    reply = (F.when(k == 0, F.concat(F.lit("Here it is\n```json\n"), doc, F.lit("\n```\nDone")))
             .when(k == 1, F.concat(F.lit("```\n"), doc, F.lit("\n```"))).when(k == 2, doc).otherwise(body))
    parsed = table(spark, d, "conversations").select("conv_id", "turn", explain.parse_reply(reply).alias("r"))
    return parsed.select("conv_id", "turn", "r.narrative", "r.timeline")


@query("P17_alert_payload", on_subjects("""
SELECT employee_id, department || ', ' || circle || ', band ' || band || ': *' || employee_id || '*' || chr(10)
  || 'Likely to leave: *' || printf('%.2f', round_even(p_attrition, 1)) || '*, value of acting: *Rs ' || format('{:,}', CAST(ev AS BIGINT)) || '*'
  || chr(10) || chr(10) || '*Main drivers*' || chr(10) || bullets || chr(10) || chr(10) || '*Advice*' || chr(10)
  || 'No advice yet' || chr(10) || chr(10) || '*Next steps*' || chr(10) AS body
FROM scored JOIN (SELECT employee_id AS id, string_agg('- ' || coalesce(label, replace(d.feature, '_', ' ')), chr(10) ORDER BY rank) AS bullets
  FROM drivers d LEFT JOIN labels_of l ON d.feature = l.feature GROUP BY 1) ON id = employee_id WHERE risk_tier = 'CRITICAL'""",
                                        PEERS_SQL, _DRIVERS_SQL, SCORED_SQL))
def _(spark, d):
    s = driven(spark, d).filter("risk_tier = 'CRITICAL'").withColumn("p_attrition", F.bround("p_attrition", 1))
    out = explain.alert_payload(explain.with_driver_labels(s))
    return out.select("employee_id", F.get_json_object("payload", "$.blocks[0].text.text").alias("body"))


@query("P18_request_text", on_subjects("""
SELECT employee_id, string_agg('- ' || coalesce(label, replace(d.feature, '_', ' ')) || ' (weight '
  || CASE WHEN shap >= 0 THEN '+' ELSE '-' END || printf('%.3f', round_even(abs(shap), 1)) || ') — '
  || CASE WHEN shap > 0 THEN 'RISK FACTOR' ELSE 'PROTECTIVE' END, chr(10) ORDER BY rank) AS lines
FROM drivers d LEFT JOIN labels_of l ON d.feature = l.feature GROUP BY 1""", PEERS_SQL, _DRIVERS_SQL))
def _(spark, d):
    rough = F.transform("top_shap_drivers", lambda x: F.struct(x["feature"].alias("feature"), x["shap"].alias("shap")))
    s = explain.with_driver_labels(driven(spark, d).withColumn("top_shap_drivers", rough))
    tidy = F.transform("shap_drivers", lambda x: F.struct(
        x["label"].alias("label"), (F.signum(x["shap"]) * F.bround(F.abs(x["shap"]), 1)).alias("shap"),
        x["direction"].alias("direction")))
    asked = s.withColumn("shap_drivers", tidy).withColumn("request", explain.request_text(
        F.col("p_attrition"), F.col("shap_drivers"), F.lit(schema.NO_CONTEXT)))
    lines = F.regexp_extract("request", r"(?s)Main drivers:\n(.*?)\n\nPassages:", 1)
    return asked.select("employee_id", lines.alias("lines"))


# --------------------------------------------------------------- chunks
_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\p{{Z}}\x1c-\x1f\x85]+', ''), '[\s\p{{Z}}\x1c-\x1f\x85]+$', '')"
_CHUNKS = f"""
WITH body AS (SELECT CAST(doc_id AS VARCHAR) AS source, {_STRIP.format("replace(text, chr(0), '')")} AS b FROM documents),
win AS (SELECT source, s, {_STRIP.format("substr(b, CAST(s AS INTEGER), 300)")} AS content FROM (
  SELECT source, b, unnest(range(1, length(b) + 1, 250)) AS s FROM body)),
chunks AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY s) - 1 AS INTEGER) AS chunk_idx,
  CAST(count(*) OVER (PARTITION BY source) AS INTEGER) AS total_chunks, content FROM win WHERE length(content) > 30)"""


@query("T1_chunks", _CHUNKS + " SELECT * FROM chunks")
def _(spark, d):
    return retrieval.chunk_documents(table(spark, d, "documents"), "doc_id", "text").drop("id")


@query("T2_chunk_ids", _CHUNKS + """
SELECT source || '_' || chunk_idx || '_' || substr(sha256(source || chr(10) || chunk_idx || chr(10) || content), 1, 8) AS id, source, chunk_idx
FROM chunks""")
def _(spark, d):
    return retrieval.chunk_documents(table(spark, d, "documents"), "doc_id", "text").select("id", "source", "chunk_idx")


# --------------------------------------------------------------- nearest vectors: one mean vector per label as a query
_KNN = """
WITH dims AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM dims GROUP BY 1, 2),
q AS (SELECT label, list(m ORDER BY i) AS v FROM means GROUP BY 1),
sims AS (SELECT q.label AS query_label, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 12) AS similarity
  FROM q CROSS JOIN embeddings),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY similarity DESC, vec_id) AS rank FROM sims QUALIFY rank <= 5)"""


def _label_queries(spark, d):
    return retrieval.mean_vectors(table(spark, d, "embeddings"), "label").withColumnRenamed("label", "query_label")


_KNN_OUT = _KNN + " SELECT query_label, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM knn"


@query("T3_cosine_top_k", _KNN_OUT)
@query("J9_nearest_neighbours", _KNN_OUT)
def _(spark, d):
    return rounded(retrieval.nearest(_label_queries(spark, d), table(spark, d, "embeddings"), "query_label", "vec_id", 5))


@query("K2_deduplicated_hits", _KNN + """, firsts AS (SELECT vec_id, min(rank * 1000 + query_label) AS f FROM (
  SELECT vec_id, query_label, rank FROM knn) GROUP BY 1)
SELECT vec_id, CAST(f % 1000 AS INTEGER) AS query_label FROM firsts""")
def _(spark, d):
    hits = retrieval.nearest(_label_queries(spark, d), table(spark, d, "embeddings"), "query_label", "vec_id", 5)
    return top_k(hits.withColumn("place", F.col("rank")).drop("rank"), 1, [F.col("place"), F.col("query_label")],
                 ["vec_id"]).select("vec_id", "query_label")


@query("T3_pair_similarity", """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), v), 6) AS similarity FROM embeddings a JOIN (
  SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1) q
ON a.label = q.label""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    q = retrieval.mean_vectors(e, "label").withColumnRenamed("embedding", "mean")
    return rounded(e.join(q, "label").select("vec_id", cosine(F.col("embedding"), F.col("mean")).alias("similarity")))


# --------------------------------------------------------------- passages by shared terms
_RETRIEVED = r"""
passages AS (SELECT source || '_' || chunk_idx || '_' || substr(sha256(source || chr(10) || chunk_idx || chr(10) || content), 1, 8) AS chunk_id,
  source, content FROM chunks),
split AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS term FROM passages),
counted AS (SELECT chunk_id, term, 1 + ln(count(*)) AS w FROM split GROUP BY 1, 2),
postings AS (SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS w FROM counted),
asked AS (SELECT query, term, 1 + ln(count(*)) AS w FROM (
  SELECT query, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM texts) GROUP BY 1, 2),
frequency AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
weighed AS (SELECT query, asked.term, w * ln(((SELECT count(*) FROM passages) + 1) / (coalesce(df, 0) + 1)) AS q
  FROM asked LEFT JOIN frequency ON asked.term = frequency.term),
lengths AS (SELECT query, sqrt(sum(q * q)) AS length FROM weighed GROUP BY 1),
dots AS (SELECT query, chunk_id, sum(q * w) AS dot FROM weighed JOIN postings ON weighed.term = postings.term GROUP BY 1, 2),
hits AS (SELECT query, chunk_id, round(dot / length, 9) AS similarity,
  CAST(row_number() OVER (PARTITION BY query ORDER BY round(dot / length, 9) DESC, chunk_id) AS INTEGER) AS rank
  FROM dots JOIN lengths USING (query) WHERE round(dot / length, 9) > 0 QUALIFY rank <= 2)"""
_CHUNK_CTES = _CHUNKS.strip().removeprefix("WITH ")
_PARTS = """
texts AS (SELECT DISTINCT query FROM w),""" + _RETRIEVED + """,
parts AS (SELECT employee_id, w.rank AS pos, hits.rank AS rank, feature, chunk_id, source, content
  FROM w JOIN hits ON w.query = hits.query JOIN passages USING (chunk_id)
  QUALIFY row_number() OVER (PARTITION BY employee_id, chunk_id ORDER BY w.rank, hits.rank) = 1)"""


def _chunks(spark, d):
    """Passages cut from documents of all languages, with their ids."""
    return stage(retrieval.chunk_documents(table(spark, d, "documents"), "doc_id", "text"), "chunks")


@query("T3_text_retrieval", "WITH " + _CHUNK_CTES + ",\ntexts AS (SELECT DISTINCT text AS query FROM benchmark)," + _RETRIEVED
       + "\nSELECT query, chunk_id, round(similarity, 6) AS similarity, rank FROM hits")
def _(spark, d):
    """The two passages nearest to each text of the benchmark."""
    texts = table(spark, d, "benchmark").select(F.col("text").alias("query"))
    return rounded(retrieval.search(texts, _chunks(spark, d).withColumnRenamed("id", "chunk_id")))


def _context(spark, d):
    """Drivers of every subject, the hits of their search texts, and the passages."""
    chunks = _chunks(spark, d)
    people = stage(drivers_of(spark, d), "drivers")
    texts = people.select(F.explode(retrieval.select_queries(F.col("top_shap_drivers"))).alias("q")).select("q.query")
    return people, retrieval.search(texts, chunks.withColumnRenamed("id", "chunk_id")), chunks


@query("T3_policy_retrieval", on_subjects("SELECT employee_id, feature, chunk_id, source FROM parts",
                                          PEERS_SQL, _DRIVERS_SQL, _WANTED, _CHUNK_CTES, _PARTS))
def _(spark, d):
    return retrieval.context_parts(*_context(spark, d)).select("employee_id", "feature", "chunk_id", "source")


@query("T5_context_text", on_subjects("""
SELECT s.employee_id, coalesce(string_agg('[Policy: ' || source || ' | Relevant to: ' || feature || ']' || chr(10) || content,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos, rank), 'No specific policy found for these risk drivers.') AS policy_context
FROM subjects s LEFT JOIN parts ON s.employee_id = parts.employee_id GROUP BY 1""",
                                      PEERS_SQL, _DRIVERS_SQL, _WANTED, _CHUNK_CTES, _PARTS))
def _(spark, d):
    return retrieval.with_policy_context(*_context(spark, d)).select("employee_id", "policy_context")


# The whole chain for every subject: drivers, passages, request and route.
@query("E6_explain_chain", on_subjects("""
SELECT s.employee_id, CASE risk_tier WHEN 'CRITICAL' THEN 'SLACK_ALERT' WHEN 'HIGH' THEN 'WEEKLY_DIGEST' WHEN 'MEDIUM' THEN 'MANAGER_AWARENESS'
  ELSE 'AUDIT_LOG_ONLY' END AS routed_to,
  coalesce(string_agg('[Policy: ' || source || ' | Relevant to: ' || feature || ']' || chr(10) || content,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos, rank), 'No specific policy found for these risk drivers.') AS passages,
  any_value(risk_tier) AS tier
FROM scored s LEFT JOIN parts ON s.employee_id = parts.employee_id GROUP BY 1, 2""",
                                       PEERS_SQL, _DRIVERS_SQL, _WANTED, SCORED_SQL, _CHUNK_CTES, _PARTS))
def _(spark, d):
    from retenta.plans.pipeline import explain_job
    out = explain_job(stage(driven(spark, d), "driven"), _chunks(spark, d).select("id", "source", "content"))
    return out.select("employee_id", "routed_to", F.regexp_extract("request", r"(?s)Passages:\n(.*)\n\nWrite a retention plan", 1).alias("passages"),
                      F.regexp_extract("request", r"Tier: (\w+)", 1).alias("tier"))
