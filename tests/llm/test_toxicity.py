import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.llm import toxicity
from tests.llm.helpers import EDGE, frame


def plain_score(machine, terms):
    raw = machine.bias + sum(machine.weights[t] for t in terms)
    raw += sum(float(machine.factors[a] @ machine.factors[b]) for i, a in enumerate(terms) for b in terms[:i])
    return 1 / (1 + np.exp(-raw))


def test_scores_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(-0.5, rng.normal(0, 0.3, toxicity.BUCKETS), rng.normal(0, 0.3, (toxicity.BUCKETS, 4)))
    texts = [rng.choice(toxicity.BUCKETS, n, replace=False) for n in (0, 1, 2, 7)]
    got = machine.scores(np.r_[0, np.cumsum([len(t) for t in texts])], np.concatenate(texts))
    assert got == pytest.approx([plain_score(machine, t) for t in texts])


def test_pairs_are_learned_that_single_terms_cannot_tell():
    """Toxic if exactly both or neither of two terms stand together: no sum of single weights can separate it."""
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append(([10] * a + [20] * b + [int(x) for x in rng.choice(np.arange(100, 140), 3, replace=False)], int(a and b)))
    machine = toxicity.fit(rows, rounds=30)
    score = lambda *t: plain_score(machine, t)
    assert score(10, 20) > 0.8 and max(score(10), score(20), score()) < 0.2
    assert float(machine.factors[10] @ machine.factors[20]) > 0


def test_held_out_rows_follow_the_checksum(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"))
    got = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_held_out_accuracy_and_no_other_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.training_rows(docs, labels)
    machine = toxicity.fit(rows)
    assert len(rows) == labels.filter(~toxicity.held_out()).count()
    again = toxicity.fit(toxicity.training_rows(docs.repartition(5), labels.repartition(3)))
    assert np.array_equal(machine.weights, again.weights)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    moved = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("other").alias("source"))
    assert {r.doc_id - 7: r.score for r in toxicity.score(moved, machine).collect()} == scores
    truth = [(scores[r.doc_id], r.toxic) for r in labels.filter(toxicity.held_out()).collect()]
    right = sum(a > b for a, y in truth if y for b, z in truth if not z) / (sum(y for _, y in truth) * sum(1 - y for _, y in truth))
    assert right > 0.75


def test_edges(spark):
    docs = frame(spark, EDGE)
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (6, 0)], "doc_id bigint, toxic int")
    machine = toxicity.fit(toxicity.training_rows(docs, labels))
    rows = toxicity.score(docs, machine).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit([])).collect() == []
