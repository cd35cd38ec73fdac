import corpus_pipeline
import pytest
import tiktoken
from pyspark.sql import functions as F

from retenta.llm import bpe, quality
from retenta.session import stage
from tests.llm.helpers import EDGE, frame
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_pii import found as spans
from tests.llm.test_simhash import groups


def plain_runs(text, size=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_stages_against_a_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rules = quality.learn(quality.labelled_sample(docs, spark.read.parquet(f"{data}/labels.parquet")))
    kept = {r.doc_id for r in quality.judge(docs, rules).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    sets = {i: plain_runs(t) for i, t in texts.items()}
    of = groups(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    texts = {i: t for i, t in texts.items() if of[i] == i}
    assert len(set(of.values())) < len(of)
    leaking = {d for d, _ in plain_leaks(list(texts.items())[:60], items)}
    ranks = bpe.read_ranks(corpus_pipeline.RANKS)
    library = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    checked = list(texts)[:60]
    assert {i for i in checked if i in out} == set(checked) - leaking and set(out) <= set(texts)
    for i in [i for i in checked if i in out][:25]:
        text = texts[i]
        for kind, found, _ in spans(text):
            text = text.replace(found, f"[{kind}]", 1)
        assert out[i].text == text and list(out[i].ids) == library.encode_ordinary(text) and out[i].n_tokens == len(out[i].ids)


@pytest.mark.parametrize("rows", [EDGE, []])
def test_every_stage_bears_edges(spark, data, rows):
    docs = frame(spark, rows)
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = stage(function(spark, docs, data), name)
        assert out.columns == docs.columns
        if not rows:
            assert out.count() == 0
    assert function is corpus_pipeline.personal_data
    last = corpus_pipeline.token_ids(spark, docs, data)
    assert last.count() == len(rows) and last.agg(F.sum("n_tokens")).first()[0] is not None or not rows
