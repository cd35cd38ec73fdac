import itertools
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from retenta.llm import pii
from tests.llm.helpers import EDGE, LONG, frame

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    t = [int(c) for c in d][::-1]
    return (sum(t[::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


CASES = ["a@b.c x..%@h-.d.e@f.g", "@a.b a@ a@b a@b. a@b.c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3", "٣.1.2.3.4",
         "4012888888881881 4012-8888-8888-1881 4012 8888 8888 1882 0000000000000000000000", "+1 (988) 555-2485, +44..20--7946 0958) +1",
         "++12345678901 +1234567890123456", "1" * 5000, "a" * 5000, "a.b@" * 300, "x@y.z" * 50, "é1.1.1.1é漢a@b.cé"]


def test_patterns_equal_plain_regular_expressions():
    rng = np.random.default_rng(2)
    random_ = ["".join(rng.choice(list("a1.@+- ()é0\n"), 60)) for _ in range(800)]
    for text in CASES + random_:
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    import time
    start = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "@" * 300_000, "a@" * 150_000):
        pii.base_spans(text)
    assert time.time() - start < 20


def test_decoding_equals_the_best_of_all_label_sequences():
    field, rng = pii.trained(), np.random.default_rng(4)
    words = ["the", "call", "+1", "(988)", "555-2485", "4012", "8888", "ana", "at", "(at)", "mail", "dot", "x@y.zz", "10.2.3.4", "the&&&", "7."]
    own, before, after = field.word_scores(words)
    for _ in range(40):
        codes = rng.integers(0, len(words), rng.integers(1, 6))
        got = field.decode(np.array([0, len(codes)]), codes, words)

        def value(labels):
            total = sum(own[c][k] for c, k in zip(codes, labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))
            return total + sum(before[codes[i - 1]][labels[i]] + after[codes[i]][labels[i - 1]] for i in range(1, len(codes)))
        best = max(value(x) for x in itertools.product(range(5), repeat=len(codes)))
        assert value(got) == pytest.approx(best, abs=1e-3)


def found(text):
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
    return [(pii.KINDS[k], text[s:e], base) for s, k, e, base in pii.spans_of(batch, pii.trained())[0]]


def test_the_field_adds_what_patterns_miss_and_leaves_prose_alone():
    assert ("email", "ana.perez (at) mail (dot) example (dot) org", False) in found("write to ana.perez (at) mail (dot) example (dot) org please")
    assert ("phone", "(212) 555-0199", False) in found("call (212) 555-0199 now")
    assert found("Licensed under CC BY-NC 4.0. The&&& quick### 3. brown fox, and it ran at 10:30 on page 12.") == []
    assert found(LONG) == []


def test_edges_and_redaction(spark, data):
    docs = frame(spark, [*EDGE, (9, "mail a.b@c.dd or 10.0.0.1"), (9, "mail a.b@c.dd or 10.0.0.1")])
    spans = {r.doc_id: [(x.kind, x.start, x.end, x.base) for x in r.spans] for r in pii.find(docs).collect()}
    assert spans[9] == [("email", 5, 13, True), ("ip", 17, 25, True)] and spans[1] == [] and spans[2] == []
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(EDGE) + 2
    assert {r.text for r in out.filter("doc_id = 9").collect()} == {"mail [email] or [ip]"}
    assert out.filter("doc_id = 1").first().text is None
    assert pii.find(docs.limit(0)).collect() == [] and pii.redact(docs.limit(0)).collect() == []
    real = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.collect()}
    for r in pii.find(real).collect():
        assert [(x.start, pii.KINDS.index(x.kind), x.end) for x in r.spans if x.base] == plain_base(texts[r.doc_id])


def test_a_batch_is_redacted_in_pieces_of_bounded_memory():
    line = "write to ana@example.org or call +1 (555) 010-9999 about the meeting in room nine on monday at noon . "
    texts = [line * 30 if i % 50 else None for i in range(2_400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    field, done, bytes_ = pii.trained(), [], batch.nbytes
    tracemalloc.start()
    for piece in pii._redacted(iter([batch]), field, 1):
        done += [hash(x) for x in piece.column("text").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bytes_ > 7e6 and peak < 10 * bytes_
    want = line.replace("ana@example.org", "[email]").replace("+1 (555) 010-9999", "[phone]") * 30
    assert done == [hash(want if t else "") if t else hash(None) for t in texts]
