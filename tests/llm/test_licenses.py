import re

from retenta.llm import licenses
from tests.llm.helpers import EDGE, frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    out = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), sorted(out)


CASES = [(50, "GNU General Public License, gnu general public license; Apache-License CC.BY cc by mit license"), (51, "cc\nBY cc"), (52, "É Mit LICENSE é"),
         (53, "general public license"), (54, "license mit"), (55, None)]


def test_places_equal_a_plain_search(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.scan(docs).collect():
        assert (r.n_words, [tuple(p) for p in r.places]) == plain(texts[r.doc_id])
    rows = sorted((str(r.doc_id), r.n_words, [tuple(p) for p in r.places]) for r in licenses.scan(frame(spark, EDGE + CASES)).collect())
    assert rows == sorted((str(i), *plain(t)) for i, t in EDGE + CASES)


def test_templates_with_inserted_lost_and_changed_words(spark):
    mit = licenses.TEMPLATES["mit"][1].split()
    bsd = licenses.TEMPLATES["bsd"][0].split()
    cut = mit[:20] + ["new", "words", "here"] + mit[20:50] + mit[54:]
    changed = [("changed" if k in (12, 40) else w) for k, w in enumerate(bsd)]
    filler = [f"f{k}" for k in range(37)]
    docs = frame(spark, [(1, " ".join(filler + cut + filler)), (2, " ".join(changed)), (3, " ".join(mit[:25])), (4, " ".join(filler)), (4, " ".join(filler + bsd)),
                         (None, " ".join(mit)), (6, "Licensed under CC BY-NC 4.0.")])
    rows = licenses.scan(docs).collect()
    assert len(rows) == 7
    found = sorted((str(r.doc_id), s.label) for r in rows for s in r.stretches)
    assert found == [("1", "mit"), ("2", "bsd"), ("4", "bsd"), ("6", "cc-by-nc"), ("None", "mit")]
    span = next(s for r in rows if r.doc_id == 1 for s in r.stretches)
    n = len(re.findall(r"[0-9a-z]+", " ".join(cut).lower()))
    assert abs(span.start - 37) <= 4 and abs(span.end - (37 + n)) <= 4 and 0.6 <= span.cover <= 1


def test_own_templates_and_empty_tables(spark):
    wanted = spark.createDataFrame([("t", "own", "one two three four five"), ("s", "short", "one two"), ("n", "none", None)], "template string, label string, text string")
    docs = frame(spark, [(1, "zero ONE, two three-four five six"), (2, "one two three")])
    rows = {r.doc_id: [(s.label, s.start, s.end, s.cover) for s in r.stretches] for r in licenses.scan(docs, wanted=wanted).collect()}
    assert rows == {1: [("own", 1, 6, 1.0)], 2: []}
    assert licenses.scan(docs.limit(0)).collect() == []
    assert all(r.stretches == [] for r in licenses.scan(docs, wanted=wanted.limit(0)).collect())


def test_repeated_short_lines_are_stretches_of_their_own(spark):
    wanted = spark.createDataFrame([("t", "own", "one two three four five")], "template string, label string, text string")
    docs = frame(spark, [(1, "one two three four five\n" * 50), (2, "one two three four x " * 6 + "four five"), (3, "one two three four five six " * 2)])
    rows = {r.doc_id: [(s.start, s.end, s.cover) for s in r.stretches] for r in licenses.scan(docs, wanted=wanted).collect()}
    assert rows[1] == [(5 * k, 5 * k + 5, 1.0) for k in range(50)]
    assert all(end - start <= 5 for spans in rows.values() for start, end, _ in spans)
    assert rows[3] == [(0, 5, 1.0), (6, 11, 1.0)]
