import collections
import re

from pyspark.sql import functions as F

from retenta.llm import quality
from tests.llm.helpers import EDGE, frame


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    places = collections.defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i:i + 5])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for p in v for j in range(p, p + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


CASES = ["a b c d e a b c d e", "x x x x x x x x", "a b c d e f\na b c d e f\n\n \n\na b c d e f", "# * $ % & | < >", "é漢 ß\x0bb", "\n\n\n"]


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_statistics_equal_plain_counts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.with_statistics(docs).collect():
        assert counts(r) == plain(texts[r.doc_id])
    rows = frame(spark, [*EDGE, *[(100 + i, t) for i, t in enumerate(CASES)]])
    got = sorted((str(r.doc_id), counts(r)) for r in quality.with_statistics(rows).collect())
    assert got == sorted([*[(str(i), plain(t)) for i, t in EDGE], *[(str(100 + i), plain(t)) for i, t in enumerate(CASES)]])


def test_a_list_is_learned_and_written_as_conditions(spark):
    rows = [{n: 0.0 for n in quality.STATISTICS} | {"doc_id": i, "label": 1, "symbol_ratio": i % 7 / 100, "n_words": 50 + i % 90} for i in range(300)]
    for i, r in enumerate(rows):
        if i % 10 == 0:
            r |= {"label": 0, "symbol_ratio": 0.8 + i / 1000}
        if i % 10 == 1:
            r |= {"label": 0, "upper_ratio": 0.7, "mark_ratio": 0.5}
        if i % 10 == 2:
            r |= {"upper_ratio": 0.7}           # upper case alone is fine
    rules = quality.learn(rows)
    assert 2 <= len(rules) <= 4
    for r in rows:
        assert any(x.holds(r) for x in rules) == (r["label"] == 0)
    table = spark.createDataFrame([tuple(float(r[n]) for n in quality.STATISTICS) for r in rows], list(quality.STATISTICS))
    first = [next((k for k, x in enumerate(rules, 1) if x.holds(r)), None) for r in rows]
    assert [r.rule for r in table.select(quality.rejected_by(rules).alias("rule")).collect()] == first
    assert quality.learn([]) == [] and quality.learn(rows[3:9]) == []


def test_kept_rows_keep_their_columns(spark):
    docs = frame(spark, [*EDGE, (30, " ".join(f"good{i} words" for i in range(30))), (31, "again and again it is " * 9), (30, None)])
    out = quality.accepted(docs, [quality.Rule((quality.Condition("digit_ratio", True, 2.0),))])
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [6, 7, 30]
    assert quality.accepted(docs.limit(0), []).collect() == []
    labels = spark.createDataFrame([(6, 1), (6, 0), (None, 1), (30, None), (99, 1)], "doc_id bigint, quality int")
    assert [(r["doc_id"], r["label"]) for r in quality.labelled_sample(docs, labels)] == [(6, 0)]


def test_plan_is_native(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = quality.accepted(docs, [quality.Rule((quality.Condition("n_words", False, 5.0),))])._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))
    physical = plan.split("Physical Plan")[1]
    assert physical.index("Filter") < physical.index("Generate"), "a filter below the generator would compute the counts anew"


def test_rules_reject_bad_and_keep_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn(quality.labelled_sample(docs, labels))
    judged = quality.judge(docs, rules).join(labels, "doc_id")
    bad, good = judged.filter("quality = 0"), judged.filter("quality = 1 and not base_failed")
    assert bad.filter("not kept").count() >= 0.9 * bad.count()
    assert good.filter("kept").count() >= 0.98 * good.count()
    assert good.filter(F.col("kept")).count() > 0
