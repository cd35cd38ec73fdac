import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta import schema
from retenta.functions import text
from retenta.operators import retrieval
from retenta.sources import files, logs


def cut(spark, value, **kw):
    return spark.createDataFrame([(value,)], "t string").select(text.chunks(F.col("t"), **kw)).first()[0]


def test_chunks(spark):
    digits = "".join(str(i % 10) for i in range(400))
    parts = cut(spark, digits)
    assert parts[0][-50:] == parts[1][:50]
    assert all(len(p) > 30 for p in cut(spark, "A" * 310))
    assert cut(spark, "") == [] and cut(spark, "too short") == []
    assert "\x00" not in cut(spark, "x" * 40 + "\x00" + "y" * 40)[0]
    for size, overlap in ((50, 50), (50, 60)):
        with pytest.raises(ValueError):
            text.chunks(F.col("t"), size, overlap)


def test_chunks_equal_plain_python_on_whole_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in retrieval.chunk_documents(docs, "doc_id", "text").collect():
        got.setdefault(r["source"], []).append((r["chunk_idx"], r["content"]))
    for r in docs.collect():
        body = r["text"].replace("\0", "").strip()
        want = [c for c in (body[s:s + 300].strip() for s in range(0, len(body), 250)) if len(c) > 30]
        assert [c for _, c in sorted(got.get(str(r["doc_id"]), []))] == want


def test_chunk_ids_are_stable_and_unique(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    a = retrieval.chunk_documents(docs, "doc_id", "text").select("id")
    b = retrieval.chunk_documents(docs.repartition(5), "doc_id", "text").select("id")
    assert a.exceptAll(b).count() == 0 and a.distinct().count() == a.count()


def drivers(spark, items):
    return spark.createDataFrame([("E1", items)], "employee_id string, top_shap_drivers array<struct<feature:string,shap:double>>")


def test_queries(spark):
    df = drivers(spark, [("trend_login", .4), ("comp_compa_ratio", -.3), ("odd_name", .1)])
    got = df.select(retrieval.select_queries(F.col("top_shap_drivers"))).first()[0]
    assert [tuple(x) for x in got] == [("trend_login", schema.DRIVER_QUERIES["trend_login"]), ("odd_name", "odd name")]


@pytest.mark.parametrize("block", [2, 512])
def test_nearest_by_brute_force(spark, block):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(200, 8)).astype("float32")
    e[50:120] = e[50]                                   # a third of the rows are copies
    q = rng.normal(size=(5, 8))
    q[0] = e[50]
    corpus = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(e)], "id bigint, embedding array<float>").repartition(6)
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query int, embedding array<double>")
    got = {}
    for r in retrieval.nearest(queries, corpus, "query", "id", 3, block=block).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    u = e.astype(float) / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    for i, v in enumerate(q):
        sims = np.round(u @ (v / np.linalg.norm(v)), 12)
        assert got[i] == list(np.lexsort((np.arange(200), -sims))[:3])


def test_context(spark):
    people = drivers(spark, [("trend_login", .4), ("odd_name", .3)]).unionByName(
        drivers(spark, [("trend_login", -.4)]).withColumn("employee_id", F.lit("E2")))
    chunks = spark.createDataFrame([("c1", "doc", "one"), ("c2", "doc", "two")], "id string, source string, content string")
    login = schema.DRIVER_QUERIES["trend_login"]
    hits = spark.createDataFrame([(login, "c1", 1), ("odd name", "c1", 1), ("odd name", "c2", 2)], "query string, chunk_id string, rank int")
    out = {r["employee_id"]: r["policy_context"] for r in
           retrieval.policy_context(people, retrieval.context_parts(people, hits, chunks)).collect()}
    assert out["E1"] == ("[Policy: doc | Relevant to: trend_login]\none\n\n---\n\n"
                         "[Policy: doc | Relevant to: odd_name]\ntwo")
    assert out["E2"] == schema.NO_CONTEXT


@pytest.mark.parametrize("sep,encoding", [(",", "utf-8"), (";", "latin-1"), ("\t", "utf-8-sig"), ("|", "utf-8")])
def test_delimited_files(spark, tmp_path, sep, encoding):
    path = tmp_path / "in.csv"
    path.write_text(sep.join(["id", " navn"]) + "\n" + sep.join(["1", " blå"]) + "\n" + sep.join(["2", "x", "extra"]) + "\n", encoding=encoding)
    good, bad = files.read_delimited(spark, str(path))
    assert good.columns == ["id", "navn"] and [tuple(r) for r in good.collect()] == [("1", "blå")]
    assert bad.count() == 1


@pytest.mark.parametrize("sep", [",", ";", "|"])
def test_short_rows_and_quoted_line_breaks_are_kept(spark, tmp_path, sep):
    rows = [["id", "name", "city"], ["1", "a"], ["2", '"two\nlines"', "x"], ["3", "b", "y", "more"], ["4", "", "z"], ["5", "c", "w", ""], ["6"],
            ["7", '"with ""marks"" and ' + sep + '"', "v"], ["8", "d", "u", "p", "q"]]
    (tmp_path / "in.csv").write_text("\n".join(sep.join(r) for r in rows) + "\n")
    good, bad = files.read_delimited(spark, str(tmp_path / "in.csv"))
    assert sorted(tuple(r) for r in good.collect()) == [
        ("1", "a", None), ("2", "two\nlines", "x"), ("4", None, "z"), ("6", None, None), ("7", f'with "marks" and {sep}', "v")]
    assert bad.count() == 3 and {r[0][0] for r in bad.collect()} == {"3", "5", "8"}


def test_encoding_is_decided_by_the_whole_file(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes(b"id,name\n1,a\n2,bl\xe5\n")
    good, _ = files.read_delimited(spark, str(tmp_path / "in.csv"))
    assert [r["name"] for r in good.orderBy("id").collect()] == ["a", "blå"]


def test_unreadable_file(spark, tmp_path):
    (tmp_path / "one.csv").write_text("only\none\n")
    with pytest.raises(files.UnreadableFile):
        files.read_delimited(spark, str(tmp_path / "one.csv"))


def test_texts_and_contract(spark, tmp_path):
    (tmp_path / "leave policy.txt").write_bytes("café \n".encode() + b"\xff ok")
    (tmp_path / "skip.md").write_text("no")
    got = files.read_texts(spark, str(tmp_path)).collect()
    assert [(r["source"], r["text"]) for r in got] == [("leave policy", "café \n ok")]
    files.write_contract(spark, ["b", "a"], str(tmp_path / "contract"))
    assert files.read_contract(spark, str(tmp_path / "contract")) == ["b", "a"]


def test_logs(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert logs.read_audit(spark, path).count() == 0
    df = spark.createDataFrame([("E1", "HIGH", .6, 1.0, None), ("E2", "LOW", None, None, "bad")],
                               "employee_id string, risk_tier string, p_attrition double, ev double, error string")
    logs.append_audit(df, path)
    logs.append_audit(df, path)
    rows = {r["employee_id"]: r for r in logs.read_audit(spark, path).collect()}
    assert logs.read_audit(spark, path).count() == 4
    assert rows["E2"]["p_attrition"] == 0.0 and rows["E2"]["risk_tier"] == "ERROR" and rows["E1"]["error"] == ""
    assert logs.recent_audit(logs.read_audit(spark, path), 3).count() == 3
    digest = str(tmp_path / "digest")
    assert logs.read_digest(spark, digest).count() == 0
    logs.append_digest(df, digest)
    assert [r["employee_id"] for r in logs.read_digest(spark, digest).collect()] == ["E1"]


def test_search_by_shared_terms(spark):
    import math
    import re
    from collections import Counter
    rng = np.random.default_rng(5)
    words = ["pay", "Pay", "band", "leave", "été", "x1", "rare", "of", "the"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(60)] + [None, "", "!!!"]
    asked = ["pay band", "the of of rare", "unknown words", "été, X1!", "pay band"]
    chunks = spark.createDataFrame([(f"c{i:03}", t, "z") for i, t in enumerate(texts)], "chunk_id string, content string, weight string").repartition(3)
    got = {}
    for r in retrieval.search(spark.createDataFrame([(q,) for q in asked], "query string"), chunks, k=3).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["chunk_id"], r["similarity"]))

    def counts(t):
        return {w: 1 + math.log(n) for w, n in Counter(re.findall(r"\w+", (t or "").lower())).items()}

    bags = [counts(t) for t in texts]
    for q in set(asked):
        weights = {w: x * math.log((len(texts) + 1) / (sum(w in b for b in bags) + 1)) for w, x in counts(q).items()}
        length = math.sqrt(sum(x * x for x in weights.values()))
        sims = [(round(sum(x * b.get(w, 0) for w, x in weights.items()) / length / math.sqrt(sum(v * v for v in b.values()) or 1), 9), f"c{i:03}")
                for i, b in enumerate(bags)]
        want = [(c, s) for s, c in sorted(sims, key=lambda x: (-x[0], x[1])) if s > 0][:3]
        assert [c for c, _ in got.get(q, [])] == [c for c, _ in want]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want], abs=1e-8)


def test_search_by_blocks_and_packs(spark, monkeypatch):
    """Against a plain version, with several blocks and packs; no pair of search text and chunk is shuffled."""
    import math
    import random
    import re
    from collections import Counter
    monkeypatch.setattr(retrieval, "PACK", 7)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "x2"]
    bodies = {f"c{i:02d}": " ".join(rng.choices(words, k=rng.randint(0, 12))) for i in range(40)}
    asked = [" ".join(rng.choices(words + ["unseen"], k=4)) for _ in range(9)] + ["nothing", ""]
    chunks = spark.createDataFrame([*bodies.items(), ("null", None)], "chunk_id string, content string")
    out = retrieval.search(spark.createDataFrame([(x,) for x in asked], "query string"), chunks, k=3, block=2)

    def counts(s):
        return {t: 1 + math.log(n) for t, n in Counter(re.findall(r"\w+", (s or "").lower())).items()}

    texts = {i: counts(b) for i, b in [*bodies.items(), ("null", None)]}
    df = Counter(t for c in texts.values() for t in c)
    want = {}
    for x in set(asked):
        q = {t: w * math.log((len(texts) + 1) / (df[t] + 1)) for t, w in counts(x).items()}
        size = math.sqrt(sum(w * w for w in q.values()))
        sims = [(-round(sum(w * c[t] for t, w in q.items() if t in c) / size / math.sqrt(sum(w * w for w in c.values())), 9), i)
                for i, c in texts.items() if c and size]
        want |= {(x, r + 1): (i, -s) for r, (s, i) in enumerate(sorted(s for s in sims if s[0] < 0)[:3])}
    got = {(r["query"], r["rank"]): (r["chunk_id"], r["similarity"]) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=2e-9) for k in want)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(" not in out._jdf.queryExecution().optimizedPlan().toString()
