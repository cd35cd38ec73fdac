import random

from retenta.llm.decontaminate import clean, leaks
from tests.llm.helpers import EDGE, frame

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def noise(rng, n):
    return [f"n{rng.randrange(5000)}" for _ in range(n)]


def plain(docs, items, window=13, same=0.8):
    """All places of all items in all documents, word by word."""
    import re

    def words(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = set()
    for d, text in docs:
        w = words(text)
        for k, item in items:
            v = words(item)
            n = min(window, len(v))
            for start in range(-len(v) + n, len(w) - n + 1):
                equal = [0 <= start + j < len(w) and w[start + j] == v[j] for j in range(len(v))]
                inside = [j for j in range(len(v)) if 0 <= start + j < len(w)]
                if inside and any(sum(equal[j:j + n]) >= same * n for j in range(inside[0], inside[-1] + 2 - n)):
                    out.add((d, k))
    return out


def test_whole_cut_and_substituted_items(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for d in range(60):
        body = noise(rng, 50)
        at = rng.randrange(50)
        part = list(ITEM)
        if d % 4 == 1:
            part = part[3:]
        if d % 4 == 2:
            for j in (4, 11):
                part[j] = "changed"
        if d % 4 == 3:
            part = part[:6]                     # too little of it
        rows.append((d, " ".join(body[:at] + part + body[at:])))
        if d % 4 != 3:
            want.add((d, 7))
    items = spark.createDataFrame([(7, "Alpha, " + " ".join(ITEM[1:])), (8, " ".join(noise(rng, 20))), (9, None), (None, "x")],
                                  "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in leaks(frame(spark, rows), items).collect()}
    assert found == want == plain(rows, [(7, " ".join(ITEM))])


def test_documents_against_a_plain_search(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.limit(80).collect()], [(r.item_id, r.text) for r in items.collect()])
    ids = [r.doc_id for r in docs.limit(80).collect()]
    found = {(r.doc_id, r.item_id) for r in leaks(docs.filter(docs.doc_id.isin(ids)), items).collect()}
    assert found == want


def test_edges_and_cleaning(spark):
    items = spark.createDataFrame([(1, " ".join(ITEM)), (1, " ".join(ITEM)), (2, "")], "item_id bigint, text string")
    docs = frame(spark, [*EDGE, (20, "before " + " ".join(ITEM)), (20, " ".join(ITEM)), (21, " ".join(ITEM))])
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == {(20, 1), (21, 1)}
    kept = clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(EDGE)
    assert leaks(docs.limit(0), items).collect() == [] and leaks(docs, items.limit(0)).collect() == []


def test_plan_is_native(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    plan = leaks(docs, items)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_every_accepted_pattern_of_changes_is_found(spark):
    """Items of 3 to 16 words with every choice of up to two changed words, each in a document of its own."""
    from itertools import combinations
    rng, rows, items = random.Random(4), [], []
    for size in range(3, 17):
        item = [f"i{size}x{j}" for j in range(size)]
        items.append((size, " ".join(item)))
        for changed in [c for k in range(3) for c in combinations(range(size), k)]:
            part = ["changed" if j in changed else w for j, w in enumerate(item)]
            rows.append((len(rows), " ".join([*noise(rng, 5), *part, *noise(rng, 5)])))
    found = {(r.doc_id, r.item_id) for r in leaks(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = plain(rows, items)
    assert found == want and len(want) > 400
    short = [i for i in items if i[0] < 13]
    found = {(r.doc_id, r.item_id) for r in leaks(frame(spark, rows), spark.createDataFrame(short, "item_id bigint, text string")).collect()}
    assert found == {w for w in want if w[1] < 13}
