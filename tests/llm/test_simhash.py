import random

import pytest
import xxhash

from retenta.llm import simhash
from retenta.llm.components import components
from tests.llm.helpers import EDGE, LONG, frame


def groups(nodes, close):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if close(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def plain_print(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_paths_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (7, 8), (8, 7), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("bucket", [2, 5, 4096])
def test_links_connect_what_close_pairs_connect(spark, bucket):
    rng = random.Random(bucket)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(0, 64, rng.choice([1, 3, 9]))
            prints.add(x)
    prints = sorted(prints)
    want = groups(list(range(len(prints))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    table = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(prints)], "node bigint, fingerprint bigint")
    found = {r.node: r.component for r in components(simhash.close_links(table, bucket)).collect()}
    assert {i: found.get(i, i) for i in want} == want
    assert len(set(want.values())) > 6


def test_documents_against_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    want = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_copies(docs).collect()}
    assert found == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_edges(spark):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_copies(frame(spark, [*EDGE, (None, None)])).collect()]
    found = dict((i, c) for i, _, c in got if i)
    assert len(got) == len(EDGE) + 1
    assert (found[1], found[2], found[3], found[4], found[5], found[6], found[7]) == (1, 1, 1, 4, 4, 6, 6)
    assert {f for i, f, _ in got if i == 6} == {f"{plain_print(LONG):016x}"}
    assert (None, "0" * 16, 1) in got           # a null id links nothing and names nothing, but takes its copy's group
    assert [c for i, f, c in got if i is None and f != "0" * 16] == [None]
    assert simhash.near_copies(frame(spark, [])).collect() == []
