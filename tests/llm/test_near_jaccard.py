import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa

from retenta.llm import near_jaccard
from tests.llm.helpers import frame


def similarity(a, b):
    x, y = (set(near_jaccard.runs(t.encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def changed(rng, words, n):
    """The text with ``n`` words replaced, far enough from each other that each takes five runs."""
    out = list(words)
    for at in rng.sample(range(4, len(words) - 4, 6), n):
        out[at] = f"new{rng.randrange(10 ** 9)}"
    return " ".join(out)


def test_near_copies_of_each_similarity(spark):
    rng, rows, wide = random.Random(5), [], set()
    for d in range(120):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
        copy = changed(rng, words, (2, 4, 6, 9)[d % 4])
        rows += [(2 * d, " ".join(words)), (2 * d + 1, copy)]
        if similarity(" ".join(words), copy) >= 0.8:
            wide.add(2 * d + 1)
    assert len(wide) == 90                      # nine changes leave a similarity of about 0.74
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert set(range(240)) - wide <= kept
    assert len(wide & kept) <= 2


def links_of(spark, monkeypatch, rows):
    """Groups of the rows by id, and the number of candidate links of each round."""
    counts, plain_stage = [], near_jaccard.stage

    def counted(df, label="stage", **more):
        out = plain_stage(df, label, **more)
        if label == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(near_jaccard, "stage", counted)
    found = near_jaccard.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    monkeypatch.setattr(near_jaccard, "stage", plain_stage)
    return {r.doc_id: r.component for r in found}, counts


def test_a_family_takes_about_as_many_links_as_copies(spark, monkeypatch):
    rng, total = random.Random(9), {}
    for n in (100, 400):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
        rows = [(i, changed(rng, words, rng.randint(1, 3))) for i in range(n)]
        groups, counts = links_of(spark, monkeypatch, rows)
        assert len(set(groups.values())) == 1
        total[n] = sum(counts)
    assert total[400] < 8 * total[100] and total[400] < 40 * 400


def test_pairs_within_a_family_of_one_template(spark, monkeypatch):
    """Pages of one template have a similarity of about 0.7 to each other; each planted partner is at 0.8 to 0.95 to its page."""
    rng = random.Random(12)
    frame_words = [f"t{k}" for k in range(240)]
    rows, partners = [], []
    for i in range(0, 240, 2):
        page = frame_words + [f"p{i}x{k}" for k in range(48)]
        copy = list(page)
        for at in rng.sample(range(6, 280, 7), (1, 2, 3, 5)[i // 2 % 4]):
            copy[at] = f"c{rng.randrange(10 ** 9)}"
        rows += [(i, " ".join(page)), (i + 1, " ".join(copy))]
        partners.append((i, similarity(rows[-2][1], rows[-1][1])))
    assert similarity(rows[0][1], rows[2][1]) < 0.8
    groups, _ = links_of(spark, monkeypatch, rows)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        band = [i for i, x in partners if low <= x < high]
        assert not band or sum(groups[i] == groups[i + 1] for i in band) >= 0.9 * len(band), (low, len(band))
    assert len(set(groups.values())) >= 115                     # pages of different partners stay apart


def test_stars_and_links_across_components():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, 2, dtype=np.uint64).astype(np.uint32)
    marks = np.concatenate([b ^ (np.uint32(1) << rng.integers(0, 32, 500, dtype=np.uint32)) for b in base])
    nodes = np.arange(1000)
    rows = np.column_stack([np.full(1000, 7), nodes, nodes, marks.view(np.int32).astype(np.int64)])
    star = near_jaccard._links(rows, False)
    assert 499 <= star.num_rows <= 999                          # one link for each row near the middle one
    trees = np.where(nodes < 500, 0, np.where(nodes < 990, 1, nodes))
    order = np.lexsort((nodes, trees))
    across = near_jaccard._links(np.column_stack([rows[:, 0], trees, nodes, rows[:, 3]])[order], True).to_pydict()
    linked = {(trees[a], trees[b]) for a, b in zip(across["a"], across["b"])}
    assert all(x != y for x, y in linked) and {x for p in linked for x in p} >= set(range(990, 1000)) | {1}
    assert len(across["a"]) <= 10 * 11 + 490
    same = np.column_stack([rows[:, 0], np.zeros(1000, np.int64), nodes, rows[:, 3]])
    assert near_jaccard._links(same, True).num_rows == 0


def test_empty_table_and_texts_without_words(spark, monkeypatch):
    assert links_of(spark, monkeypatch, [])[0] == {}
    groups, _ = links_of(spark, monkeypatch, [(1, None), (2, ""), (3, " \n"), (None, " "), (4, "one"), (5, "ONE"), (6, "two")])
    assert groups[1] == groups[2] == groups[3] == groups[None] and groups[4] == groups[5]
    assert len({groups[1], groups[4], groups[6]}) == 3


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    """A family around the limit, in which a row's only partner is seldom its nearest one, gives the components of all pairs,
    also where the larger keys are cut into blocks."""
    rng = random.Random(21)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)]
    rows = [(i, changed(rng, words, rng.randint(1, 6))) for i in range(150)] + [(150 + i, f"a {i} b {i} c") for i in range(20)]
    sets = {i: set(near_jaccard.runs(t.encode(), 5).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    want = {frozenset(j for j in sets if top(j) == top(i)) for i in sets}
    assert 20 < len(want) < 170
    for first, few, block in ((near_jaccard.ROUNDS, 32, 2048), ((), 32, 20), ((), 200, 2048)):
        monkeypatch.setattr(near_jaccard, "ROUNDS", first)
        monkeypatch.setattr(near_jaccard, "SMALL", few)
        monkeypatch.setattr(near_jaccard, "BLOCK", block)
        groups, _ = links_of(spark, monkeypatch, rows)
        assert {frozenset(j for j in sets if groups[j] == groups[i]) for i in sets} == want


def test_counts_never_hide_a_link():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 31, n, dtype=np.int64)).astype(np.int32) for n in (0, 3, 400, 90_000)]
    for x in sets:
        y = np.concatenate([x[len(x) // 10:], np.arange(len(x) // 10, dtype=np.int32)])
        for other in (x, np.unique(y), np.unique(x // 2 - 7)):
            batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "x": [near_jaccard._counts(x)], "y": [near_jaccard._counts(other)]})
            found = sum(b.num_rows for b in near_jaccard._possible([batch], 0.8))
            same = len(np.intersect1d(x, other))
            if same >= 0.8 * (len(x) + len(other) - same):
                assert found == 1


def test_pages_of_one_template_name_each_pair_once(spark):
    """Pages that share most of their leading runs and are no copies: a pair is named where two sets meet first, not at each run."""
    rng = np.random.default_rng(8)
    template = rng.choice(1 << 31, 320, replace=False)
    sets = [np.sort(np.r_[template, rng.choice(1 << 31, 80, replace=False)]).astype(np.int32) for _ in range(12)]
    node = pa.array(range(12), pa.int64())
    batch = pa.RecordBatch.from_arrays([node, node, pa.array([x.tolist() for x in sets], pa.list_(pa.int32()))], names=["node", "component", "runs"])
    none = np.zeros(0, dtype=np.int64)
    rows = pa.Table.from_batches(near_jaccard._leading([batch], (none, none), 0.6)).sort_by([("key", "ascending"), ("component", "ascending")])
    keys = np.asarray(rows["key"])
    cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
    found, tasks = set(), 0
    for task in range(4):                               # keys are dealt over tasks
        batches = [b for k in range(task, len(cuts) - 1, 4) for b in rows.slice(cuts[k], cuts[k + 1] - cuts[k]).to_batches()]
        out = [tuple(x) for b in near_jaccard._candidates(batches, 0.6) for x in zip(b["a"].to_pylist(), b["b"].to_pylist())]
        assert len(out) == len(set(out))
        found |= set(out)
        tasks += len(out)
    assert len(found) == 66 and tasks < 1.5 * 66


def test_leading_runs_of_a_large_batch_take_bounded_memory():
    rng = np.random.default_rng(4)
    flat, ends = rng.integers(0, 1 << 30, 4_000_000, dtype=np.int32), np.arange(0, 4_000_001, 400, dtype=np.int32)
    ids = pa.array(np.arange(len(ends) - 1))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "component", "runs"])
    often = np.unique(flat[:1000]).astype(np.int64), np.arange(3, 3 + len(np.unique(flat[:1000])))
    names = ["key", "node", "size", "place", "before1", "before2"]
    want = [list(next(near_jaccard._leading(iter([batch.slice(i, 1)]), often, 0.8)).select(names).to_pylist()) for i in (0, 777, 9_999)]
    found = {0: [], 777: [], 9_999: []}
    tracemalloc.start()
    for piece in near_jaccard._leading(iter([batch]), often, 0.8):
        node = piece.column("node").to_numpy()
        for i in found:
            found[i] += piece.filter(pa.array(node == i)).select(names).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * flat.nbytes
    for (i, rows), expected in zip(found.items(), want, strict=True):
        assert len(rows) == len(expected) == 81
        for got, right in zip(rows, expected, strict=True):
            # the least run before the first place is never read
            assert got == right if got["place"] else (got["key"], got["size"]) == (right["key"], right["size"])
