import random

import numpy as np
import pytest

from retenta.llm.fm_index import BitRank, WordIndex
from retenta.llm.substrings import without_repeats
from tests.llm.helpers import EDGE, frame


def plain(rows, window=13):
    first, words = {}, {}
    for i, text in rows:
        words.setdefault(i, []).append((text or "").encode().split())
    for i in sorted(k for k in words if k is not None):
        for w in words[i]:
            for k in range(len(w) - window + 1):
                first.setdefault(tuple(w[k:k + window]), i)
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((str(i), len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out)


def got(df):
    rows = df.collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in rows)


def test_ranks_and_backward_search():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, 1000).astype(bool)
    assert BitRank(bits).ones(np.arange(1001)).tolist() == [int(bits[:i].sum()) for i in range(1001)]
    for sigma in (2, 5, 40):
        text = np.r_[rng.integers(1, sigma + 1, 600), 0, np.ones(50, dtype=int), 0, rng.integers(1, sigma + 1, 5), 0]
        index, size = WordIndex(text, 7), 7
        starts = np.array([i for i in range(len(text) - size) if 0 not in text[i:i + size]])
        low, high = index.search(text, starts, size)
        for i, a, b in zip(starts, low, high):
            same = {int(j) for j in starts if (text[j:j + size] == text[i:i + size]).all()}
            found = {int(x) for x in index.order[a:b]}
            assert i in found or len(same) == 1
            if len(same) > 1:
                assert found == same


@pytest.mark.parametrize("tuning", [{}, {"shard": 7, "common": 2}, {"shard": 100, "common": 9}])
def test_passages_against_plain_windows(spark, tuning):
    rng = random.Random(6)
    passages = [[f"p{rng.randrange(300)}" for _ in range(rng.randint(10, 70))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.choice([0, 0, 1, 2])):
            a = rng.randrange(len(p))
            at = rng.randint(0, len(w))
            w[at:at] = p if rng.random() < 0.6 else p[a:]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(200 + k, " ".join(["the"] * 40)) for k in range(5)] + [(300, rows[3][1]), (301, rows[3][1])]
    want = plain(rows)
    assert sum(x[2] for x in want) > 500
    assert got(without_repeats(frame(spark, rows), **tuning)) == want


def test_edges(spark):
    text = " ".join(f"t{k}" for k in range(20))
    rows = [*EDGE, (None, text), (40, text), (40, text), (41, text), (42, text.upper())]
    assert got(without_repeats(frame(spark, rows))) == plain(rows)
    assert without_repeats(frame(spark, [])).collect() == []
