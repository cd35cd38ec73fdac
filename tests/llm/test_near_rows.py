import random

import corpus_pipeline
import pytest

from tests.llm.helpers import frame

A, B, C, D = (" ".join(f"{k}{i}" for i in random.Random(k).sample(range(10 ** 6), 120)) for k in "abcd")


@pytest.mark.parametrize("rows, want", [
    ([(1, A), (2, A), (2, B)], [(1, A), (2, B)]),                       # one id, two texts: only the copy goes
    ([(1, A), (1, B), (3, C)], [(1, A), (1, B), (3, C)]),
    ([(4, C), (4, C), (4, C), (5, D)], [(4, C), (5, D)]),               # a repeated row stays once
    ([(None, A), (None, A), (None, B)], [(None, A), (None, B)]),        # and so do copies without an id
    ([(None, D), (9, D), (10, D + " more")], [(9, D)]),
    ([(None, None), (None, ""), (7, " ")], [(7, " ")]),
])
def test_copies_are_dropped_by_row(spark, rows, want):
    out = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert out.columns == frame(spark, []).columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted(want, key=str)
