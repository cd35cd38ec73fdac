import random
import time

from retenta.functions.similarity import Dictionary, similarity, token_sorted


def test_batches_equal_name_by_name():
    rng = random.Random(6)
    words = ["tenure", "months", "Pay", "BAND", "é", "x", "manager", "rate", "漢"]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(40)] + ["w" * 63, "long " * 20]
    names = [None, "", " ", "w" * 90, *[" ".join(rng.choice(words)[rng.randint(0, 1):] for _ in range(rng.randint(0, 5))) for _ in range(300)]]
    for name, got in zip(names, Dictionary(pool).best(names)):
        if name is None:
            assert got == (None, None)
        else:
            score, _, best = max((similarity(token_sorted(name), token_sorted(c)), -i, c) for i, c in enumerate(pool))
            assert got == (best, score)
    assert Dictionary([]).best(["a"]) == [(None, None)]


def test_many_names_are_compared_together():
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdefghij _") for _ in range(14)) for _ in range(20_000)]
    pool = ["".join(rng.choice("abcdefghij _") for _ in range(12)) for _ in range(60)]
    begin = time.perf_counter()
    assert len(Dictionary(pool).best(names)) == len(names)
    assert time.perf_counter() - begin < 15
