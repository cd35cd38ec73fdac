import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from retenta.llm.collocations import Slice, collocations, frequencies
from tests.llm.helpers import LONG

KINDS = "doc_id bigint, text string, lang string, words string, row bigint, phrase string, size int, rank int"


def plain(rows, least, longest, top):
    upper = {c: c + 32 for c in range(65, 91)}
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i:i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = {(g, w[i:j]) for (g, w), a in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1)
            if j - i < len(w) and 100 * a >= 80 * found[g, w[i:j]]}
    out = []
    for (g, w), a in found.items():
        if (g, w) not in gone:
            score, _, l, r = min((2_000_000 * a // (f[g, w[:k]] + f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
            out.append((g, " ".join(w), a, l, r, n[g], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    seen = Counter()
    ranked = []
    for g, *rest in out:
        seen[g] += 1
        if seen[g] <= top:
            ranked.append((g, seen[g], *rest))
    return ranked, f, n


def table(spark, rows):
    return spark.createDataFrame([(None if i % 5 else i, t, g, "x", 1, "y", 2, 3) for i, (t, g) in enumerate(rows)], KINDS)


def random_rows():
    rng = random.Random(11)
    words = ["New", "york", "new", "the", "of", "é", "漢字", "a.b", "x\ty", "city", "State", "state!", " q", "united", "\x00", "z;"]
    rows = [(" ".join(rng.choice(words[:rng.choice([4, 16])]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), ("...", "fr"), ("new york city state", "en")] + [("same text again and again", "en")] * 7 + [(LONG, "en")]


def test_equals_plain_counting(spark):
    rows = random_rows()
    for least, longest, top in ((3, 4, 2000), (2, 5, 9), (4, 2, 50)):
        want, _, _ = plain(rows, least, longest, top)
        got = collocations(table(spark, rows).repartition(3), least, longest, top).collect()
        assert sorted(map(tuple, got)) == sorted(want)
        assert len(want) > 10


def test_frequencies_hold_rare_words_in_the_total_only(spark):
    rows = random_rows()
    _, f, n = plain(rows, 3, 4, 10)
    got = {(r.lang, r.phrase): r.f for r in frequencies(table(spark, rows), 3).collect()}
    assert got == {(g, " ".join(w)): a for (g, w), a in f.items() if a >= 3} | {(g, ""): a for g, a in n.items() if a}


def test_colliding_fingerprints_are_told_apart():
    part = Slice(pa.array(["a b a b c b", "c b"]), pa.array(["en", "fr"]))
    at, _ = part.prints(2)
    prints, first, counts = part.different(at, np.zeros(len(at), np.uint64), 2)     # all under one fingerprint
    named = Counter()
    for i, k in zip(first.tolist(), counts.tolist()):
        named[" ".join(part.vocabulary[int(c)].as_py().decode() for c in part.codes[i:i + 2]), int(part.text[i])] += k
    assert named == {("a b", 0): 2, ("b a", 0): 1, ("b c", 0): 1, ("c b", 0): 1, ("c b", 1): 1} and not prints.any()


def test_empty_table(spark):
    assert collocations(table(spark, [("x", "en")]).limit(0)).collect() == []
    assert collocations(table(spark, [(None, "en"), ("", None)])).collect() == []
