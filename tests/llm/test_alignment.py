import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from retenta.llm import alignment
from retenta.llm.alignment import align, index, members, pair_counts, planes_of, popcounts
from tests.llm.helpers import EDGE, frame

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain(rows, libraries):
    """Whole texts through the libraries, byte by byte."""
    a, b = libraries
    plain_letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in plain_letters}
    letters |= {chr(0x100 + k): x for k, x in enumerate(x for x in range(256) if x not in plain_letters)}
    out, links = [], []
    for doc, text in rows:
        found, groups = [], []
        if text:
            x = a.encode(" " + text, add_special_tokens=False)
            xs = [(i, bytes(letters[c] for c in t)) for i, t in zip(x.ids, x.tokens)]
            ys = []
            for i in b.encode(text):
                piece = b.id_to_piece(i)
                ys.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
            data = (" " + text).encode()
            if b"".join(t for _, t in xs) == data == b"".join(t for _, t in ys):
                owner_a, owner_b = ([k for k, (_, t) in enumerate(ts) for _ in t] for ts in (xs, ys))
                found = [(xs[p][0], ys[q][0]) for p, q in sorted(set(zip(owner_a, owner_b)))]
                ends = [set(np.cumsum([len(t) for _, t in ts]).tolist()) for ts in (xs, ys)]
                start = 0
                for end in sorted(ends[0] & ends[1]):
                    one = [sorted({o[k] for k in range(start, end)}) for o in (owner_a, owner_b)]
                    groups.append(",".join(str(xs[k][0]) for k in one[0]) + "|" + ",".join(str(ys[k][0]) for k in one[1]))
                    start = end
            else:
                xs = ys = []
        else:
            xs = ys = []
        out.append((doc, len(xs), len(ys), len(groups), ";".join(groups)))
        links.append(found)
    counts = Counter(p for f in links for p in f)
    docs = Counter(p for f in links for p in set(f))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = [(d, na, nb, ng, len(f), sum(counts[p] == most[p[1]] for p in f), sum(counts[p] for p in f), g)
            for (d, na, nb, ng, g), f in zip(out, links)]
    return rows, counts, docs


def key(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1:]))


ODD = [(20, "<|endoftext|> and <s> <0x41>"), (21, "a literal ▁ mark"), (22, "trailing space "), (23, " leading"), (24, "two  spaces\n next"),
       (25, "漢字 é x   y"), (26, "tab\t tab \x1c y"), (27, "don't we'll x's"), (28, "\U0001f600 smile 12345 67")]


def test_equals_whole_texts_through_the_libraries(spark, libraries):
    rows = EDGE + ODD
    want, counts, docs = plain(rows, libraries)
    got = align(frame(spark, rows), A, B).collect()
    assert key([tuple(r) for r in got]) == key(want)
    assert align(frame(spark, rows).limit(0), A, B).collect() == []
    pairs = pair_counts(index(frame(spark, rows), A, B)).collect()
    assert {(r.a, r.b): r.n_links for r in pairs} == dict(counts)
    assert {(r.a, r.b): r.n_docs for r in pairs} == dict(docs)


def test_documents_and_small_blocks(spark, data, libraries):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want, _, _ = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], libraries)
    assert key([tuple(r) for r in align(docs.repartition(3), A, B, postings=5000).collect()]) == key(want)
    got = align(docs, A, B, digest=True).select("doc_id", "groups").collect()
    assert dict(map(tuple, got)) == {r[0]: hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in want}


def test_random_texts_are_cut_without_change(libraries):
    class Direct(alignment.Aligner):
        def __init__(self):
            import retenta.llm.pieces as pieces
            pieces._ENCODERS.setdefault("direct", pieces.PieceEncoder(B))
            super().__init__(A, "direct")

    rng, parts = random.Random(4), ["a", " ", "  ", "\n", "the", "'s", "▁", "é", ",", ".", "²", "_", "x", "³.", " ", " ", "1", "!", "\x85", "\x1f", "漢"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    totals, written, _, _ = Direct().align(texts)
    want, _, _ = plain(list(enumerate(texts)), libraries)
    assert [(int(a), int(b), int(c), int(d), w) for (a, b, c, d), w in zip(totals, written)] == [(r[1], r[2], r[3], r[4], r[7]) for r in want]


def test_planes_hold_sparse_dense_and_large_numbers():
    rng = np.random.default_rng(1)
    held = {}
    for code, n, most in ((5, 3, 1), (7 << 15 | 9, 30_000, 9), (8 << 15, 5_000, 2), (9 << 15 | 1, 1, 1_000_000), (10 << 15, 4_096, 1)):
        for slot in rng.choice(1 << 16, n, replace=False):
            held[code << 16 | int(slot)] = int(rng.integers(1, most + 1))
    keys = np.array(sorted(held), dtype=np.uint64)
    batch = planes_of(keys, np.array([held[int(k)] for k in keys]), 15, 3)
    for planes, first in ((batch.column("planes"), 0), (batch.slice(1, 3).column("planes"), 1)):
        row, plane, place = members(planes)
        back = Counter()
        for r, p, at in zip(row.tolist(), plane.tolist(), place.tolist()):
            code = batch.column("a")[r + first].as_py() << 15 | batch.column("b")[r + first].as_py()
            back[code << 16 | at] += 1 << p
        wanted = {k: v for k, v in held.items() if (k >> 16) in {batch.column("a")[first + i].as_py() << 15 | batch.column("b")[first + i].as_py() for i in range(len(planes))}}
        assert dict(back) == wanted
        docs, links = popcounts(planes)
        assert docs.sum() == len(wanted) and links.sum() == sum(wanted.values())
    assert popcounts(pa.array([], pa.list_(pa.binary())))[0].tolist() == []
