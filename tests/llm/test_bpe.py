import random

import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F

from retenta.llm.bpe import PrefixEncoder, decode, encode, read_ranks
from tests.llm.helpers import EDGE, frame

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return PrefixEncoder(read_ranks(PATH))


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def rule_merge(ranks, data):
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 60:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return tuple(ranks[p] for p in parts)


def test_every_prefix_is_encoded_as_by_merging(encoder):
    rng = random.Random(3)
    pieces = ["a", "e", "th", "ion", "ing", "é", "ß", "漢", "!!", "  ", "aa", "x1"]
    for _ in range(150):
        data = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))).encode()
        last = encoder.last_tokens(data)
        for end in range(1, len(data) + 1):
            assert encoder.tokens(data[:end], last[:end]) == rule_merge(encoder.ranks, data[:end])


def test_append_and_edit_equal_a_new_table(encoder):
    rng = random.Random(5)
    for _ in range(200):
        data = "".join(rng.choice("abehint ioné") for _ in range(rng.randint(0, 400))).encode()
        last = encoder.last_tokens(data)
        assert encoder.append(data, last, b"ing more")[1] == encoder.last_tokens(data + b"ing more")
        a, b = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
        edited, table = encoder.edit(data, last, a, b, rng.choice([b"", b"x", b"theion"]))
        assert edited == data[:a] + edited[a:len(edited) - len(data) + b] + data[b:]
        assert table == encoder.last_tokens(edited)


def test_texts_are_encoded_as_by_the_library_and_decoded(spark, library):
    docs = frame(spark, EDGE)
    rows = encode(docs, PATH, public.PATTERN, decoded=True)
    got = sorted((str(r.doc_id), tuple(r.ids), bytes(r.decoded)) for r in rows.collect())
    assert got == sorted((str(i), tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in EDGE)
    back = decode(rows, PATH).agg(F.sum(F.length("decoded"))).first()[0]
    assert back == sum(len((t or "").encode()) for _, t in EDGE)


def test_real_documents_and_empty_table(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encode(docs, PATH, public.PATTERN).collect():
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id])
    assert encode(docs.limit(0), PATH, public.PATTERN, decoded=True).collect() == []
