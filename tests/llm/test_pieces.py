import random

import public_tokenizers as public
import pytest
from sentencepiece import SentencePieceProcessor

from retenta.llm.pieces import PieceEncoder, decode, differences, encode
from tests.llm.helpers import EDGE, frame

PATH = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(PATH)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def test_agenda_equals_the_library_on_odd_texts(encoder, library):
    rng = random.Random(7)
    parts = ["a", "the", " ", "  ", "     ", "\n", "\t", "▁", "é", "ß", "漢字", "\U0001f600", "\x00", "�", "<s>", "<0x41>", "ing", "aaaa",
             " ", "é", "x" * 40, "12345", "!!!", "\r\n", "<unk>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)] + [" ", "  ", "a ", " a", "▁", "▁▁ "]
    ids, agrees = encoder.encode(texts, check=True)
    assert all(agrees)
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert [encoder.decode(x.tolist()) for x in ids] == library.decode([x.tolist() for x in ids])
    flat, begins, _ = encoder.encoded(texts)
    assert encoder.decoded(flat, begins).to_pylist() == library.decode([x.tolist() for x in ids])


def test_any_ids_decode_as_by_the_library(encoder, library):
    rng = random.Random(8)
    known = [0, 1, 2, 3, 100, 131, 198, 230, 258, 259, 260, 261, 262, 28705, 400, 5000, 20000]
    for _ in range(400):
        ids = [rng.choice(known) for _ in range(rng.randint(0, 12))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_long_stretch_without_spaces(encoder, library):
    text = "abcde" * 30_000
    assert encoder.encode([text])[0][0].tolist() == library.encode(text)


def test_a_full_table_is_emptied_without_harm(encoder, library, monkeypatch):
    monkeypatch.setattr("retenta.llm.pieces.REMEMBERED", 3)
    for text in ("one two three four", "five six", "one two"):
        assert encoder.encode([text])[0][0].tolist() == library.encode(text)


def test_edge_rows_and_round_trip(spark, library):
    docs = frame(spark, EDGE)
    rows = encode(docs, PATH, decoded=True).collect()
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in rows) == \
        sorted((str(i), tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in EDGE)
    assert all(r.agrees for r in rows)
    back = {(str(r.doc_id), r.decoded) for r in decode(encode(docs, PATH), PATH).collect()}
    assert back == {(str(r.doc_id), r.decoded) for r in rows}
    assert encode(docs.limit(0), PATH, decoded=True).collect() == []


def test_real_documents(spark, data):
    assert differences(spark.read.parquet(f"{data}/documents.parquet"), PATH).collect() == []


def test_other_kinds_of_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        PieceEncoder(str(tmp_path / "m"))
