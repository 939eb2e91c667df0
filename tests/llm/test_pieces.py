import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from plain import DOCS, clashing, frame, rows

from quotemill.llm import pieces as P
from quotemill.llm.common import prepare, resident
from quotemill.llm.queries import piece_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def strange(n=1500, seed=3):
    rnd = random.Random(seed)
    few = list("abc the  \n\téßñ漢字😀▁.,!0123")
    wide = lambda: chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x24F), rnd.randint(0x4E00, 0x9FFF), rnd.randint(0x1F300, 0x1F6FF)]))
    yield from ("", " ", "  ", "\n", "<s>", "</s> x", "<0x0A>", "▁▁a", "     x     ", "a" * 300, " " * 50, "\u0000a", "\U0010ffff")
    for _ in range(n):
        yield "".join(rnd.choice(few) for _ in range(rnd.randint(1, 40)))
        yield "".join(wide() for _ in range(rnd.randint(1, 25)))


def test_encoding_and_decoding_equal_the_library(library):
    model = P.PieceModel(PATH)
    for text in strange():
        ids = library.encode(text)
        assert model.encode(text).tolist() == ids, text
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids), text


def test_decoding_any_ids_equals_the_library(library):
    model, rnd = P.PieceModel(PATH), random.Random(5)
    for _ in range(1500):
        ids = [rnd.choice([rnd.randint(0, 300), rnd.randint(0, 31_999)]) for _ in range(rnd.randint(0, 12))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_full_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(P, "YOUNG_CHUNKS", 5)
    monkeypatch.setattr(P, "PAIR_SLOTS", 4)
    monkeypatch.setattr(P, "GROUP_CHARS", 40)
    model, texts = P.PieceModel(PATH), list(strange(300, seed=9))
    for _ in range(2):
        assert [ids.tolist() for ids in model.encode_all(texts)] == [library.encode(t) for t in texts]
    assert len(model.known.young) <= 5 and len(model.known.old) <= 100


def test_long_cuts_are_walked_alone(library):
    model = P.PieceModel(PATH)
    for text in ["ab" * 3000, "漢字" * 2000, "x" * 63, "x" * 64, "x" * 65, "aaaa" * 500 + "\U0001F600" * 300, "the" * 200 + "\0" + "ing" * 200, ("word" * 30 + " ") * 50]:
        assert model.encode(text).tolist() == library.encode(text), text[:20]


def test_cuts_cross_no_piece():
    model = P.PieceModel(PATH)
    for t in model.id:
        if not t.startswith(P.MARK):
            assert len(model.cuts(t)) == 1, t
        else:
            assert model.cuts(t)[0] == t, t
    for text in strange(200, seed=4):
        assert "".join(model.cuts(text.replace(" ", P.MARK))) == text.replace(" ", P.MARK)


def test_a_worker_keeps_no_text_after_a_task_and_no_model_after_the_operator(library):
    texts = list(strange(50, seed=6))
    for task, ids in ((P._each_round, lambda out: out.field("ids")), (P._each_text, lambda out: out)):
        batches = task(PATH)(iter([pa.array(texts), pa.array(texts[:9])]))
        assert ids(next(batches)).to_pylist() == [library.encode(t) for t in texts]
        model = P._models[PATH]
        assert model.known.young
        assert ids(next(batches)).to_pylist() == [library.encode(t) for t in texts[:9]]
        assert list(batches) == [] and P._models[PATH] is model
        assert not model.known.young and not model.known.old and not model.merges
    resident("another")
    assert not P._models


def test_frames(spark, library):
    docs = clashing(frame(prepare(spark)))
    coded, ids, back = P.round_trip(docs, PATH)
    assert coded.columns == [*docs.columns, ids, back] and "ids" != ids
    got = sorted((repr((r.doc_id, r.text)), tuple(r[ids]), r[back]) for r in coded.collect())
    assert got == sorted((repr((d[0], d[1])), tuple(library.encode(d[1] or "")), library.decode(library.encode(d[1] or ""))) for d in rows())
    apart = P.decode(P.encode(docs, PATH, out="a"), PATH, "a", "b")
    assert sorted((repr((r.doc_id, r.text)), tuple(r.a), r.b) for r in apart.collect()) == got
    assert piece_digests(*P.round_trip(spark.createDataFrame([], DOCS), PATH)).count() == 0
