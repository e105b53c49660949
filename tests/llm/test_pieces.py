from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from flowsight.llm import pieces
from flowsight.llm.queries import op12_piece_encoding

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "▁", "é", "𠀀", "\n", "\x00", "th", "e", "ing", " the", "<s>", "<0x41>", "²", ".", "1", "́", "한"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return file.read()


def encode(library, text):
    return library.encode(text, add_bos=True, add_eos=True)


def test_agenda_gives_the_library_s_ids(library, model):
    rng = random.Random(2)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000)] + ["ab" * 20_000, " " * 501, "x" * 777]
    segments = pieces._Segments(pieces.Vocabulary(model))
    ids, decoded = pieces._encoded(texts, segments)
    for text, i, shown in zip(texts, ids, decoded):
        want = encode(library, text)
        assert list(struct.unpack(f"<{len(i) // 4}I", i)) == want
        assert shown == library.decode(want)


def test_whole_texts_give_the_same_as_segments(library, model):
    vocabulary = pieces.Vocabulary(model)
    text = "The second. 1st of  many,\n\nwith ümläuts² and ▁ marks"
    whole = vocabulary.merge(vocabulary.marked(text))
    parts = [i for s in vocabulary.segments.findall(vocabulary.marked(text)) for i in vocabulary.merge(s)]
    assert whole == parts == library.encode(text)
    assert [w for p in vocabulary.ids for w in [vocabulary.segments.findall(p)] if len(w) > 1] == []


def test_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_CHARS", 50)
    segments = pieces._Segments(pieces.Vocabulary(model))
    texts = [f"word{i} and word{i + 1}" for i in range(200)]
    assert pieces._encoded(texts, segments) == pieces._encoded(texts, pieces._Segments(pieces.Vocabulary(model)))
    assert sum(map(len, segments)) < 100


def test_any_ids_decode_like_the_library(library, model):
    rng, vocabulary = random.Random(4), pieces.Vocabulary(model)
    odd = [0, 1, 2, 28705, 264, 13, 259, 260, 243, 163, 131, 130]
    for _ in range(4000):
        ids = [rng.choice([*odd, rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert vocabulary.decode(ids) == library.decode(ids)


def test_other_models_are_refused(model):
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Vocabulary(b"")


def test_nulls_empties_copies_and_clashing_columns(spark, make_docs, library):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x"), (9, "long " * 50_000)]
    docs = make_docs(rows).selectExpr("*", "'mine' AS ids", "'mine' AS decoded", "1.5 AS agrees")
    found = pieces.encode_documents(docs, PATH, check=True)
    assert set(found.columns) == set(docs.columns)
    got = sorted((r.doc_id or 0, r.text or "", r.ids, r.decoded, r.agrees) for r in found.collect())
    assert got == sorted((i or 0, t or "", encode(library, t or ""), t or "", True) for i, t in rows)
    assert pieces.encode_documents(make_docs([]), PATH).collect() == []
    assert pieces.token_report(make_docs([]), PATH).collect() == []


def test_query_equals_the_library(spark, sf_dir, library):
    got = {r[0]: tuple(r)[1:] for r in op12_piece_encoding(spark, sf_dir).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = encode(library, r.text or "")
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want[r.doc_id] = (len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest(), True)
    assert got == want
