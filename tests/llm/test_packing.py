from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowsight.llm import packing as p

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_plan_places_all_and_is_tight():
    rng = np.random.default_rng(3)
    for _ in range(10):
        sizes = rng.integers(1, 101, 300)
        values, counts = np.unique(sizes, return_counts=True)
        plan = p.plan_bins(dict(zip(values.tolist(), counts.tolist(), strict=True)), 100)
        assert all(sum(k * n for k, n in use.items()) <= 100 for _, use in plan)
        placed = {int(v): sum(t * use.get(int(v), 0) for t, use in plan) for v in values}
        assert placed == dict(zip(values.tolist(), counts.tolist(), strict=True))
        assert sum(t for t, _ in plan) <= max(-(-sizes.sum() // 100), (sizes > 50).sum()) + 6


def test_fullest_finds_the_exact_fill():
    assert p.fullest({70: 1, 20: 1, 15: 2, 9: 1}, 100) == {70: 1, 15: 2}
    assert p.fullest({60: 3}, 100) == {60: 1}
    assert p.fullest({100: 1, 1: 5}, 100) == {100: 1}


def test_pieces_round_trip(make_docs):
    long_text = "Über naïve words, 12 3.5 don't <|endoftext|> \x1c x y ź " * 40
    docs = [(1, "Hello  World"), (2, None), (3, ""), (4, long_text), (5, "a" * 3000), (6, "Hello  World"), (6, "Hello  World"), (None, "x")]
    rows = p.pack_documents(make_docs(docs), PATH, window=256, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    for doc_id, text in docs:
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = [r for r in rows if r.doc_id == doc_id]
        copies = sum(d == (doc_id, text) for d in docs)
        assert len(mine) == copies * -(-len(want) // 256)
        for r in mine:
            part = want[r.start : r.start + r.length]
            assert (r.start, bytes(r.ids), r.ids_crc32) == (256 * r.piece, part.tobytes(), zlib.crc32(part.tobytes()))
    check_places(rows, 256)


def check_places(rows, window):
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window


def test_many_equal_lengths_over_partitions(make_docs):
    rows = p.pack_documents(make_docs([(k, "a b c") for k in range(200)], partitions=7), PATH, window=10).collect()
    check_places(rows, 10)
    assert len({r.sequence_id for r in rows}) == 100


def test_empty_table(make_docs):
    assert p.pack_documents(make_docs([(1, "a")]).limit(0), PATH).collect() == []
