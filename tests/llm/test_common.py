from __future__ import annotations

import gc
import weakref

import public_tokenizers
import pyarrow as pa
import pytest

from flowsight.llm import common, near_dup, packing, quality
from flowsight.llm.common import pooled


def test_pools_are_bounded_whatever_the_batches():
    texts = ["x" * 100] * 500 + ["y" * 50_000] + [None, ""] * 10 + ["z" * 30] * 700
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    pools = list(pooled([batch.slice(0, 900), batch.slice(900), batch.slice(0, 0)], 4_000))
    assert [r for p in pools for r in p.column("text").to_pylist()] == texts
    assert [r for p in pools for r in p.column("doc_id").to_pylist()] == list(range(len(texts)))
    sizes = [p.nbytes for p in pools if p.num_rows > 0 and max(len(t or "") for t in p.column("text").to_pylist()) < 50_000]
    assert max(sizes) <= 8_000
    assert list(pooled([], 10)) == []


def test_a_worker_remembers_for_one_operator_only():
    """Caches of a stage must not lie in a reused worker while another stage runs there."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words = weakref.ref(packing._word_ids(path))
    assert packing._word_ids(path) is words()
    near_dup.shingle_set(b"a b c")
    gc.collect()
    assert words() is None
    hashes = weakref.ref(common.remembered("word hashes", near_dup.WordHashes))
    assert len(hashes()) == 3
    list(quality._count(iter([])))
    gc.collect()
    assert hashes() is None


@pytest.mark.parametrize("make", [lambda d: near_dup.sketches(d, near_dup.np.zeros(0, "i8")), near_dup.full_sets, quality.count_texts])
def test_a_batch_is_worked_on_in_slices(make_docs, monkeypatch, make):
    """A batch may hold all rows of a task; the sets or sketches of all its texts must not lie in memory together."""
    functions = []
    for module in (near_dup, quality):
        monkeypatch.setattr(module, "map_arrow", lambda df, function, schema: functions.append(function))
    make(make_docs([(1, "a")]))
    texts = ["one two three four five six " * 2000] * 300
    columns = {"doc_id": pa.array(range(300)), "text": pa.array(texts), "lang": pa.array(["en"] * 300), "source": pa.array(["s"] * 300)}
    out = list(functions[0](iter([pa.RecordBatch.from_pydict(columns)])))
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(300))
    assert max(b.num_rows * len(texts[0]) for b in out) <= common.SLICE_BYTES
