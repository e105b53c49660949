from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from flowsight.llm import toxicity as t


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 5, 1])
    odds = np.exp(rng.normal(0, 2, sizes.sum()))
    step, first = np.exp(rng.normal(0, 1, (2, 2))), 0.3
    chains = t.Chains(sizes)
    packed = np.empty(len(odds))
    packed[chains.place] = odds
    marginal, pairs = chains.marginals(packed, step, first)
    want, want_pairs = [], np.zeros((2, 2))
    for part in np.split(odds, np.cumsum(sizes)[:-1]):
        if not len(part):
            continue
        total, ones, both = 0.0, np.zeros(len(part)), np.zeros((2, 2))
        for labels in product((0, 1), repeat=len(part)):
            value = first if labels[0] else 1.0
            for k, y in enumerate(labels):
                value *= part[k] if y else 1.0
                value *= step[labels[k - 1], y] if k else 1.0
            total += value
            ones += value * np.array(labels)
            for a, b in zip(labels, labels[1:], strict=False):
                both[a, b] += value
        want += (ones / total).tolist()
        want_pairs += both / total
    assert np.allclose(marginal[chains.place], want)
    assert np.allclose(pairs, want_pairs)


def corpus(rng, n):
    docs, labels = [], []
    for k in range(n):
        ws = [f"w{rng.integers(300)}" for _ in range(int(rng.integers(5, 80)))]
        toxic = int(k % 6 == 0)
        for _ in range(3 * toxic):
            ws[int(rng.integers(len(ws)))] = str(rng.choice(["Idiot!", "scum,", "MORON"]))
        docs.append((k, " ".join(ws)))
        labels.append((k, toxic))
    return docs, labels


def test_held_out_documents_and_spans(spark, make_docs):
    docs, labels = corpus(np.random.default_rng(3), 600)
    odd = [(900, None), (901, ""), (902, "w1 " * 4000 + "you 😀 idiot scum"), (902, "w1")]
    table = spark.createDataFrame([*labels[:450], (899, 1), (5, None)], "doc_id long, toxic int")
    scored = t.score(make_docs([*docs, *odd]), t.train(make_docs(docs), table)).collect()
    found = {r.doc_id: r for r in scored if r.doc_id != 902}
    wrong = sum((found[k].score >= 0.5) != bool(toxic) for k, toxic in labels[450:])
    assert wrong <= 3
    assert found[900].score == found[901].score < 0.5 and found[900].spans == []
    long = max((r for r in scored if r.doc_id == 902), key=lambda r: r.expected)
    assert [odd[2][1][s.start : s.stop] for s in long.spans] == ["idiot scum"]
    assert all(0 <= r.score <= 1 for r in scored) and len(scored) == 604


def test_without_labels(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in t.score(docs, t.train(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1)], none.schema)
    assert {r.score for r in t.score(docs, t.train(docs, one)).collect()} == {1.0}
    assert t.score(docs.limit(0), t.train(docs, one)).collect() == []
    assert t.train(docs, one).prior == pytest.approx(1.0)


def test_gradients_of_tasks_add_up_to_those_of_all_chains():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["idiot", "fine", "day", "scum", "x"], int(rng.integers(1, 30)))) for _ in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts), pa.array([k % 2 for k in range(12)])], ["doc_id", "text", "toxic"])
    (chains,) = t._chain_rows({"w=idiot", "w=scum"}, 1.0)(iter([batch]))
    assert sum(chains.column("tokens").to_pylist()) == sum(len(x.split()) for x in texts)
    weights = rng.normal(0, 1, 1 << t.BITS) * (rng.random(1 << t.BITS) < 0.5)
    step = np.exp(rng.normal(0, 1, (2, 2)))

    def sums(batches):
        (row,) = t._gradients(weights, step, 0.4)(iter(batches))
        dense = np.zeros(1 << t.BITS)
        dense[np.frombuffer(row.column("at")[0].as_py(), "<i4")] = np.frombuffer(row.column("missing")[0].as_py(), "<f4")
        return dense, np.frombuffer(row.column("pairs")[0].as_py(), "<f8"), row.column("begun")[0].as_py()

    whole = sums([chains])
    parts = [sums([chains.slice(0, 5)]), sums([chains.slice(5)])]
    for k in range(3):
        assert np.allclose(whole[k], parts[0][k] + parts[1][k], atol=1e-5)
    assert sums([chains.slice(0, 0)])[2] == 0


def test_the_fit_is_bounded_by_bytes(spark, make_docs):
    docs, labels = corpus(np.random.default_rng(7), 300)
    docs += [(1000, "w1 w2 idiot " * 20_000)]
    table = spark.createDataFrame([*labels, (1000, 1)], "doc_id long, toxic int")
    field = t.train(make_docs(docs), table, fit_bytes=40_000)
    scored = {r.doc_id: r.score for r in t.score(make_docs(docs), field).collect()}
    assert sum((scored[k] >= 0.5) != bool(toxic) for k, toxic in labels) <= 15


def test_potentials_of_words_and_the_bounded_cache(monkeypatch):
    odd = [b"Idiot!", "ÄÖÜß-straße,".encode(), b"ab", b"--", "😀😀😀😀😀".encode(), b"\xff\xfe", b"x" * 5000]
    for w in odd:
        assert list(t.bins(w)) == [zlib.crc32(f.encode()) & ((1 << t.BITS) - 1) for f in t.features(w)]
    field = t.Field()
    field.weights = np.random.default_rng(2).normal(0, 3, 1 << t.BITS).astype(np.float32)
    texts = [[odd[k % 7] for k in range(n)] for n in (3, 0, 20)]
    want = [np.exp(np.clip(float(field.weights[list(t.bins(w))].astype(float).sum()), -30, 30)) for x in texts for w in x]
    assert np.allclose(list(field.odds(texts)), want)
    monkeypatch.setattr(t, "CACHED_BYTES", 100)
    assert np.allclose(list(field.odds(texts)), want) and np.allclose(list(field.odds(texts)), want)
    assert set(field.cache) == set(odd)
