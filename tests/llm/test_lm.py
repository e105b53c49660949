from __future__ import annotations

import math
import resource
from collections import Counter

import numpy as np
import pytest

from flowsight.llm import lm


def text_of(rng, n):
    """Words that follow a cycle, so that context tells the next one."""
    start = int(rng.integers(6))
    return " ".join(f"W{(start + k) % 6}" if rng.random() < 0.9 else f"r{rng.integers(300)}" for k in range(n))


def base(train, text):
    counts = Counter(w for t in train for w in lm.tokens((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    ws = lm.tokens((text or "").encode())
    return len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)


@pytest.fixture(scope="module")
def small():
    counts = sorted(Counter({f"w{k}".encode(): 200 // (k + 1) + 1 for k in range(50)}).items(), key=lambda x: -x[1])
    return lm.Vocabulary(counts, sum(c for _, c in counts) + 30, 70, head=40, classes=5)


def test_base_scores_match_brute_force_with_few_known_words(make_docs):
    rng = np.random.default_rng(1)
    train = [(k, text_of(rng, int(rng.integers(1, 60)))) for k in range(30)]
    other = [(100, None), (101, ""), (102, "w1 W2 unseen é " * 30), (103, text_of(rng, 500)), (103, text_of(rng, 20))]
    docs = make_docs([*train, *other])
    rows = lm.score_documents(docs, docs.where("doc_id < 100"), known=10, rounds=1).collect()
    assert len(rows) == 35
    for doc_id, text in [*train, *other[:3]]:
        r = next(r for r in rows if r.doc_id == doc_id)
        size, known, n, score = base([t for _, t in train], text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (size, known, n)
        assert r.base_score == pytest.approx(score, rel=1e-9)
    assert sorted(r.n_tokens for r in rows if r.doc_id == 103) == [21, 501]


def test_beats_the_base_on_held_out_text(make_docs):
    rng = np.random.default_rng(2)
    docs = make_docs([(k, text_of(rng, 80)) for k in range(150)])
    rows = lm.score_documents(docs, docs.where("doc_id < 120"), rounds=4).collect()
    held = [r for r in rows if r.doc_id >= 120]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_probabilities_add_up_to_one(small):
    w = lm.first_weights(small, hidden=6)
    hidden = np.random.default_rng(0).normal(size=(1, 6)).astype(np.float32)
    ids = np.arange(small.rare + 1)
    total = np.exp(lm.log_likelihoods(w, small, np.repeat(hidden, len(ids), 0), ids)).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_gradients(small):
    w = {k: v.astype(np.float64) for k, v in lm.first_weights(small, hidden=4).items()}
    rng = np.random.default_rng(1)
    text = rng.integers(0, small.rare + 1, 12)
    x, y = np.concatenate([[-1], text[:-1]])[:, None], text[:, None]
    got = {}
    trainer = lm.Trainer(w, small)
    trainer.apply = lambda g: got.update(g)
    trainer.window(x, y, np.ones_like(y, bool), np.zeros((1, 4)))
    loss = lambda weights: -lm.score_texts(weights, small, [text])[0] / len(text)
    for name, value in w.items():
        at = tuple(int(rng.integers(n)) for n in value.shape)
        if name == "E":
            at = (int(text[0]), 1)
        up, down = ({**w, name: value.copy()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert got[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-4), name


def test_state_is_carried_across_windows(small):
    w = lm.first_weights(small, hidden=6, seed=9)
    texts = [np.random.default_rng(k).integers(0, small.rare + 1, n).astype(np.int32) for k, n in enumerate((70, 1, 33, 0))]
    whole = lm.score_texts(w, small, texts, steps=1000)
    assert np.allclose(lm.score_texts(w, small, texts, steps=7), whole, rtol=1e-5)
    assert np.allclose([lm.score_texts(w, small, [t])[0] for t in texts], whole, rtol=1e-5)


def test_every_training_document_is_trained_on(make_docs, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(300, size=2000)) for _ in range(260)] + ["copy of one text"] * 60
    docs, given = make_docs(list(enumerate(texts))), Counter()
    map_arrow = lm.map_arrow

    def seen(df, function, schema):
        if schema.startswith("block int"):  # the input of a round's trainer
            given.update(r.text for r in df.collect())
        return map_arrow(df, function, schema)

    monkeypatch.setattr(lm, "map_arrow", seen)
    assert lm.score_documents(docs, docs).first().train_tokens == 260 * 2001 + 60 * 5
    assert given == Counter(texts)


def test_texts_of_unequal_length_are_trained_on_whole(small):
    texts = [np.random.default_rng(k).integers(0, small.rare + 1, n).astype(np.int32) for k, n in enumerate((700, 1, 33, 0, *[50] * 90))]
    trainer, seen = lm.Trainer(lm.first_weights(small, hidden=6), small), []
    window = trainer.window
    trainer.window = lambda x, y, live, state: seen.append((int(live.sum()), trainer.fill)) or window(x, y, live, state)
    trainer.texts(iter(texts))
    assert sum(n for n, _ in seen) == sum(map(len, texts))
    assert all(fill == n / (lm.UNROLL * lm.STREAMS) for n, fill in seen)


def test_a_training_window_takes_no_new_pages(small):
    """Large arrays of a window lie where those of the last one lay; fresh pages in each cost as much as the arithmetic."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, small.rare + 1, (2, lm.UNROLL, lm.STREAMS))
    trainer = lm.Trainer(lm.first_weights(small), small)
    step = lambda: trainer.window(x, y, np.ones_like(x, bool), np.zeros((lm.STREAMS, lm.HIDDEN), np.float32))
    for _ in range(5):
        step()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(20):
        step()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 20 * 20


def test_steps_match_plain_formulas(small):
    """Segments of words and batches of classes give the gradients of one token at a time; large weights take the shifted way."""
    for size in (1, 300):
        w = {k: v.astype(np.float64) * (size if k in "CO" else 1) for k, v in lm.first_weights(small, hidden=4).items()}
        rng = np.random.default_rng(4)
        x, y = rng.integers(0, small.rare + 1, (2, 9, 5))
        x[0], live = -1, rng.random((9, 5)) < 0.8
        got, sums = {}, {}
        trainer = lm.Trainer(w, small)
        trainer.apply = lambda g: got.update({k: v.copy() for k, v in g.items()})  # noqa: B023
        hidden = rng.uniform(-1, 1, (45, 4))
        back = trainer.outcomes(sums := {k: np.zeros_like(v) for k, v in w.items()}, hidden, y.ravel(), np.empty_like(hidden))
        one = {k: np.zeros_like(v) for k, v in w.items()}
        for k in range(45):
            mine = {j: np.zeros_like(v) for j, v in w.items()}
            assert np.allclose(trainer.outcomes(mine, hidden[k : k + 1], y.ravel()[k : k + 1], np.empty((1, 4))), back[k])
            one = {j: one[j] + mine[j] for j in one}
        assert all(np.allclose(one[k], sums[k]) for k in one)
        trainer.window(x, y, live, np.zeros((5, 4)))
        assert all(np.isfinite(v).all() for v in got.values())
        unseen = np.setdiff1d(np.arange(small.rare + 1), x)
        assert not got["E"][unseen].any() and (size > 1 or got["E"][np.unique(x[x >= 0])].any(1).all())


def test_empty_tables(make_docs):
    docs = make_docs([(1, "a")])
    row = lm.score_documents(docs, docs.limit(0)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (2, 0, 0)
    assert lm.score_documents(docs.limit(0), docs).collect() == []
