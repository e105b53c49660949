from __future__ import annotations

import numpy as np

from flowsight.llm import near_dup as n


def brute(docs):
    def shingles(text):
        ws = (text or "").encode().translate(n.FOLD).split()
        width = min(5, len(ws))
        return {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if ws else set()

    sets = [(i, shingles(t)) for i, t in docs]
    label = {i: i for i, _ in docs}
    changed = True
    links = [(a, b) for a, x in sets for b, y in sets if a != b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sorted((i, len(s), label[i], label[i] == i) for i, s in sets)


def got(docs, **options):
    return sorted(tuple(r) for r in n.near_duplicates(docs, **options).collect())


def corpus(seed, groups=12):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(400)}"
    passage = [word() for _ in range(30)]
    docs = []
    for g in range(groups):
        base = [word() for _ in range(rng.integers(3, 120))]
        for _ in range(rng.integers(1, 7)):
            text = list(base)
            for _ in range(rng.integers(0, 4)):
                text[rng.integers(len(text))] = word()
            if g % 3 == 0:
                text = [*passage, *text]
            docs.append(" ".join(text).upper() if rng.integers(2) else "\n".join(text))
    order = rng.permutation(len(docs))
    return [(int(k), docs[j]) for k, j in enumerate(order)]


def test_matches_brute_force(make_docs):
    for seed in (1, 2):
        docs = [*corpus(seed), (900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One  TWO"), (905, "one three")]
        assert got(make_docs(docs)) == brute(docs)


def test_large_group_of_edited_copies(make_docs):
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(80)]
    docs = []
    for k in range(150):
        text = list(base)
        for _ in range(int(rng.integers(0, 6))):
            text[rng.integers(80)] = f"e{rng.integers(10**6)}"
        docs.append((k, " ".join(text)))
    assert got(make_docs(docs, partitions=5)) == brute(docs)


def test_repeated_rows_and_empty_table(make_docs):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None)]
    assert got(make_docs(docs)) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True)]
    kept = n.keep_first(make_docs(docs))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert kept.columns == make_docs(docs).columns
    assert got(make_docs(docs).limit(0)) == []


def test_retained_values_meet_for_every_link():
    rng = np.random.default_rng(2)
    frequent = np.arange(0, 60, 3)
    place = rng.permutation(len(frequent))
    for _ in range(300):
        a = set(rng.choice(200, rng.integers(1, 60), replace=False).tolist())
        b = set(a)
        for _ in range(rng.integers(0, 12)):
            b.discard(int(rng.integers(200)))
            b.add(int(rng.integers(200)))
        if 100 * len(a & b) >= 75 * len(a | b):
            kept = [n.retained(np.array(sorted(s), np.int64), frequent, place)[0].tolist() for s in (a, b)]
            overlap = -(-75 * (len(a) + len(b)) // 175)
            assert set(kept[0][: len(a) - overlap + 1]) & set(kept[1][: len(b) - overlap + 1])


def test_components(spark):
    edges = [(k + 1, k) for k in range(1, 40)] + [(100, 200), (200, 300), (150, 300)]
    found = {r.node: r.comp for r in n.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found.values()) == {1, 100} and len(found) == 44
    assert n.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_first_loses_no_text_that_shares_an_id(make_docs):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[0] + " a b c"), (5, texts[1] + " d e f"), (5, texts[1] + " d e f")]
    kept = n.keep_first(make_docs(rows))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted({(i or 0, t) for i, t in rows})
