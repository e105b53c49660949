from __future__ import annotations

import hashlib
import random
from fractions import Fraction

from flowsight.llm import periods
from flowsight.llm.queries import op11_periodic_runs, planted


def brute(words):
    """Every run by comparing the words at every distance: (start, length, period), by start and then period."""
    found = {}
    for period in range(1, len(words) // 4 + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            if (length := j - i + period) >= max(6, 4 * period):
                found.setdefault((i, length), period)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_report(words):
    runs = brute(words)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    exponent = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())


def random_words(rng):
    n, letters = rng.choice([0, 1, 5, 6, 7, 24, 70, 160]), rng.choice([1, 2, 3, 9])
    words = [b"w%d" % rng.randrange(letters) for _ in range(n)]
    if n > 10 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 4))
        words = words[:a] + [words[a + i % p] for i in range(n - a)]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(n)] = b"x"
    return words


def test_pools_give_all_runs():
    rng = random.Random(5)
    for _ in range(400):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        texts += [list(texts[0])] * rng.randint(0, 3)
        found = [sorted(zip(*map(list, r)), key=lambda r: (r[0], r[2])) for r in periods.pool_runs(texts)]
        assert found == [brute(t) for t in texts]


def test_occurrences_form_progressions_in_long_texts():
    same, three = [b"a"] * 5000, [b"a", b"b", b"c"] * 1500 + [b"z"]
    assert [list(zip(*map(list, r))) for r in periods.pool_runs([same, three])] == [[(0, 5000, 1)], [(0, 4500, 3)]]


def test_nulls_empties_copies_and_clashing_columns(spark, make_docs):
    text = "x " + "a b " * 6 + "y"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, text), (4, text), (None, text), (7, "q " * 3000)]
    docs = make_docs(rows).selectExpr("*", "'mine' AS runs", "'mine' AS collapsed", "'b' AS start")
    found = periods.find_runs(docs)
    assert set(found.columns) == set(docs.columns)
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed, r.start) for r in found.collect())
    run = [(1, 12, 2)]
    assert got == [(0, run, "x a b y", "b"), (1, [], "", "b"), (2, [], "", "b"), (3, [], "", "b"), (4, run, "x a b y", "b"),
                   (4, run, "x a b y", "b"), (7, [(0, 3000, 1)], "q", "b")]
    assert periods.run_report(periods.find_runs(make_docs([]))).collect() == []


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r[0]: tuple(r)[1:] for r in op11_periodic_runs(spark, sf_dir).collect()}
    assert got == {i: brute_report(planted(i, (t or "").encode().split())) for i, t in texts.items()}
    assert any(r[0] for r in got.values())
