from __future__ import annotations

import re

import numpy as np

from flowsight.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    ws = WORD.findall(text or "")
    lines = (text or "").split("\n")
    with_word = [x for x in lines if WORD.search(x)]
    windows: dict[tuple, list[int]] = {}
    for k in range(len(ws) - 7):
        windows.setdefault(tuple(ws[k : k + 8]), []).append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(ws), sum(map(len, ws)), symbols, len(with_word) - len(set(with_word)), len(repeated)


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n)).capitalize() + "."


def test_counts_match_brute_force(make_docs):
    rng = np.random.default_rng(1)
    loop = "one two three four five six seven eight nine ten "
    texts = ["", None, loop * 5, "x " * 30, "a\n\na\n a\nb\r\nb\r\n", "é # | <b>\x0bß\x1cz", prose(rng, 300), loop + "gap " + loop, "A" * 5000]
    docs = list(enumerate(texts))
    found = {r.doc_id: r for r in q.count_texts(make_docs(docs)).collect()}
    for k, text in docs:
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text), text


def test_outliers_go_and_clean_documents_stay(make_docs):
    rng = np.random.default_rng(2)
    docs = [(k, prose(rng, int(rng.integers(25, 400))), "en" if k % 3 else "fr", "big" if k % 2 else f"s{k % 7}") for k in range(900)]
    junk = [(1000 + k, " ".join(f"{w}%%%" for w in prose(rng, 80).split()), "en", "big") for k in range(20)]
    short = [(2000, "too short", "en", "big"), (2001, None, None, None), (2002, "go " * 100, "en", "big")]
    rows = {r.doc_id: r for r in q.judge(make_docs([*docs, *junk, *short]), least_rows=100).collect()}
    assert all(rows[k].kept for k, *_ in docs)
    assert not any(rows[k].kept or rows[k].base_failed for k, *_ in junk)
    assert all(rows[k].base_failed and not rows[k].kept and rows[k].distance is None for k, *_ in short)


def test_small_groups_are_judged_by_their_whole_language_or_corpus(make_docs):
    rng = np.random.default_rng(5)
    docs = [(k, prose(rng, int(rng.integers(25, 400))), "fr", "hot") for k in range(400)]
    alone = [(1000, prose(rng, 80), "fr", "a"), (1001, prose(rng, 200), "fr", "b"), (1002, prose(rng, 90), "de", "a")]
    junk = [(2000 + k, " ".join(f"{w}%%%" for w in prose(rng, 80).split()), lang, source) for k, (lang, source) in enumerate([("fr", "c"), ("de", "c"), (None, None)])]
    rows = {r.doc_id: r for r in q.judge(make_docs([*docs, *alone, *junk])).collect()}
    assert all(rows[k].kept for k, *_ in [*docs, *alone])
    assert not any(rows[k].kept or rows[k].base_failed for k, *_ in junk)


def test_estimate_resists_contamination(spark):
    rng = np.random.default_rng(4)
    p = len(q.STATS)
    good, bad = rng.normal(0, 1, (1600, p)), rng.normal(12, 0.1, (300, p))
    rows = [(k, "a", [float(v) for v in x]) for k, x in enumerate([*good, *bad])]
    fit = q.estimate(spark.createDataFrame(rows, "doc_id long, key string, x array<double>"), sample=500).first()
    assert np.abs(np.array(fit.centre)).max() < 0.3
    assert fit.scale >= 1


def test_keep_good_and_empty_tables(make_docs):
    docs = make_docs([(1, " ".join(f"w{k}" for k in range(50))), (1, None), (2, "x"), (None, "y")])
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1]
    assert q.judge(docs.limit(0)).collect() == []
    assert q.judge(make_docs([(2, "x")])).first().base_failed


def test_a_group_of_equal_rows_loses_none(spark, make_docs):
    """More equal rows than the sample holds, whether their hash is picked or not."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(7, text, "en", "hot")] * 900 + [(8, f"{text} more", "fr", "hot")] * 900 + [(100 + i, f"{text} {i}", "en", "cold") for i in range(30)]
    judged = q.judge(make_docs(rows), least_rows=20, sample=5)
    assert judged.count() == len(rows)
    assert judged.where("doc_id < 9").select("doc_id", "kept").distinct().count() == 2
