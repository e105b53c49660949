from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from flowsight.llm import phrases


def brute(rows, least, top):
    """The contract, word by word: {lang: [(phrase, a, l, r, n, score)]}."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    result = {}
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((" ".join(p), a, left, right, totals[lang], score))
        result[lang] = sorted(kept, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top]
    return {lang: found for lang, found in result.items() if found}


def mined(df):
    found = {}
    for r in df.orderBy("lang", "rank").collect():
        assert r["rank"] == len(found.setdefault(r.lang, [])) + 1
        found[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    return found


@pytest.mark.parametrize("route_bytes", [200, 5000, 1 << 20])
def test_phrases_equal_brute_force_on_any_number_of_routes(spark, make_docs, route_bytes, monkeypatch):
    monkeypatch.setattr(phrases, "POOL_BYTES", 2000)
    rng = random.Random(route_bytes)
    common = ["the", "The", "of", "und", "ß", "È", "x\x01", "a\x0e"]
    rows = []
    for i in range(160):
        words = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\v"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "e\tn"]), "s"))
    rows += [(900, "copied words stand here often", "en", "s")] * 50
    want = brute([(lang, text) for _, text, lang, _ in rows], 5, 40)
    assert len(want) > 3 and all(len(found) > 5 for found in want.values())
    docs = make_docs(rows, partitions=5)
    assert mined(phrases.top_collocations(docs, top=40, least=5, route_bytes=route_bytes)) == want


def test_nulls_empties_and_empty_tables(spark, make_docs):
    rows = [(None, None, None, None), (1, "", "en", "s"), (2, " ., \t", "en", "s"), (3, "one", "en", "s")]
    assert phrases.top_collocations(make_docs(rows), least=1).collect() == []
    assert phrases.top_collocations(make_docs([])).collect() == []


def test_one_phrase_that_fills_everything(spark, make_docs):
    """One leading word, one very long text and many copies."""
    rows = [(0, "a b " * 30_000, "en", "s"), *[(i, "a b a c", "en", "s") for i in range(1, 300)]]
    got = mined(phrases.top_collocations(make_docs(rows), route_bytes=20_000))
    assert got == brute([(lang, text) for _, text, lang, _ in rows], 30, 2000)


def test_scores_pass_64_bits(spark):
    big = 9 * 10**17
    frequent = spark.createDataFrame(
        [("en", 1, "p", 2 * big), ("en", 1, "q", big + 1), ("en", 2, "p q", big), ("en", 0, "", 5 * big)], "lang string, size int, phrase string, f long"
    )
    [row] = phrases.collocations(frequent).collect()
    assert (row.a, row.l, row.r, row.score) == (big, 2 * big, big + 1, 2_000_000 * big // (3 * big + 1))
