from __future__ import annotations

import numpy as np

from flowsight.llm import language as g

WORDS = {"aa": ["katu", "mola", "tiko", "lami", "suna"], "bb": ["xerz", "bruk", "zond", "werk", "drux"]}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n)).capitalize() + ".\n"


def test_phrases_match_brute_force():
    rng = np.random.default_rng(1)
    samples = tuple((lang, prose(rng, lang, 25)) for lang in WORDS)
    parser = g.Parser(samples)
    texts = ["", "k", prose(rng, "aa", 90), prose(rng, "bb", 3), "qqq katu 12!! émola", "xerz" * 100]
    codes = [g._codes(t, parser.classes) for t in texts]
    found = parser.phrases(codes)
    for k, (_, sample) in enumerate(samples):
        trained = [c if c != 1 else 0 for c in g._codes(sample, parser.classes).tolist()]
        assert [int(x) for x in found[:, k]] == [g.brute_phrases(c.tolist(), trained) for c in codes]


def test_scripts_with_thousands_of_letters_match_brute_force():
    rng = np.random.default_rng(5)
    letters = [chr(p) for p in [*range(0x4E00, 0x4F80), *range(0x20000, 0x20040), *range(0x30000, 0x30040)]]
    write = lambda n, shift: "".join(letters[int(k + shift) % len(letters)] for k in rng.zipf(1.2, n) % 400)
    samples = (("aa", write(500, 0)), ("bb", write(500, 150)), ("cc", prose(rng, "aa", 40)))
    parser = g.Parser(samples)
    assert parser.rare > 100
    texts = [samples[0][1][100:180], write(300, 150), write(50, 0) + " katu " + chr(0x5F00), prose(rng, "aa", 30), "", chr(0x9000) * 3]
    codes = [g._codes(t, parser.classes) for t in texts]
    found = parser.phrases(codes)
    for k, (_, sample) in enumerate(samples):
        trained = g._codes(sample, parser.classes).tolist()
        assert [int(x) for x in found[:, k]] == [g.brute_phrases(c.tolist(), trained) for c in codes]


def test_languages_that_share_a_large_script_are_told_apart(make_docs):
    rng = np.random.default_rng(6)
    common = [chr(0x4E00 + k) for k in range(300)]
    pairs = {lang: rng.permutation(300) for lang in ("ja", "zh")}  # the same letters, each with its own followers
    write = lambda lang, n: "".join(common[k] + common[pairs[lang][k]] for k in rng.integers(0, 300, n))
    train = make_docs([(k, write(lang, 300), lang, "s") for k in range(10) for lang in pairs])
    test = [(k, write(lang, 20), lang, "s") for k, lang in enumerate(["ja", "zh"] * 15)]
    found = {r.doc_id: r.lang_pred for r in g.identify(make_docs(test), train).collect()}
    assert all(found[k] == lang for k, _, lang, _ in test)


def test_held_out_accuracy_and_undetermined(make_docs):
    rng = np.random.default_rng(2)
    docs = [(k, prose(rng, lang, int(rng.integers(4, 60))) * int(rng.integers(1, 4)), lang, "s") for k in range(60) for lang in WORDS]
    odd = [(900, None, "aa", "s"), (901, "12 .. !", "bb", "s"), (902, "", None, "s"), (903, "katu mola", None, "s"), (904, "x" * 5000, None, "s")]
    table = make_docs([*docs, *odd, odd[3]])
    rows = g.identify(table, table.where("doc_id < 30 OR doc_id >= 900")).collect()
    found = {r.doc_id: r for r in rows}
    truth = [(found[k].lang_pred, lang) for k, _, lang, _ in docs[60:]]
    assert len(rows) == len(docs) + 6
    assert all(r.lang_pred in WORDS for r in rows if r.doc_id not in (900, 901, 902)) and len(truth) == 60
    assert [found[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in rows)


def test_each_text_gets_its_language(make_docs):
    rng = np.random.default_rng(3)
    train = make_docs([(k, prose(rng, lang, 40), lang, "s") for k in range(10) for lang in WORDS])
    test = [(k, prose(rng, lang, 6), lang, "s") for k, lang in enumerate(["aa", "bb"] * 20)]
    found = {r.doc_id: r.lang_pred for r in g.identify(make_docs(test), train).collect()}
    assert all(found[k] == lang for k, _, lang, _ in test)


def test_copies_do_not_shrink_the_labelled_sample(make_docs):
    rng = np.random.default_rng(4)
    one = prose(rng, "bb", 12).strip()
    aa = [prose(rng, "aa", 8).strip() for _ in range(300)]
    docs = [*((k, one, "bb", "s") for k in range(4000)), *((k, aa[0], "aa", "s") for k in range(4000)), *((k, line, "aa", "s") for k, line in enumerate(aa))]
    found = dict(g.labelled_samples(make_docs(docs), chars=2000))
    assert found["bb"] == one
    assert 1990 <= len(found["aa"]) <= 2000
    few = dict(g.labelled_samples(make_docs(docs), chars=10**6))
    assert few == {"aa": " ".join(sorted(set(aa))), "bb": one}


def test_without_labels_or_rows(make_docs):
    docs = make_docs([(1, "katu", None, "s")])
    assert g.identify(docs, docs).first().lang_pred == "und"
    assert g.identify(docs.limit(0), docs).collect() == []
