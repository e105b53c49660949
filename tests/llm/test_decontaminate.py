from __future__ import annotations

import numpy as np

from flowsight.llm import decontaminate as d

ITEMS = "item_id long, text string, extra string"


def rows_of(docs, items, **options):
    found = d.leak_report(d.find_leaks(docs, items, **options)).collect()
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)


def random_corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "abcdé"[rng.integers(5)] + "XY"[rng.integers(2)]
    items = [(k, " ".join(word() for _ in range(rng.integers(1, 16)))) for k in range(12)]
    docs = [(k, " ".join(word() for _ in range(rng.integers(0, 40)))) for k in range(40)]
    for k in range(0, 40, 5):  # whole items and windows inside other text
        text = items[k % 12][1].upper().replace(" ", ",\n")
        docs[k] = (k, f"{docs[k][1]} {text} {docs[k][1]}")
    return [*docs, (40, None), (41, ""), (42, docs[0][1]), (42, docs[0][1])], [*items, (12, None), (13, " .. "), (14, items[0][1])]


def test_matches_brute_force(spark, make_docs):
    for seed in range(3):
        docs, items = random_corpus(seed)
        got = rows_of(make_docs(docs), spark.createDataFrame([(*i, "e") for i in items], ITEMS), shard_words=100)
        assert got == sorted(d.brute_force(docs, items))


def test_blocks_and_shards_change_nothing(spark, make_docs):
    docs, items = random_corpus(7)
    table = spark.createDataFrame([(*i, "e") for i in items], ITEMS)
    assert rows_of(make_docs(docs), table, block_words=20, shard_words=30) == sorted(d.brute_force(docs, items))


def test_longest_match(spark, make_docs):
    item = " ".join(f"w{k}" for k in range(30))
    docs = [(1, "a b " + " ".join(f"w{k}" for k in range(5, 25)) + " c"), (2, "nothing")]
    found = {r.doc_id: r for r in d.find_leaks(make_docs(docs), spark.createDataFrame([(9, item, "")], ITEMS)).collect()}
    assert (found[1].longest, found[1].match_item, found[1].match_at, found[1].hits) == (20, "9", 2, [2, 22])
    assert (found[2].longest, found[2].match_item) == (0, None)


def test_empty_tables(spark, make_docs):
    docs = make_docs([(1, "a b c")])
    assert rows_of(docs, spark.createDataFrame([], ITEMS))[0][2:4] == (0, 0)
    assert rows_of(docs.limit(0), spark.createDataFrame([(1, "a", "")], ITEMS)) == []


def test_clean_documents_keeps_columns(spark, make_docs):
    docs = make_docs([(1, "a b c"), (2, "x y"), (None, "q"), (3, None)])
    kept = d.clean_documents(docs, spark.createDataFrame([(1, "b c", "")], ITEMS))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {2, 3, None}


def test_suffix_array_is_sorted():
    ids = np.random.default_rng(1).integers(0, 4, 500).astype(np.int32)
    order = d.suffix_array(ids, 2, 6)
    padded = [*ids.tolist(), 0, 0, 0, 0, 0, 0]
    keys = [padded[k : k + 6] for k in order]
    assert keys == sorted(keys) and all(min(k[:2]) > 0 for k in keys)
    assert len(order) == sum(min(padded[k : k + 2]) > 0 for k in range(500))
