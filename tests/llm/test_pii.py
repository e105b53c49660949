from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from flowsight.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def passes(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


TRICKY = [
    None, "", "x@a.b_c@d.e a@b@c.d @x.y a@b..c a@b.c. é.ü@x.de ab@@c.d a@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1..2.3.4 😀1.1.1.1",
    "4111 1111-1111 1111 x 4111111111111111 4111111111111112 41111111111111114111111111111111 4111  111111111111",
    "+1 (729) 555-7725 +12 +4930123456789012 ++49 30 1234567 +1((((((2 +49\t3012345678 +1-800-555-01999", "+1 " + "(" * 500 + "5" * 20,
    "1-" * 300, "a" * 3000 + "@", "a.b@" + "c." * 400 + "d", "token = \"586908a73d53ffc77567764111111111111111ed\"",
]


def mixed(rng):
    parts = ["foo.1@mail2.example.com", "10.20.30.40", "300.1.1.1", "4111111111111111", "4111111111111112", "+1 (052) 555-0934", "word", "3.5", "+1 23", "é", "12-34"]
    return " ".join(rng.choice(parts, int(rng.integers(1, 30))))


def test_base_spans_match_brute_force(make_docs):
    rng = np.random.default_rng(1)
    docs = list(enumerate([*TRICKY, *(mixed(rng) for _ in range(150)), TRICKY[3]]))
    found = {r.doc_id: r for r in pii.span_report(pii.find_spans(make_docs(docs))).collect()}
    for k, text in docs:
        want = brute(text)
        assert found[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [found[k].n_email, found[k].n_ip, found[k].n_card, found[k].n_phone] == [sum(s.startswith(x) for s in want) for x in PATTERNS]
        assert set(want) <= set(found[k].spans.split(","))


def test_many_matches_in_a_long_text(spark):
    text = " é ".join(f"u{k}@h{k}.com" for k in range(1500))
    row = spark.createDataFrame([(text,)], "text string").select(pii.matches(F.col("text"), pii.BASE["email"], "@").alias("m")).first()
    assert [(m.start, m.stop) for m in row.m] == [m.span() for m in re.finditer(PATTERNS["email"], text)]


def test_merged_cards_are_added_and_clean_text_is_left(make_docs):
    rng = np.random.default_rng(3)
    docs = [*enumerate(mixed(rng) for _ in range(400)), (900, "pay 4111111111111111 4111111111111111 now"), (901, "no data here, 2024 and 3.14")]
    spans = {r.doc_id: r.spans for r in pii.span_report(pii.find_spans(make_docs(docs))).collect()}
    assert spans[900] == "card:4:20,card:21:37"
    assert spans[901] == ""


def test_redact(make_docs):
    docs = make_docs([(1, "é me@x.org and 10.0.0.1!"), (2, None), (3, ""), (4, "clean"), (4, "clean")])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str) == [
        (1, "é [EMAIL] and [IP]!", 19), (2, None, None), (3, "", 0), (4, "clean", 5), (4, "clean", 5),
    ]
    assert pii.redact(docs.limit(0)).collect() == []


def test_trees_as_sql_agree_with_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(0)
    rows = [([float(a), float(b)], float(a > b)) for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "f array<double>, label double").withColumn("features", array_to_vector("f"))
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df)
    both = model.transform(df).select(F.expr(pii.score_sql(model)).alias("a"), vector_to_array("probability")[1].alias("b")).collect()
    assert max(abs(r.a - r.b) for r in both) < 1e-9


def learnt(rng, n=600):
    words = ["leta", "moru", "sina", "doko", "veli", "para"]
    made = {
        "email": lambda: f"u{rng.integers(99)}.x@mail{rng.integers(9)}.org", "ip": lambda: ".".join(map(str, rng.integers(0, 256, 4))),
        "card": lambda: card(rng), "phone": lambda: f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}",
    }
    return [(k, " ".join([*rng.choice(words, 4), made[kind](), *rng.choice(words, 3)])) for k, kind in enumerate(list(made) * (n // 4))]


def card(rng):
    body = "4" + "".join(map(str, rng.integers(0, 10, 14)))
    return next(body + str(k) for k in range(10) if luhn(body + str(k)))


def test_held_out_precision_and_recall_of_each_kind(make_docs):
    scorer = pii.fit(make_docs(learnt(np.random.default_rng(5))))
    assert set(scorer.held_out) == set(pii.KINDS)
    assert all(precision >= pii.PRECISION and recall >= 0.9 for precision, recall in scorer.held_out.values()), scorer.held_out
    used = {pii.FEATURES[int(k)] for k in re.findall(r"get\(f, (\d+)\)", scorer.sql)}
    assert {"announced", "other_announced"} <= used and used & {"letter_before", "letter_after", "digit_after"}


def test_context_decides(make_docs):
    rng = np.random.default_rng(6)
    number = card(rng)
    dotted = ".".join(number[k : k + 4] for k in (0, 4, 8, 12))
    wanted = {
        "call 729-555-7725 leta": ["phone:5:17"], "moru (729) 555-7725 leta": ["phone:5:19"], "order id 729-555-7725 leta": [],
        f"paid with {dotted} moru": ["card:10:29"], f"serial no. {dotted} moru": [], f"sina a3f{dotted}c9e moru": [],
        "write to jo.doe [at] mail.org sina": ["email:9:29"], "commit jo.doe@mail sina": [], "moru jo.doe@mail sina": ["email:5:16"],
        "host 10. 20. 30. 40 veli": ["ip:5:19"], "version 10. 20. 30. 40 veli": [], "host 10. 20. 300. 40 veli": [],
        f"paid with {dotted[:-1]}{(int(dotted[-1]) + 1) % 10} moru": [], "leta 004930123456789 moru": ["phone:5:20"],
    }
    docs = learnt(rng) + [(10_000 + k, text) for k, text in enumerate(wanted)]
    found = {r.doc_id: r.spans for r in pii.span_report(pii.find_spans(make_docs(docs))).collect()}
    got = {text: [s for s in found[10_000 + k].split(",") if s] for k, text in enumerate(wanted)}
    assert got == wanted


def test_redact_keeps_columns_with_the_names_used_here(spark):
    names = ("_base_spans", "_spans", "_proposed", "_more", "_base", "row", "m", "f", "h", "label", "features", "a.b")
    docs = spark.createDataFrame([(1, "call +1 (729) 555-7725", "x"), (None, None, "y"), (1, "none", "z")], "doc_id long, text string, tag string")
    docs = docs.selectExpr("*", *(f"concat(tag, '{c}') AS `{c}`" for c in names))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    rows = {r.tag: r for r in out.collect()}
    assert [rows[t].text for t in "xyz"] == ["call [PHONE]", None, "none"]
    assert all(rows[t][c] == t + c for t in "xyz" for c in names)


def test_nothing_to_learn_from(make_docs):
    docs = make_docs([(1, "call 729-555-7725"), (2, None)])
    assert pii.fit(docs) is None
    assert {r.spans for r in pii.span_report(pii.find_spans(docs)).collect()} == {""}


def test_all_base_spans_teach(make_docs, monkeypatch):
    judged, plain = [], pii.calibrate
    monkeypatch.setattr(pii, "calibrate", lambda bins, precision: judged.extend(bins) or plain(bins, precision))
    docs = make_docs([(k, f"veli write to u{k}.x@mail.org leta") for k in range(6000)])
    assert pii.fit(docs) is not None
    held_out = docs.where("pmod(xxhash64(doc_id), 5) = 0").count()
    variants = len(pii.spoilt("email", F.lit("a@b.c"))) * 4
    assert sum(r.n for r in judged) == held_out * variants
