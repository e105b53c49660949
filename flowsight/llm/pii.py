"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds choose what is added.

Base spans are the leftmost non-overlapping matches of one pattern a kind that pass the kind's check (octets, Luhn,
digit counts). They always stay. Further generators propose overlapping spans with looser formats: parts of long digit
runs, numbers without a plus sign, addresses without a top-level domain, octets and digit groups parted in other ways. A
proposal that cannot be its kind (``plausible``) is out; of the others gradient-boosted trees judge format and context.

The tables hold no labelled spans, so the trees learn from base matches that were spoilt on purpose. Label 1: base spans as
they are, and rewritten in the loose formats (``spoilt``), in their own surroundings or behind a word such as ``POSITIVE`` that
announces them. Label 0: the same spans with letters of a hash joined to them, or behind a word of ``NEGATIVE`` that announces
a number of another sort. Label and format are thus independent of each other and of every check; what decides is the
context, and formats that a context rarely goes with. Per kind the smallest threshold that has the wanted precision
on held-out documents is taken; their recall at it is kept beside it. A kind without held-out examples takes the threshold of all
kinds together. A proposal above it that overlaps no base span and no better-placed proposal is added.

Everything is column expressions: positions come from the lengths of the pieces between matches, and the fitted trees
are written out as conditional expressions over a candidate's features, so scoring needs neither a join nor a shuffle.
The patterns are possessive where that changes no match: Java then neither recurses nor rescans on very long texts.

Null texts are empty: no spans, and they stay null when redacted. Repeated rows, and rows that share an id or have none, are
judged each by itself. Tables without base matches teach nothing: nothing is added to them, and an empty table gives an empty one.
``redact`` keeps all columns whatever their names; ``find_spans`` replaces columns named ``_base_spans`` and ``_spans``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import quoted
from ..sources.scratch import staged

KINDS = ("email", "ip", "card", "phone")
# What the patterns must match is fixed:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+ with 16 digits or more            phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PROPOSED = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:\. [0-9]{1,3}+){3}(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])"),
    ("card", r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+.-])00[1-9][0-9]{7,12}+(?![0-9])"),
)
# A text without a match of this has none of the kind's patterns; it is cheap to look for.
NEEDED = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9]\. ?[0-9]", "card": r"[0-9][ .-]?[0-9]{3}", "phone": r"\+[0-9]|[0-9)][ .-][0-9]{3}[ .-]|00[1-9][0-9]{7}"}
# Words that announce a span of a kind, and words that announce a number or name that is none; parts of hashes.
POSITIVE = {"email": ("mail: ", "write to ", "contact "), "ip": ("ip: ", "host ", "address "), "card": ("card: ", "paid with ", "visa "), "phone": ("tel: ", "call ", "phone ")}
NEGATIVE = ("serial no. ", "order id ", "invoice #", "version ", "sku: ", "build ", "commit ", "clone ", "part no: ", "isbn ")
HASHES = ("a3f", "c9d4e", "7b0fe", "e41ad")
CONTEXT = 16
FIT_TASK_ROWS = 50_000  # distinct examples that one task of a fit takes
TREES, DEPTH = 20, 4
PRECISION = 0.98
_BLOCK = 256
_NO_SPANS = "CAST(array() AS array<struct<kind: string, start: bigint, stop: bigint>>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)


def _starts(lengths: Column) -> Column:
    """Sums of the values before each one, by blocks, so that long arrays are not copied for every value."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
        lambda b: _total(F.slice(lengths, b * _BLOCK + 1, _BLOCK)),
    )
    before = let(
        blocks,
        lambda sums: F.aggregate(
            sums, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))
        ),
    )
    return let(
        before,
        lambda sums: F.transform(
            lengths,
            lambda _, i: F.get(sums, F.floor(i / _BLOCK).cast("int"))
            + F.when(i % _BLOCK == 0, F.lit(0).cast("long")).otherwise(
                _total(F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))
            ),
        ),
    )


def matches(text: Column, pattern: str, needed: str) -> Column:
    """array of (start, stop, span, before, after) of the pattern's matches, in code points."""

    def located(m: Column) -> Column:
        spans, gaps = m["spans"], m["gaps"]
        lengths = F.zip_with(spans, F.slice(gaps, 1, F.size(spans)), lambda s, g: (F.length(s) + F.length(g)).cast("long"))
        return let(
            F.struct(_starts(lengths).alias("at"), spans.alias("spans"), gaps.alias("gaps")),
            lambda x: F.transform(
                x["spans"],
                lambda s, i: let(
                    F.get(x["at"], i) + F.length(F.get(x["gaps"], i)),
                    lambda start: F.struct(
                        start.alias("start"), (start + F.length(s)).alias("stop"), s.alias("span"),
                        F.right(F.get(x["gaps"], i), F.lit(CONTEXT)).alias("before"),
                        F.left(F.get(x["gaps"], i + 1), F.lit(CONTEXT)).alias("after"),
                    ),
                ),
            ),
        )

    none = F.expr("CAST(array() AS array<struct<start: bigint, stop: bigint, span: string, before: string, after: string>>)")
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("spans"), F.split(text, pattern, -1).alias("gaps"))
    some = let(found, lambda m: F.when(F.size(m["spans"]) > 0, located(m)).otherwise(none))
    return F.when(text.rlike(needed), some).otherwise(none)


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def place(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise((digit * 2 / 10).cast("int") + digit * 2 % 10)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + place(i)) % 10 == 0


def _octets(span: Column) -> Column:
    plain = F.transform(F.split(span, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(plain, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def passes(kind: str, span: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(span)
    if kind == "phone":
        return F.length(_digits(span)).between(8, 15)
    return let(_digits(span), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))


def plausible(kind: str, span: Column) -> Column:
    """Whether a loosely written span can be its kind at all: octets up to 255, 13 to 19 digits with a right check digit."""
    if kind == "ip":
        return _octets(F.regexp_replace(span, " ", ""))
    if kind == "card":
        return let(_digits(span), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    return F.lit(True)


FEATURES = (
    "email", "ip", "card", "phone", "length", "digits", "letters", "blanks", "dots", "dashes", "brackets", "plus",
    "digit_before", "letter_before", "quote_before", "equals_before", "digit_after", "letter_after", "quote_after",
    "announced", "other_announced",
)
_ANNOUNCED = r"(?i)(?:mail|write|contact|ip|host|addr|address|server|card|paid|visa|pay|tel|call|phone|fax)[a-z]*[ :.]*(?:to |with )?$"
_OTHER = r"(?i)(?:serial|order|invoice|version|sku|build|commit|clone|part|isbn|hash|token|revision|release)[a-z]*[ :.#=]*(?:no|id|nr)?[ :.#=]*$"


def _features(kind: Column, m: Column) -> Column:
    span, before, after = m["span"], m["before"], m["after"]
    count = lambda c: F.length(F.regexp_replace(span, f"[^{c}]", "")).cast("double")
    flag = lambda c: c.cast("double")
    return F.array(
        *(flag(kind == k) for k in KINDS),
        F.length(span).cast("double"), count("0-9"), count("A-Za-z"), count(" "), count("."), count(r"\-"), count("()"), count("+"),
        flag(before.rlike("[0-9]$")), flag(before.rlike("[A-Za-z]$")), flag(before.rlike("[\"']$")), flag(before.rlike("[=#]$")),
        flag(after.rlike("^[0-9]")), flag(after.rlike("^[A-Za-z]")), flag(after.rlike("^[\"']")),
        flag(before.rlike(_ANNOUNCED)), flag(before.rlike(_OTHER)),
    )


def spoilt(kind: str, span: Column) -> list[Column]:
    """A base span as it is, and rewritten in the formats of the looser generators."""
    if kind == "email":
        return [span, F.regexp_extract(span, r"^[^@]+@[^.]+", 0), F.regexp_replace(span, "@", " [at] "), F.regexp_replace(span, "@", "(at)")]
    if kind == "ip":
        return [span, F.regexp_replace(span, r"\.", ". ")]
    digits = _digits(span)
    if kind == "card":
        return [span, digits, *(F.regexp_replace(digits, r"(\d{4})(?=\d)", f"$1{mark}") for mark in " -.")]
    a, b, c = (F.substring(F.right(digits, F.lit(10)), at, n) for at, n in ((1, 3), (4, 3), (7, 4)))
    return [span, F.concat_ws("-", a, b, c), F.concat_ws(" ", a, b, c), F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c), F.concat(F.lit("00"), digits)]


def _one_of(words: tuple[str, ...], seed: int) -> Column:
    """One of the words, by the hash of the span."""
    return F.get(F.array(*(F.lit(w) for w in words)), F.pmod(F.xxhash64("doc_id", "span", F.lit(seed)), F.lit(len(words))).cast("int"))


def examples(found: DataFrame, kind: str) -> DataFrame:
    """doc_id, kind, span, before, after, label of what is made from base spans of one kind, rows (doc_id, span, before, after)."""
    out = []
    for k, span in enumerate(spoilt(kind, F.col("span"))):
        surroundings = (
            (1.0, F.col("before"), F.col("after")),
            (1.0, _one_of(POSITIVE[kind], k), F.col("after")),
            (0.0, _one_of(NEGATIVE, k + 50), F.col("after")),
            (0.0, F.concat("before", _one_of(HASHES, k + 90)), F.concat(_one_of(HASHES, k + 130), "after")),
        )
        out += [F.struct(span.alias("span"), b.alias("before"), a.alias("after"), F.lit(label).alias("label")) for label, b, a in surroundings]
    return found.select("doc_id", F.explode(F.array(*out)).alias("e")).select("doc_id", F.lit(kind).alias("kind"), "e.*")


def base_matches(text: Column, kind: str) -> Column:
    """The matches of the kind's pattern that pass its check."""
    return F.filter(matches(text, BASE[kind], NEEDED[kind]), lambda m: passes(kind, m["span"]))


def _placed(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))


def _named(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m")))


def _proposals(text: Column, kind: str, pattern: str) -> Column:
    return F.transform(
        F.filter(matches(text, pattern, NEEDED[kind]), lambda m: plausible(kind, m["span"])),
        lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), _features(F.lit(kind), m).alias("f")),
    )


def _of_kind(spans: Column | str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def candidates(docs: DataFrame) -> DataFrame:
    """The documents with ``_base_spans`` (by kind, then start) and ``_proposed`` (spans of the other generators)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    proposed = [_proposals(text, kind, pattern) for kind, pattern in PROPOSED]
    base = F.concat(*(_placed(k, base_matches(text, k)) for k in KINDS))
    return docs.withColumn("_base_spans", base).withColumn("_proposed", F.concat(*proposed))


def _node(node) -> str:
    """A tree as SQL over the array ``f``."""
    if node.getClass().getSimpleName() == "LeafNode":
        return repr(float(node.prediction()))
    split = node.split()
    return f"IF(get(f, {split.featureIndex()}) <= {float(split.threshold())!r}D, {_node(node.leftChild())}, {_node(node.rightChild())})"


def score_sql(model: GBTClassificationModel) -> str:
    """Probability of label 1 as SQL over the array ``f``."""
    trees = " + ".join(f"{float(w)!r}D * {_node(t._call_java('rootNode'))}" for w, t in zip(model.treeWeights, model.trees, strict=True))
    return f"1D / (1D + exp(-2D * ({trees})))"


@dataclass(frozen=True)
class Scorer:
    """Fitted trees: their score as SQL, and for each kind a threshold with its precision and recall on held-out documents."""

    sql: str
    thresholds: dict[str, float]
    held_out: dict[str, tuple[float, float]]


def calibrate(bins: list, precision: float) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Thresholds, precisions and recalls from rows (kind, label, bin, n) of held-out examples; a bin is a hundredth of a score."""
    thresholds, reached = {}, {}
    for kind in KINDS:
        own = [r for r in bins if r.kind == kind] or bins
        positives = sum(r.n for r in own if r.label == 1.0)
        for cut in range(50, 100):
            good, bad = (sum(r.n for r in own if r.label == label and r.bin >= cut) for label in (1.0, 0.0))
            if good and good >= precision * (good + bad):
                thresholds[kind], reached[kind] = cut / 100, (good / (good + bad), good / positives)
                break
    return thresholds, reached


def fit(docs: DataFrame, precision: float = PRECISION) -> Scorer | None:
    """Trees and thresholds from all base spans of ``docs``, rows (doc_id, text); None where there are none.

    Examples with the same features and label are one weighted row, and the kinds weigh alike, whatever their number.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = F.explode(F.concat(*(_named(k, base_matches(text, k)) for k in KINDS)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), each.alias("x"))
    rows = staged(rows.select("doc_id", "x.kind", "x.m.span", "x.m.before", "x.m.after"), "pii-base")
    per = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    made = reduce(DataFrame.unionByName, [examples(rows.where(F.col("kind") == k), k) for k in sorted(per)])
    made = staged(made, "pii-variants")  # written first: features of all variants are too much code for one expression
    held_out = (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held_out")
    made = made.select(held_out, "kind", "label", _features(F.col("kind"), F.struct("span", "before", "after")).alias("f"))
    made = staged(made.groupBy("held_out", "kind", "label", "f").agg(F.count("*").alias("n")), "pii-examples")
    training = made.where(~F.col("held_out"))
    if training.isEmpty():  # all base spans are of held-out documents
        training = made
    shares = F.coalesce(*(F.when(F.col("kind") == k, sum(per.values()) / (len(per) * n)) for k, n in sorted(per.items())))
    training = training.withColumn("weight", F.col("n") * shares).repartition(math.ceil(made.count() / FIT_TASK_ROWS), "f")
    training = staged(training.sortWithinPartitions("f", "label").select(array_to_vector("f").alias("features"), "label", "weight"), "pii-training")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, weightCol="weight").fit(training)
    sql = score_sql(model)
    judged = made.groupBy("held_out", "kind", "label", F.floor(F.expr(sql) * 100).alias("bin")).agg(F.sum("n").alias("n")).collect()
    return Scorer(sql, *calibrate([r for r in judged if r.held_out] or judged, precision))


def _added(scorer: Scorer | None) -> Column:
    """Proposals above their kind's threshold, without overlaps, earliest start first."""
    if scorer is None or not scorer.thresholds:
        return F.expr(_NO_SPANS)
    limit = " ".join(f"WHEN '{k}' THEN {t!r}D" for k, t in scorer.thresholds.items())
    scored = F.expr(f"filter(_proposed, p -> element_at(transform(array(p.f), f -> {scorer.sql}), 1) >= CASE p.kind {limit} ELSE 2D END)")
    free = F.filter(scored, lambda p: ~F.exists("_base_spans", lambda b: _overlaps(b, p)))
    ordered = F.array_sort(F.transform(free, lambda p: F.struct(p["start"].alias("start"), (-p["stop"]).alias("last"), p["kind"].alias("kind"))))
    return F.aggregate(
        ordered,
        F.expr(_NO_SPANS),
        lambda a, p: F.when(
            (F.size(a) == 0) | (F.try_element_at(a, F.lit(-1))["stop"] <= p["start"]),
            F.concat(a, F.array(F.struct(p["kind"].alias("kind"), p["start"].alias("start"), (-p["last"]).alias("stop")))),
        ).otherwise(a),
    )


def find_spans(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``_base_spans`` and ``_spans``: arrays of (kind, start, stop), by kind as listed, then start."""
    scorer = fit(docs, **options)
    # Several generators leave several groups in one array, each in order; the added ones fall in behind their kind.
    by_kind = lambda spans: F.concat(*(F.array_sort(_of_kind(spans, k)) for k in KINDS))
    out = candidates(docs).withColumn("_more", _added(scorer))
    return out.withColumn("_spans", by_kind(F.concat("_base_spans", "_more"))).drop("_proposed", "_more")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def span_report(found: DataFrame) -> DataFrame:
    counts = [F.size(_of_kind("_base_spans", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(span_text(F.col("_base_spans")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, span_text(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars`` follows where the column exists.

    Spans of different kinds can overlap; they are masked as one, by the kind of the first.
    """
    found = find_spans(docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), "doc_id", "text"), **options)
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("last"), s["kind"].alias("kind"))))
    pieces = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                (-s["last"]).alias("at"),
                F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], -s["last"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length(F.col("text")))),
    )
    masked = found.select("row", F.when(F.size("_spans") > 0, pieces).otherwise(F.col("text")).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return masked.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
