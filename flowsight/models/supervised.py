"""Random forest and boosted trees on the rule labels, fitted on all rows in passes of ``trees`` and scored by its kernels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import as_column
from ..operators.features import MODEL_FEATURES, model_inputs
from .settings import PRESETS, Settings
from .trees import Trees, binned, chances_against_rest, chances_of, grow_boosted, grow_forest, label_shares_of

VECTOR = "features"
WEIGHT = "_weight"  # rows of the table that a row of a stratified sample stands for
HASH_SPAN = float(2**63)


@dataclass(frozen=True)
class Forest:
    labels: tuple[str, ...]
    model: Trees | None  # None when there is one class only


@dataclass(frozen=True)
class Boosted:
    labels: tuple[str, ...]
    models: tuple[Trees, ...]  # one against the rest, per label


def assemble(df: DataFrame) -> DataFrame:
    """The 13 model features, coerced, with their vector."""
    return VectorAssembler(inputCols=list(MODEL_FEATURES), outputCol=VECTOR).transform(model_inputs(df))


def class_counts(df: DataFrame, label: str, most: int = 100) -> dict[str, int]:
    """Label -> rows, in label order. Labels are a short fixed vocabulary; more than ``most`` are an error.

    In a stratified sample the rows that it stands for are counted.
    """
    rows = F.sum(WEIGHT) if WEIGHT in df.columns else F.count(F.lit(1))
    rows = df.groupBy(F.coalesce(F.col(label), F.lit("normal")).alias("k")).agg(rows.alias("count")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"column {label!r} has more than {most} classes")
    return {r["k"]: r["count"] for r in sorted(rows, key=lambda r: r["k"])}


def label_shares(counts: dict[str, int], most_rows: int) -> dict[str, float]:
    """Share of each label's rows to draw for about ``most_rows`` in all.

    Labels get equal parts; what small ones leave over goes to the larger ones, so a label with fewer rows than its part
    is taken whole, however rare it is.
    """
    shares, left = {}, float(most_rows)
    for place, label in enumerate(sorted(counts, key=lambda k: (counts[k], k))):
        taken = min(float(counts[label]), left / (len(counts) - place))
        shares[label], left = taken / counts[label], left - taken
    return shares


def stratified(vectors: DataFrame, label: str, key: Sequence[str], most_rows: int, settings: Settings) -> DataFrame:
    """A sample of about ``most_rows`` rows, chosen by the hash of their key within each label, with weights 1 / share."""
    shares = label_shares(class_counts(vectors, label, settings.most_classes), most_rows)
    if not shares:
        return vectors.withColumn(WEIGHT, F.lit(1.0))
    place = label_index(F.coalesce(F.col(label), F.lit("normal")), tuple(shares)).cast("int")
    share = F.get(F.array(*[F.lit(x) for x in shares.values()]), place)
    draw = F.abs(F.xxhash64(F.lit(settings.seed + 1), *[F.col(c) for c in key]).cast("double")) / HASH_SPAN
    return vectors.where((share >= 1.0) | (draw < share)).withColumn(WEIGHT, 1.0 / share)


def label_index(label: Column | str, labels: Sequence[str]) -> Column:
    """Position of a label in the sorted list, as a CASE expression."""
    return (F.array_position(F.array(*[F.lit(k) for k in labels]), as_column(label)) - 1).cast("double")


def fit_forest(vectors: DataFrame, label: str, settings: Settings = PRESETS["detection"]) -> Forest:
    """Forest with balanced class weights n / (classes * rows of the class), times the weights of a stratified sample."""
    counts = class_counts(vectors, label, settings.most_classes)
    labels, total = tuple(counts), sum(counts.values())
    if len(labels) < 2:
        return Forest(labels, None)
    weights = [total / (len(labels) * n) for n in counts.values()]
    rows, limits = _binned(vectors, label, labels)
    model = grow_forest(rows, limits, weights, settings.forest_trees, settings.forest_depth, settings.seed)
    rows.drop()
    return Forest(labels, model)


def fit_boosted(vectors: DataFrame, label: str, settings: Settings = PRESETS["detection"]) -> Boosted:
    """Boosted trees, one binary model per class, with the weights of a stratified sample."""
    labels = tuple(class_counts(vectors, label, settings.most_classes))
    if len(labels) < 2:
        return Boosted(labels, ())
    rows, limits = _binned(vectors, label, labels)
    models: list[Trees] = []
    # A round is a chain of short passes, and the trees of several labels grow in the same ones.
    side_by_side = max(1, settings.parallel_fits)
    for at in range(0, len(labels), side_by_side):
        models += grow_boosted(
            rows, limits, range(len(labels))[at : at + side_by_side], settings.boost_rounds, settings.boost_depth,
            settings.boost_step, settings.boost_rows, settings.boost_columns, settings.seed,
        )
    rows.drop()
    return Boosted(labels, tuple(models))


def _binned(vectors: DataFrame, label: str, labels: Sequence[str]):
    index = label_index(F.coalesce(F.col(label), F.lit("normal")), labels)
    return binned(vectors, VECTOR, index, F.col(WEIGHT) if WEIGHT in vectors.columns else None)


def with_forest(vectors: DataFrame, forest: Forest) -> DataFrame:
    """Adds ``forest_type`` and ``forest_score``, the largest class probability."""
    if forest.model is None:
        return vectors.withColumns({"forest_type": F.lit(forest.labels[0]), "forest_score": F.lit(1.0)})
    chances = chances_of(VECTOR, [forest.model], label_shares_of)
    return _best(vectors.withColumn("_forest", chances), "_forest", forest.labels, "forest")


def with_boosted(vectors: DataFrame, boosted: Boosted) -> DataFrame:
    """Adds ``boosted_type`` and ``boosted_score`` from the normalised one-against-rest probabilities."""
    if not boosted.models:
        return vectors.withColumns({"boosted_type": F.lit(boosted.labels[0]), "boosted_score": F.lit(1.0)})
    chances = chances_of(VECTOR, boosted.models, chances_against_rest)
    total = F.aggregate("_boosted", F.lit(0.0), lambda a, x: a + x)
    shares = vectors.withColumn("_boosted", chances)
    return _best(shares.withColumn("_boosted", F.transform("_boosted", lambda x: x / total)), "_boosted", boosted.labels, "boosted")


def _best(df: DataFrame, chances: str, labels: Sequence[str], prefix: str) -> DataFrame:
    top = F.array_max(chances)
    names = F.array(*[F.lit(k) for k in labels])
    return df.withColumns(
        {f"{prefix}_type": F.get(names, F.array_position(chances, top).cast("int") - 1), f"{prefix}_score": top}
    ).drop(chances)


def score_threats(vectors: DataFrame, forest: Forest, boosted: Boosted) -> DataFrame:
    """``threat_score``: mean of the two largest probabilities; ``threat_type``: the boosted label.

    Taking the forest's label where both agree and the boosted one elsewhere is the boosted label.
    """
    scored = with_boosted(with_forest(vectors, forest), boosted)
    return scored.withColumns(
        {
            "threat_score": (F.col("forest_score") + F.col("boosted_score")) / 2.0,
            "threat_type": F.col("boosted_type"),
        }
    )


def feature_importance(forest: Forest) -> list[tuple[str, float]]:
    if forest.model is None:
        return [(c, 0.0) for c in MODEL_FEATURES]
    ranked = zip(MODEL_FEATURES, forest.model.importance.tolist())
    return sorted(ranked, key=lambda item: (-item[1], item[0]))
