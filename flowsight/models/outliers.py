"""Three outlier detectors over standardised features, and their vote.

* isolation forest: trees grown from small hash-chosen samples, one task per tree;
* one-class SVM: ``kernel_score`` is positive outside its boundary, which leaves a share nu of the rows out;
* reconstruction error of a network with a bottleneck.

Fitting moves only samples and vectors of fixed size to the driver. Python runs vectorised: in the passes over all rows
that fit boundary and network together (``descents``) and in the one that scores.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import outlier_vote
from ..operators.features import MODEL_FEATURES
from ..schema import FLOW_KEY, quoted
from ..sources.scratch import staged
from .descents import features_of, fit_descents, layers_of, reconstruction_errors
from .settings import PRESETS, Settings

# Ship this module's functions with the tasks: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCORES = ("isolation_score", "kernel_score", "autoencoder_error")
NODE_SCHEMA = "tree int, node int, feature int, cut double, low int, high int, depth double"
HASH_SPAN = float(2**63)
OVERSAMPLE = 2.0
BLOCK_ROWS = 2048  # rows that are scored at a time


@dataclass(frozen=True)
class Detectors:
    columns: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    trees: tuple[np.ndarray, ...]  # per node: feature, cut, low, high, depth; trees padded to one size
    tree_norm: float
    directions: np.ndarray
    phases: np.ndarray
    boundary: np.ndarray
    rho: float
    network: np.ndarray
    layers: tuple[int, ...]


def _standardisation(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and population deviation per column and the row count: one aggregate, one row."""
    stats = [f(quoted(c)) for c in columns for f in (F.avg, F.stddev_pop)]
    row = df.agg(F.count(F.lit(1)), *stats).first()
    if not row[0]:
        raise ValueError("no rows to fit the detectors on")
    mean, scale = np.array(row[1::2], dtype=float), np.array(row[2::2], dtype=float)
    scale[scale == 0] = 1.0
    return mean, scale, row[0]


def _expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _tree_samples(df: DataFrame, columns: Sequence[str], key: Sequence[str], rows: int, settings: Settings) -> DataFrame:
    """(tree, features): for each tree the ``isolation_sample`` rows with the smallest hash of (row, tree).

    A first hash keeps just enough rows for all trees and a second one assigns each to the trees it
    may serve, so about OVERSAMPLE * sample * trees pairs exist however large the table is. Hashes of
    the row key, not random numbers: the choice does not depend on how the table is split.
    """
    need = OVERSAMPLE * settings.isolation_sample
    pool_share = min(1.0, 4.0 * need * math.sqrt(settings.isolation_trees) / rows)
    tree_share = min(1.0, need / (rows * pool_share))
    fields = [quoted(c) for c in key]

    def draw(*parts: Column) -> Column:
        return F.abs(F.xxhash64(*parts).cast("double")) / HASH_SPAN

    pool = df.where(draw(F.lit(settings.seed), *fields) < pool_share).select(
        F.xxhash64(F.lit(-settings.seed), *fields).alias("row"), F.array(*[quoted(c) for c in columns]).alias("x")
    )
    numbers = F.sequence(F.lit(0), F.lit(settings.isolation_trees - 1))
    mine = F.filter(numbers, lambda t: draw(F.col("row"), t) < tree_share)
    pairs = pool.select("row", "x", F.explode(mine).alias("tree"))
    place = W.partitionBy("tree").orderBy(F.xxhash64("row", "tree"), "row")
    ranked = pairs.withColumn("_rank", F.row_number().over(place))
    return ranked.where(F.col("_rank") <= settings.isolation_sample).select("tree", "x")


def _grow(seed: int, limit: int):
    """Function that grows one isolation tree from its sample."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        data = np.stack(pdf["x"].to_numpy())
        data = data[np.lexsort(data.T)]  # arrival order must not matter
        nodes: list[list[float]] = []
        todo = [(data, 0, -1, False)]
        while todo:
            part, depth, parent, is_high = todo.pop()
            number = len(nodes)
            if parent >= 0:
                nodes[parent][3 if is_high else 2] = number
            low, high = part.min(axis=0), part.max(axis=0)
            varied = np.flatnonzero(high > low)
            if depth >= limit or varied.size == 0:
                nodes.append([-1, 0.0, number, number, depth + _expected_depth(len(part))])
                continue
            feature = int(rng.choice(varied))
            cut = float(rng.uniform(low[feature], high[feature]))
            nodes.append([feature, cut, -1, -1, 0.0])
            below = part[:, feature] <= cut
            todo.append((part[~below], depth + 1, number, True))
            todo.append((part[below], depth + 1, number, False))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "low", "high", "depth"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        return out

    return grow


def _fit_trees(df: DataFrame, columns: Sequence[str], key: Sequence[str], rows: int, settings: Settings) -> tuple[np.ndarray, ...]:
    samples = _tree_samples(df, columns, key, rows, settings)
    limit = max(1, math.ceil(math.log2(max(2, settings.isolation_sample))))
    grown = samples.groupBy("tree").applyInPandas(_grow(settings.seed, limit), NODE_SCHEMA)
    nodes = grown.toPandas()  # at most trees * (2 * sample - 1) small rows
    count, width = nodes["tree"].nunique(), int(nodes["node"].max()) + 1
    row = nodes["tree"].rank(method="dense").astype(int).to_numpy() - 1
    at = nodes["node"].to_numpy()
    packed = []
    for name, kind in (("feature", np.int32), ("cut", float), ("low", np.int32), ("high", np.int32), ("depth", float)):
        field = np.zeros((count, width), dtype=kind)
        field[row, at] = nodes[name].to_numpy()
        packed.append(field)
    return tuple(packed)


def fit_detectors(
    df: DataFrame,
    columns: Sequence[str] = MODEL_FEATURES,
    key: Sequence[str] = FLOW_KEY,
    settings: Settings = PRESETS["detection"],
) -> Detectors:
    """Fit on every row of ``df``; ``key`` names columns that tell rows apart."""
    columns = tuple(columns)
    mean, scale, rows = _standardisation(df, columns)
    rng = np.random.default_rng(settings.seed)
    directions = rng.normal(0.0, math.sqrt(2.0 / len(columns)), (len(columns), settings.kernel_features))
    phases = rng.uniform(0.0, 2.0 * math.pi, settings.kernel_features)
    sample = min(settings.isolation_sample, rows)
    bound = inheritable_thread_target(df.sparkSession)
    with ThreadPoolExecutor(2) as pool:  # neither waits for the other
        trees = pool.submit(bound(_fit_trees), df, columns, key, rows, settings)
        descents = pool.submit(bound(fit_descents), df, columns, mean, scale, directions, phases, rows, settings)
        boundary, rho, network = descents.result()
        return Detectors(
            columns=columns,
            mean=mean,
            scale=scale,
            trees=trees.result(),
            tree_norm=max(_expected_depth(sample), 1e-9),
            directions=directions,
            phases=phases,
            boundary=boundary,
            rho=rho,
            network=network,
            layers=(len(columns), *settings.network_layers, len(columns)),
        )


def _complete(trees: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and cut of every inner node, a row a tree, and the depths that its lowest nodes stand for.

    Leaves above the lowest level are continued down to it, which adds no more nodes than a tree's limit allows. The children
    of node i are then 2 i + 1 and 2 i + 2, so a step down needs no list of children and no test whether a row has arrived.
    """
    feature, cut, low, high, depth = trees
    tree, node = np.arange(len(feature))[:, None], np.zeros((len(feature), 1), dtype=int)
    features, cuts = [np.zeros((len(feature), 0), dtype=int)], [np.zeros((len(feature), 0))]
    while (feature[tree, node] >= 0).any():
        leaf = feature[tree, node] < 0
        features.append(np.where(leaf, 0, feature[tree, node]))
        cuts.append(np.where(leaf, np.inf, cut[tree, node]))
        node = np.stack([low[tree, node], high[tree, node]], axis=2).reshape(len(feature), -1)
    return np.concatenate(features, axis=1), np.concatenate(cuts, axis=1), depth[tree, node]


def _depths(raw: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Sum over the trees of the depth that each row reaches."""
    values, lines, reached = raw.ravel(), np.arange(len(raw)) * raw.shape[1], np.zeros(len(raw))
    inner = feature.shape[1]
    for t in range(len(feature)):
        node = np.zeros(len(raw), dtype=int)
        for _ in range(inner.bit_length()):
            high = ~(values.take(lines + feature[t].take(node)) <= cut[t].take(node))
            node += node
            node += 1
            node += high
        reached += depth[t].take(node - inner)
    return reached


def _scorer(d: Detectors):
    layers = layers_of(d.network, d.layers)
    trees = _complete(d.trees)

    def block(raw: np.ndarray) -> np.ndarray:
        x = (raw - d.mean) / d.scale
        isolation = np.exp2(-_depths(raw, *trees) / len(trees[0]) / d.tree_norm)
        kernel = d.rho - features_of(x, d.directions, d.phases) @ d.boundary
        return np.column_stack((isolation, kernel, reconstruction_errors(x, layers)))

    def score(raw: np.ndarray) -> pd.DataFrame:
        raw = np.ascontiguousarray(raw)
        parts = [block(raw[at : at + BLOCK_ROWS]) for at in range(0, len(raw), BLOCK_ROWS)]
        return pd.DataFrame(np.concatenate([np.zeros((0, len(SCORES))), *parts]), columns=list(SCORES))

    return score


def score_outliers(df: DataFrame, detectors: Detectors) -> DataFrame:
    """Adds the three scores, larger meaning odder."""
    score = _scorer(detectors)
    schema = ", ".join(f"{name} double" for name in SCORES)

    @F.pandas_udf(schema)
    def scores(*columns: pd.Series) -> pd.DataFrame:
        return score(np.column_stack([c.to_numpy(dtype=float) for c in columns]))

    scored = df.withColumn("_scores", scores(*[quoted(c) for c in detectors.columns]))
    return scored.select(*[quoted(c) for c in df.columns], "_scores.*")


def flag_outliers(scored: DataFrame, settings: Settings = PRESETS["detection"]) -> DataFrame:
    """Cut two scores at their upper ``contamination`` quantile, the SVM's at its own boundary; the settings' detectors vote.

    The quantiles are approximate: their rank is right to one ten-thousandth of the rows.
    """
    ranked = [c for c in SCORES if c != "kernel_score"]
    cuts = [F.percentile_approx(c, 1.0 - settings.contamination, 10_000).alias(c) for c in ranked]
    at = scored.agg(*cuts).select(F.struct(*ranked).alias("c")).scalar()
    flags = {f"{c}_flag": F.col(c) >= at[c] if c in ranked else F.col(c) > 0 for c in SCORES}
    flagged = scored.withColumns(flags)
    voting = [f"{c}_flag" for c in settings.detectors]
    return flagged.withColumn("anomaly_flag", outlier_vote(*voting, min_votes=settings.min_votes))


def outlier_scores(
    df: DataFrame,
    columns: Sequence[str] = MODEL_FEATURES,
    key: Sequence[str] = FLOW_KEY,
    settings: Settings = PRESETS["detection"],
) -> DataFrame:
    """Fit, score and vote. Scores are staged: the cuts and the flags read them, nobody computes them twice."""
    detectors = fit_detectors(df, columns, key, settings)
    return flag_outliers(staged(score_outliers(df, detectors), "outlier-scores"), settings)
