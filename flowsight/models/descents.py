"""One-class SVM and reconstruction network, fitted together by sums over all rows, one pass a step.

Every pass scores all rows with the current boundary and the current network. A task adds up what both need and returns one
vector of fixed size; Spark adds the vectors of the tasks in groups, and the driver gets at most GROUPS of them, takes the
next step and broadcasts nothing but the two models.

* One-class SVM with share nu on random features z of a Gaussian kernel: its dual is the shortest vector w among all
  averages of z that give no row more than 1 / (nu n). For a boundary w the lowest such average is the mean of z over the
  nu n rows with the smallest margins w z, which is also the subgradient of the primal. It comes from sums of z per margin
  bin; the shortest vector in the hull of all averages met so far is the next w. rho is the nu quantile of the margins.
* Network: input, hidden layers, linear output of the input's width; squared error with weight decay. Hidden units are
  tanh, whose smooth slope needs fewer passes than rectified units. Loss and gradient are sums over rows, so the fit does
  not depend on how the table is split; steps are limited-memory quasi-Newton.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import quoted
from .settings import PRESETS, Settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUPS = 64  # vectors that reach the driver
FINE, COARSE = 2048, 32  # bins of the margins: counts only, and counts with sums of features
DECAY = 1e-4
MEMORY = 10  # quasi-Newton pairs
BLOCK_ROWS = 512  # rows that are worked on at a time, so that their features stay in a processor's cache
Layers = list[tuple[np.ndarray, np.ndarray]]


def features_of(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random Fourier features; their products approximate the kernel."""
    return np.sqrt(2.0 / len(phases)) * np.cos(x @ directions + phases)


def quick_features_of(x: np.ndarray, turns: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """``features_of`` for directions and phases in turns: angles are exact, their cosines of single precision."""
    angles = x @ turns
    angles += phases
    angles -= np.rint(angles)
    angles *= 2.0 * np.pi
    found = np.cos(angles.astype(np.float32)).astype(float)
    found *= np.sqrt(2.0 / len(phases))
    return found


def layers_of(weights: np.ndarray, sizes: Sequence[int]) -> Layers:
    """Weight matrix and offsets of each layer, as views of one vector."""
    found, at = [], 0
    for low, high in zip(sizes, sizes[1:]):
        matrix = weights[at : at + low * high].reshape(low, high)
        at += low * high
        found.append((matrix, weights[at : at + high]))
        at += high
    return found


def start_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for low, high in zip(sizes, sizes[1:]):
        span = np.sqrt(6.0 / (low + high))
        parts += [rng.uniform(-span, span, low * high), rng.uniform(-span, span, high)]
    return np.concatenate(parts)


def _activations(x: np.ndarray, layers: Layers) -> list[np.ndarray]:
    found = [x]
    for i, (matrix, offsets) in enumerate(layers):
        x = x @ matrix + offsets
        if i < len(layers) - 1:
            x = np.tanh(x)
        found.append(x)
    return found


def reconstruction_errors(x: np.ndarray, layers: Layers) -> np.ndarray:
    """Mean squared error of each row."""
    return ((_activations(x, layers)[-1] - x) ** 2).mean(axis=1)


def network_sums(x: np.ndarray, layers: Layers) -> np.ndarray:
    """Half the summed errors, then their gradient in the order of the weights."""
    values = _activations(x, layers)
    delta = (values[-1] - x) / x.shape[1]
    loss = 0.5 * float((delta * (values[-1] - x)).sum())
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(values[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
        if i:
            delta = (delta @ layers[i][0].T) * (1.0 - values[i] ** 2)
    return np.concatenate([[loss], *parts])


@dataclass
class Boundary:
    """State of the SVM: averages met, their best mix w, and the margin range that the bins cover."""

    nu: float
    w: np.ndarray
    atoms: list[np.ndarray] = field(default_factory=list)
    mix: np.ndarray = field(default_factory=lambda: np.zeros(0))
    low: float = -2.0
    high: float = 2.0
    edge: float = 0.25
    spread: float = 0.25
    rho: float = 0.0

    def bins(self) -> tuple[np.ndarray, np.ndarray]:
        fine = np.linspace(self.low, self.high, FINE - 1)
        return fine, self.edge + self.spread * np.linspace(-1, 1, COARSE - 1)

    def step(self, sums: np.ndarray) -> None:
        fine_counts, sums = sums[:FINE], sums[FINE:]
        counts, totals = sums[:COARSE], sums[COARSE:].reshape(COARSE, -1)
        need = self.nu * counts.sum()
        if not self.atoms:
            self._take(totals.sum(axis=0) / counts.sum())  # w was 0: all margins are equal
            return
        fine, _ = self.bins()
        self.rho = _quantile(fine, fine_counts, self.nu)
        before = np.cumsum(counts) - counts
        share = np.clip((need - before) / np.maximum(counts, 1), 0.0, 1.0)
        lowest = (share * counts) > 0
        self._take((share[lowest] @ totals[lowest]) / need)
        filled = np.flatnonzero(fine_counts)
        span = np.r_[self.low, fine, self.high]
        low, high = span[max(filled[0], 0)], span[min(filled[-1] + 1, len(span) - 1)]
        margin = 0.2 * (high - low) + 1e-9
        self.low, self.high = max(-2.0, low - margin), min(2.0, high + margin)
        near = [_quantile(fine, fine_counts, q) for q in (self.nu / 2, min(1.0, 2 * self.nu))]
        self.edge, self.spread = self.rho, max(1e-6, near[1] - near[0])

    def _take(self, atom: np.ndarray) -> None:
        self.atoms.append(atom)
        self.mix = shortest_mix(np.stack(self.atoms), np.r_[self.mix, 0.0 if len(self.mix) else 1.0])
        self.w = self.mix @ np.stack(self.atoms)


def _quantile(edges: np.ndarray, counts: np.ndarray, share: float) -> float:
    """Value below which ``share`` of the counted values lie; linear within a bin."""
    upto = np.cumsum(counts)
    bin_ = int(np.searchsorted(upto, share * upto[-1]))
    if bin_ == 0:
        return float(edges[0])
    if bin_ >= len(edges):
        return float(edges[-1])
    inside = (share * upto[-1] - upto[bin_ - 1]) / max(counts[bin_], 1)
    return float(edges[bin_ - 1] + inside * (edges[bin_] - edges[bin_ - 1]))


def shortest_mix(atoms: np.ndarray, mix: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Weights of the shortest vector in the hull of a few atoms: weight moves from the worst atom to the best."""
    products, mix = atoms @ atoms.T, mix.copy()
    for _ in range(steps):
        slope = products @ mix
        to, source = int(np.argmin(slope)), int(np.argmax(np.where(mix > 0, slope, -np.inf)))
        gap = slope[source] - slope[to]
        bend = products[to, to] + products[source, source] - 2 * products[to, source]
        if gap <= 1e-14 or bend <= 0:
            break
        moved = min(mix[source], gap / bend)
        mix[to] += moved
        mix[source] = max(0.0, mix[source] - moved)
    return mix


@dataclass
class Descent:
    """Limited-memory quasi-Newton with one evaluation a pass: ``trial`` is where to evaluate next."""

    trial: np.ndarray
    at: np.ndarray | None = None
    loss: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    length: float = 1.0
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def step(self, loss: float, gradient: np.ndarray) -> None:
        if self.at is None or loss <= self.loss + 1e-4 * self.length * float(self.gradient @ self.direction):
            if self.at is not None:
                moved, bent = self.trial - self.at, gradient - self.gradient
                if moved @ bent > 1e-10 * (bent @ bent):
                    self.pairs = [*self.pairs, (moved, bent)][-MEMORY:]
            self.at, self.loss, self.gradient = self.trial, loss, gradient
            self.direction = self._newton()
            self.length = 1.0 if self.pairs else min(1.0, 1.0 / max(1e-12, float(np.abs(gradient).sum())))
        else:
            self.length *= 0.3
        self.trial = self.at + self.length * self.direction

    def _newton(self) -> np.ndarray:
        q, kept = self.gradient.copy(), []
        for moved, bent in reversed(self.pairs):
            a = (moved @ q) / (moved @ bent)
            q -= a * bent
            kept.append(a)
        if self.pairs:
            moved, bent = self.pairs[-1]
            q *= (moved @ bent) / (bent @ bent)
        for (moved, bent), a in zip(self.pairs, reversed(kept)):
            q += (a - (bent @ q) / (moved @ bent)) * moved
        return -q


def _task_sums(mean, scale, directions, phases, w, fine, coarse, weights, sizes):
    """Function from a task's rows to one row (slot, sums)."""

    turns, shifts = directions / (2.0 * np.pi), phases / (2.0 * np.pi)

    def block(x: np.ndarray, layers: Layers) -> np.ndarray:
        z = quick_features_of(x, turns, shifts)
        margins = z @ w
        place = np.searchsorted(coarse, margins, side="right")
        member = np.zeros((COARSE, len(x)))
        member[place, np.arange(len(x))] = 1.0
        return np.concatenate(
            [
                np.bincount(np.searchsorted(fine, margins, side="right"), minlength=FINE),
                np.bincount(place, minlength=COARSE),
                (member @ z).ravel(),
                network_sums(x, layers),
            ]
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layers, total, slot = layers_of(weights, sizes), None, 0
        for batch in batches:
            slot = int(batch["_slot"].iloc[0])
            x = (batch.drop(columns="_slot").to_numpy(dtype=float) - mean) / scale
            for at in range(0, len(x), BLOCK_ROWS):
                sums = block(np.ascontiguousarray(x[at : at + BLOCK_ROWS]), layers)
                total = sums if total is None else total + sums
        if total is not None:
            yield pd.DataFrame({"slot": [slot], "sums": [total]})

    return run


def _grouped(parts: DataFrame) -> DataFrame:
    """One vector a slot: what the tasks of a slot have summed, added by Spark."""
    summed = parts.groupBy("slot").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    return summed.withColumn("sums", vector_to_array("sums"))


def fit_descents(
    df: DataFrame, columns: Sequence[str], mean: np.ndarray, scale: np.ndarray, directions: np.ndarray, phases: np.ndarray,
    rows: int, settings: Settings = PRESETS["detection"],
) -> tuple[np.ndarray, float, np.ndarray]:
    """(w, rho, network weights) after ``descent_passes`` steps of both over all rows, and a last pass for rho."""
    sizes = (len(columns), *settings.network_layers, len(columns))
    boundary = Boundary(settings.contamination, np.zeros(len(phases)))
    descent = Descent(start_weights(sizes, settings.seed))
    slot = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("_slot")
    inputs = df.select(*[quoted(c) for c in columns], slot)
    few = inputs.rdd.getNumPartitions() <= GROUPS

    for _ in range(settings.descent_passes + 1):
        run = _task_sums(mean, scale, directions, phases, boundary.w, *boundary.bins(), descent.trial, sizes)
        parts = inputs.mapInPandas(run, "slot int, sums array<double>")
        found = parts.collect() if few else _grouped(parts).collect()
        sums = np.sum([r["sums"] for r in sorted(found, key=lambda r: r["slot"])], axis=0)
        svm, network = sums[: FINE + COARSE + COARSE * len(phases)], sums[FINE + COARSE + COARSE * len(phases) :]
        held = boundary.w
        boundary.step(svm)
        loss = network[0] / rows + 0.5 * DECAY * float(descent.trial @ descent.trial) / rows
        descent.step(loss, network[1:] / rows + DECAY * descent.trial / rows)
    # rho belongs to the margins of the w that the last pass has seen
    return held, boundary.rho, descent.at
