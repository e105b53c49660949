"""Forests and boosted trees grown from sums over all rows, one pass a level for all trees that grow side by side.

Rows are binned once, into blocks of bytes that stay cached with the executors. A pass sends the trees as far as they are
grown; a task walks its rows down to the open nodes and adds up a histogram of every node, feature and bin, and the driver,
which gets one array of bounded size a task or group of tasks, splits the nodes. Every row counts in the histograms of each
tree that draws it: nothing is learned from a sample of the table.

* Bin limits come from a summary of every label's rows, so that a rare label has limits of its own.
* Forest: Gini impurity on bootstrap counts, a root of the features a node. The open nodes of a level are worked on in
  groups whose histograms have at most ``MOST_CELLS`` cells.
* Boosted trees: one binary model a label with logistic loss, each tree fitted to the slopes of the loss. Margins travel
  with the blocks and are brought forward once a round; of two sister nodes the smaller is summed, the other is the rest.
* Draws depend on the seed, the block and the tree or round, so a task that runs again draws what it drew before.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import hadoop_path, scratch_root

# Ship this module's functions with the tasks: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 64
POINTS = 512  # values of a summary that bin limits are chosen from
SUMMARY_COLUMNS = ["y", "feature", "n", "values", "weights"]
BLOCK_ROWS, SMALL_ROWS = 1 << 15, 1 << 12  # rows of a block, and of one of a table that would have few
TASK_ROWS = 1 << 24  # most rows of a task
DRIVER_ROWS = 1 << 15  # the blocks of a table of no more rows are worked on by the driver
MOST_CELLS = 1 << 20  # cells of a forest's histograms in one pass
FLAT = 32  # tasks whose sums are added by the driver alone
KEPT_ROUNDS = 35  # rounds after which margins are written down
SCORED_ROWS = 4096
PAIRED = 8  # most slots whose histograms of two features at once stay in a processor's cache
COUNT_BITS = 17  # slopes as whole multiples of 2 ** -17 and row counts of a block share one double without rounding
TINY_GAIN = 1e-9  # a row; below it lies what rounding makes
BOOTSTRAP, SHARE = 1, 2  # kinds of draws
# name, bins (a line a feature), labels, weights or None, margins or None (a line a label)
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]


@dataclass(frozen=True)
class Trees:
    """Fitted trees, completed: a leaf above a tree's lowest level goes on to the left down to it."""

    limits: tuple[np.ndarray, ...]
    feature: np.ndarray
    cut: np.ndarray
    depths: tuple[int, ...]
    leaf: np.ndarray  # rows of ``values``
    values: np.ndarray
    importance: np.ndarray

    def sums(self, bins: np.ndarray) -> np.ndarray:
        """Values of the leaves that each row reaches, added over the trees."""
        rows = np.ascontiguousarray(bins.T)
        flat, lines = rows.ravel(), np.arange(rows.shape[0]) * rows.shape[1]
        found = np.zeros((rows.shape[0], self.values.shape[1]))
        for t, depth in enumerate(self.depths):
            node = np.zeros(len(lines), dtype=int)
            for _ in range(depth):
                high = flat.take(lines + self.feature[t].take(node)) > self.cut[t].take(node)
                node += node
                node += 1
                node += high
            found += self.values.take(self.leaf[t].take(node - ((1 << depth) - 1)), axis=0)
        return found


@dataclass
class Growing:
    """A tree in heap order: the children of node i are 2 i + 1 and 2 i + 2, feature -1 is a leaf."""

    levels: int
    width: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    importance: np.ndarray = field(init=False)
    depth: int = 0
    values: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        size = (2 << self.levels) - 1
        self.feature, self.cut = np.full(size, -1, dtype=np.int16), np.zeros(size, dtype=np.uint8)
        self.importance = np.zeros(self.width)

    def split(self, node: int, feature: int, cut: int, gain: float, low: np.ndarray, high: np.ndarray) -> None:
        self.feature[node], self.cut[node] = feature, cut
        self.importance[feature] += gain
        self.values[2 * node + 1], self.values[2 * node + 2] = low, high
        self.depth = max(self.depth, (node + 1).bit_length())

    def upto(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and cuts above a level."""
        size = max(1, (1 << depth) - 1)
        return self.feature[:size], self.cut[:size]

    def completed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features and cuts of the complete tree, and the node that each of its lowest places stands for."""
        node, features, cuts = np.zeros(1, dtype=int), [], []
        for _ in range(self.depth):
            leaf = self.feature[node] < 0
            features.append(np.where(leaf, 0, self.feature[node]))
            cuts.append(np.where(leaf, 255, self.cut[node]))
            node = np.stack([np.where(leaf, node, 2 * node + 1), np.where(leaf, node, 2 * node + 2)], axis=1).ravel()
        empty = [np.zeros(0, dtype=int)]
        return np.concatenate(empty + features), np.concatenate(empty + cuts), node


def _finished(grown: Sequence[Growing], limits: tuple[np.ndarray, ...], factors: Sequence[float]) -> Trees:
    depth = max(t.depth for t in grown)
    feature, cut = np.zeros((len(grown), 1 << depth), dtype=int), np.zeros((len(grown), 1 << depth), dtype=np.uint8)
    leaf, values, shares = np.zeros((len(grown), 1 << depth), dtype=int), [], []
    for t, (tree, factor) in enumerate(zip(grown, factors)):
        features, cuts, nodes = tree.completed()
        feature[t, : len(features)], cut[t, : len(cuts)] = features, cuts
        reached, place = np.unique(nodes, return_inverse=True)
        leaf[t, : len(nodes)] = place + len(values)
        values += [factor * tree.values[int(node)] for node in reached]
        shares.append(tree.importance / max(tree.importance.sum(), 1e-300))
    importance = np.sum(shares, axis=0)
    return Trees(
        limits, feature, cut, tuple(t.depth for t in grown), leaf, np.stack(values), importance / max(importance.sum(), 1e-300)
    )


# --- rows ------------------------------------------------------------------------------------------------------------


def bins_of(x: np.ndarray, limits: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of rows of features, a line a feature; a bin holds the values up to and with its limit."""
    return np.stack([np.searchsorted(edges, x[:, i]) for i, edges in enumerate(limits)]).astype(np.uint8)


def summary_of(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values with weights: all different ones where they are few, else POINTS of them, the ends among them."""
    values, place = np.unique(values, return_inverse=True)
    weights = np.bincount(place.ravel(), weights)
    if len(values) <= POINTS:
        return values, weights
    upto = weights.cumsum()
    at = np.unique(np.searchsorted(upto, np.linspace(0.0, 1.0, POINTS) * upto[-1]).clip(0, len(values) - 1))
    return values[at], np.diff(upto[at], prepend=0.0)


def limits_of(summaries: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """At most BINS - 1 limits from a summary a label: labels weigh alike, and few labels are parted at their ends."""
    values, place = np.unique(np.concatenate([v for v, _ in summaries]), return_inverse=True)
    weights = np.bincount(place.ravel(), np.concatenate([w / w.sum() for _, w in summaries]))
    after = np.zeros(len(values), dtype=bool)
    if len(values) <= BINS:
        after[:] = True
    else:
        if 4 * len(summaries) <= BINS:
            after[np.searchsorted(values, [v[-1] for v, _ in summaries])] = True
            after[np.maximum(np.searchsorted(values, [v[0] for v, _ in summaries]) - 1, 0)] = True
        left = BINS - int(after.sum())
        upto = np.minimum(weights, weights.sum() / left).cumsum()  # a frequent value fills one bin, not several
        part = np.floor(upto / upto[-1] * left - 1e-9)
        after[:-1] |= part[1:] != part[:-1]
    below = np.flatnonzero(after[:-1])
    return values[below] + (values[below + 1] - values[below]) / 2.0


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's summary of each label and feature, and its rows of the label."""
    held, rows, parts = {}, 0, []

    def folded() -> None:
        x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        for label in np.unique(y):
            mine = x[y == label]
            for i in range(x.shape[1]):
                values, weights, n = held.get((label, i), (mine[:0, i], mine[:0, i], 0))
                joined = np.concatenate([values, mine[:, i]]), np.concatenate([weights, np.ones(len(mine))])
                held[label, i] = (*summary_of(*joined), n + len(mine))

    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            parts.append((x, batch.column("y").to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            folded()
            rows, parts = 0, []
    if parts:
        folded()
    if held:
        keys, found = list(held), list(held.values())
        columns = [[int(k[0]) for k in keys], [int(k[1]) for k in keys], [f[2] for f in found], [f[0] for f in found], [f[1] for f in found]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], SUMMARY_COLUMNS)


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    """One summary of a label and feature from those of the tasks."""
    values, weights = (np.concatenate(parts[c].to_list()) for c in ("values", "weights"))
    values, weights = summary_of(values, weights)
    return pd.DataFrame({"y": parts["y"].iloc[:1], "feature": parts["feature"].iloc[:1], "n": [parts["n"].sum()], "values": [values], "weights": [weights]})


def _limits(rows: DataFrame) -> tuple[tuple[np.ndarray, ...], int]:
    """Bin limits of every feature from one pass over all rows, and the number of rows."""
    schema = "y int, feature int, n bigint, values array<double>, weights array<double>"
    found = rows.select("x", "y").mapInArrow(_summaries, schema).groupBy("y", "feature").applyInPandas(_joined, schema).collect()
    by_feature: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["feature"], r["y"])):
        by_feature.setdefault(r["feature"], []).append((np.array(r["values"]), np.array(r["weights"])))
    return tuple(limits_of(s) for s in by_feature.values()), sum(r["n"] for r in found if r["feature"] == 0)


def _blocked(limits: Sequence[np.ndarray], weighed: bool, most: int):
    """Function from a task's rows to its blocks."""

    def record(name: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        weights = w.astype(float).tobytes() if weighed else None
        parts = ([name], [np.ascontiguousarray(bins).tobytes()], [y.astype(np.uint8).tobytes()], [weights])
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(p, k) for p, k in zip(parts, kinds)]
        return pa.RecordBatch.from_arrays(columns, ["name", "bins", "labels", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, part, made = [], 0, 0, 0

        def block() -> pa.RecordBatch:
            name = (part << 32) + made
            return record(name, *(np.concatenate([h[i] for h in held], axis=-1) for i in range(3)))

        for batch in batches:
            for at in range(0, batch.num_rows, SMALL_ROWS):
                piece = batch.slice(at, SMALL_ROWS)
                x = piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(limits))
                y, w, p = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "p"))
                if rows + len(y) > most:
                    yield block()
                    held, rows, made = [], 0, made + 1
                held.append((bins_of(x, limits), y, w))
                rows, part = rows + len(y), int(p[0])
        if held:
            yield block()

    return run


def _block(row) -> Block:
    labels = np.frombuffer(row["labels"], dtype=np.uint8)
    weights = None if row["weights"] is None else np.frombuffer(row["weights"], dtype=float)
    return row["name"], np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, len(labels)), labels, weights, None


class Rows:
    """Blocks of rows, cached with the executors, or held by the driver where they are few."""

    def __init__(self, spark: SparkSession, held: list[Block] | RDD):
        self.spark, self.held = spark, held
        if isinstance(held, RDD):
            held.persist(StorageLevel.MEMORY_AND_DISK)

    def total(self, work: Callable[[Iterable[Block]], np.ndarray]) -> np.ndarray:
        """Sum of the arrays that ``work`` makes of each task's blocks."""
        if isinstance(self.held, list):
            return work(self.held)
        parts = self.held.mapPartitions(lambda blocks: [work(blocks)])
        return parts.treeReduce(np.add) if self.held.getNumPartitions() > FLAT else functools.reduce(np.add, parts.collect())

    def moved(self, step: Callable[[Block], Block], written: bool = False) -> Rows:
        """Rows whose blocks went through ``step``; ``written`` cuts their lineage in the next pass."""
        if isinstance(self.held, list):
            return Rows(self.spark, [step(b) for b in self.held])
        found = Rows(self.spark, self.held.map(step))
        if written:
            found.held.checkpoint()
        return found

    def drop(self) -> None:
        """Free the cache."""
        if isinstance(self.held, RDD):
            self.held.unpersist()

    def drop_written(self) -> None:
        """Remove the written copy, when nothing rests on it any more."""
        if isinstance(self.held, RDD) and self.held.getCheckpointFile() is not None:
            fs, target = hadoop_path(self.spark, self.held.getCheckpointFile())
            fs.delete(target, True)


def binned(vectors: DataFrame, vector: str, index: Column, weight: Column | None) -> tuple[Rows, tuple[np.ndarray, ...]]:
    """All rows in blocks, and the limits of their bins."""
    spark = vectors.sparkSession
    rows = vectors.select(
        vector_to_array(vector).alias("x"), index.cast("int").alias("y"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), F.spark_partition_id().alias("p"),
    )
    limits, count = _limits(rows)
    blocked = _blocked(limits, weight is not None, max(SMALL_ROWS, min(BLOCK_ROWS, count // 64)))
    blocks = rows.mapInArrow(blocked, "name bigint, bins binary, labels binary, weights binary")
    if count <= DRIVER_ROWS:
        return Rows(spark, [_block(r) for r in sorted(blocks.collect(), key=lambda r: r["name"])]), limits
    scratch_root(spark)  # sets a folder for margins that are written down, where none is set
    tasks = min(-(-count // BLOCK_ROWS), spark.sparkContext.defaultParallelism)
    return Rows(spark, blocks.repartition(max(tasks, -(-count // TASK_ROWS))).rdd.map(_block)), limits


# --- passes ----------------------------------------------------------------------------------------------------------


def _draws(seed: int, kind: int, number: int, name: int, rows: int) -> np.ndarray:
    return np.random.default_rng([seed, kind, number, name]).integers(0, 1 << 16, rows, dtype=np.uint16)


def _bootstrap_counts() -> np.ndarray:
    """How often a row is drawn, for each of 2 ** 16 equal chances: Poisson with mean 1."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _open_rows(
    flat: np.ndarray, count: int, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int, slot: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The rows that reach an open node of a level, and the slots of those nodes."""
    node = np.zeros(len(rows), dtype=int)
    feature = feature.astype(int)
    for _ in range(depth):
        at = feature.take(node)
        alive = at >= 0
        if not alive.all():
            rows, node, at = rows[alive], node[alive], at[alive]
        high = flat.take(at * count + rows) > cut.take(node)
        node = node + node
        node += 1
        node += high
    if len(slot) == 1:
        return rows, node
    place = slot.take(node - ((1 << depth) - 1))
    alive = place >= 0
    return (rows, place) if alive.all() else (rows[alive], place[alive])


def _forest_sums(work: Sequence[tuple], depth: int, classes: int, seed: int):
    """Function from blocks to label counts by (slot, chosen feature, bin, label); ``work`` has a tuple a tree."""
    total_slots, chosen = sum(len(w[4]) for w in work), work[0][4].shape[1]

    def run(blocks: Iterable[Block]) -> np.ndarray:
        total, times = np.zeros((total_slots, chosen, BINS * classes)), _bootstrap_counts()
        for name, bins, labels, weights, _ in blocks:
            count, flat, first = len(labels), bins.ravel(), 0
            marked = bins.astype(np.int32) * classes + labels  # bin and label in one
            marks = marked.ravel()
            for tree, feature, cut, slot, subset in work:
                drawn, slots = times.take(_draws(seed, BOOTSTRAP, tree, name, count)), len(subset)
                rows, place = _open_rows(flat, count, np.flatnonzero(drawn), feature, cut, depth, slot)
                many = drawn.take(rows).astype(float)
                if weights is not None:
                    many *= weights.take(rows)
                line = place * (BINS * classes)
                for j in range(chosen):
                    if slots == 1:
                        at = marked[subset[0, j]].take(rows)
                    else:
                        at = (subset[:, j] * count).take(place)
                        at += rows
                        at = line + marks.take(at)
                    total[first : first + slots, j] += np.bincount(at, many, slots * BINS * classes).reshape(slots, -1)
                first += slots
        return total.reshape(total_slots, chosen, BINS, classes)

    return run


def slopes_of(sign: np.ndarray, margins: np.ndarray, first: bool) -> np.ndarray:
    """What the next tree is fitted to: -1 and 1 at first, then the falling slope of 2 log(1 + exp(-2 sign margin))."""
    return sign if first else 4 * sign / (1 + np.exp(2 * sign * margins))


def _line_sums(columns: Sequence[np.ndarray], place: np.ndarray | None, slots: int, amounts: np.ndarray) -> np.ndarray:
    """Sums of ``amounts`` by (slot, line, bin). ``columns`` has, for few slots, the bins of two lines in one number."""
    found = []
    for column in columns:
        cells = BINS * BINS if slots <= PAIRED else BINS
        at = column if place is None else place * cells + column
        sums = np.bincount(at, amounts, slots * cells)
        if slots <= PAIRED:
            sums = sums.reshape(slots, BINS, BINS)
            found += [sums.sum(axis=2), sums.sum(axis=1)]
        else:
            found.append(sums.reshape(slots, BINS))
    return np.stack(found, axis=1)


def _paired(bins: np.ndarray) -> list[np.ndarray]:
    lows = [*bins[1::2], *[np.zeros_like(bins[0])] * (len(bins) % 2)]
    return [high.astype(np.int64) * BINS + low for high, low in zip(bins[::2], lows)]


def _slope_sums(work: Sequence[tuple], depth: int, width: int, seed: int, round_: int, share: float):
    """Function from blocks to rows and slopes by (slot, feature, bin); ``work`` has a tuple a label."""
    total_slots, mask = sum(w[4] for w in work), (1 << COUNT_BITS) - 1

    def run(blocks: Iterable[Block]) -> np.ndarray:
        total = np.zeros((2, total_slots, width, BINS))
        for name, bins, labels, weights, margins in blocks:
            count, flat, first, pairs = len(labels), bins.ravel(), 0, _paired(bins)
            drawn = None if share >= 1.0 else _draws(seed, SHARE, round_, name, count) < share * (1 << 16)
            chosen = np.arange(count) if drawn is None else np.flatnonzero(drawn)
            for label, line, feature, cut, slots, slot in work:
                sign = np.full(256, -1, dtype=np.float32)
                sign[label] = 1
                if depth:
                    rows, place = _open_rows(flat, count, chosen, feature, cut, depth, slot)
                    slopes = slopes_of(sign.take(labels.take(rows)), margins[line].take(rows), round_ == 0)
                    columns = [(p.take(rows)) for p in (pairs if slots <= PAIRED else bins)]
                    taken = None
                else:  # every label sums all rows: those not drawn count nothing
                    rows, place, columns, taken = slice(None), None, pairs, drawn
                    slopes = slopes_of(sign.take(labels), margins[line], round_ == 0)
                here = total[:, first : first + slots]
                first += slots
                if weights is None:
                    packed = np.rint(slopes * np.float32(1 << COUNT_BITS)).astype(float)
                    packed *= 1 << COUNT_BITS
                    packed += 1.0
                    if taken is not None:
                        packed *= taken
                    whole = _line_sums(columns, place, slots, packed)[:, :width].astype(np.int64)
                    here[0] += whole & mask
                    here[1] += (whole >> COUNT_BITS) / (1 << COUNT_BITS)
                else:
                    heavy = weights[rows] if taken is None else weights * taken
                    here[0] += _line_sums(columns, place, slots, heavy)[:, :width]
                    here[1] += _line_sums(columns, place, slots, heavy * slopes)[:, :width]
        return total

    return run


def _moved_on(work: Sequence[tuple], lines: int, first: bool):
    """Function that brings a block's margins forward by one tree a label."""

    def step(block: Block) -> Block:
        name, bins, labels, weights, margins = block
        count, flat = len(labels), bins.ravel()
        margins = np.zeros((lines, count), dtype=np.float32) if margins is None else margins.copy()
        for line, depth, feature, cut, values in work:
            node, rows = np.zeros(count, dtype=int), np.arange(count)
            for _ in range(depth):
                high = flat.take(feature.take(node) * count + rows) > cut.take(node)
                node += node
                node += 1
                node += high
            margins[line] += values.take(node - ((1 << depth) - 1))
        return name, bins, labels, weights, margins

    return step


# --- fits ------------------------------------------------------------------------------------------------------------


def _best(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest gain of each slot, with its line and bin."""
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), at], at // gain.shape[2], at % gain.shape[2]


def grow_forest(
    rows: Rows, limits: tuple[np.ndarray, ...], class_weights: Sequence[float], trees: int, depth: int, seed: int
) -> Trees:
    """Trees on bootstrap counts of all rows, whose leaves hold shares of the labels."""
    width, classes = len(limits), len(class_weights)
    chosen = math.ceil(math.sqrt(width))
    rng = np.random.default_rng([seed, depth, trees])
    grown = [Growing(depth, width) for _ in range(trees)]
    level, opened = 0, [(t, 0) for t in range(trees)]
    most = max(1, MOST_CELLS // (chosen * BINS * classes))
    while opened:
        found = []
        for at in range(0, len(opened), most):
            group = opened[at : at + most]
            subsets = rng.permuted(np.tile(np.arange(width), (len(group), 1)), axis=1)[:, :chosen]
            work = []
            for t in sorted({t for t, _ in group}):
                mine = [i for i, (u, _) in enumerate(group) if u == t]
                slot = np.full(1 << level, -1)
                slot[[group[i][1] - ((1 << level) - 1) for i in mine]] = np.arange(len(mine))
                work.append((t, *grown[t].upto(level), slot, subsets[mine]))
            sums = rows.total(_forest_sums(work, level, classes, seed))
            found += _split_forest(grown, group, subsets, sums, np.asarray(class_weights))
        level += 1
        opened = found if level < depth else []
    return _finished(grown, limits, [1.0] * trees)


def _split_forest(
    grown: Sequence[Growing], group: Sequence[tuple[int, int]], subsets: np.ndarray, sums: np.ndarray, weights: np.ndarray
) -> list[tuple[int, int]]:
    """Splits nodes by their histograms and returns the children that hold several labels."""
    upto = (sums * weights).cumsum(axis=2)
    low, both = upto[:, :, :-1], upto[:, :1, -1:]
    high = both - low
    of_low, of_high, of_both = low.sum(axis=3), high.sum(axis=3), both.sum(axis=3)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (low**2).sum(axis=3) / of_low + (high**2).sum(axis=3) / of_high - (both**2).sum(axis=3) / of_both
    tiny = 1e-12 * of_both
    gain[(of_low <= tiny) | (of_high <= tiny)] = -np.inf
    best, line, cut = _best(gain)
    opened = []
    for i, (t, node) in enumerate(group):
        all_, tree = upto[i, 0, -1], grown[t]
        if node == 0:
            tree.values[0] = all_ / all_.sum() if all_.sum() > 0 else np.full(len(weights), 1.0 / len(weights))
        if not best[i] > TINY_GAIN * all_.sum():
            continue
        parts = low[i, line[i], cut[i]], high[i, line[i], cut[i]]
        parts = [np.where(p > 1e-12 * all_.sum(), p, 0.0) for p in parts]
        tree.split(node, int(subsets[i, line[i]]), int(cut[i]), float(best[i]), *(p / p.sum() for p in parts))
        opened += [(t, 2 * node + side) for side, p in zip((1, 2), parts) if np.count_nonzero(p) > 1]
    return opened


def grow_boosted(
    rows: Rows, limits: tuple[np.ndarray, ...], labels: Sequence[int], rounds: int, depth: int, step: float, share: float,
    columns: float, seed: int,
) -> list[Trees]:
    """One model a label against all others; the labels' trees grow side by side on one set of draws."""
    width = len(limits)
    chosen = max(1, math.ceil(columns * width))
    rng = np.random.default_rng([seed, depth, rounds, *labels])
    models: list[list[Growing]] = [[] for _ in labels]
    rows, before, written = rows.moved(_moved_on([], len(labels), True)), None, None
    for round_ in range(rounds):
        trees = [Growing(depth, width) for _ in labels]
        opened = [[0] for _ in labels]
        held: list[np.ndarray | None] = [None] * len(labels)
        for level in range(depth):
            opened, held = _grow_level(rows, labels, trees, opened, held, level, round_, chosen, share, rng, seed)
            if level == 0:  # the pass has made these rows
                if before is not None:
                    before.drop()
                if isinstance(rows.held, RDD) and rows.held.getCheckpointFile() is not None:
                    if written is not None:
                        written.drop_written()
                    written = rows
            if not any(opened):
                break
        factor = step if round_ else 1.0
        work = []
        for line, tree in enumerate(trees):
            models[line].append(tree)
            features, cuts, nodes = tree.completed()
            values = factor * np.array([tree.values[int(n)][0] for n in nodes])
            work.append((line, tree.depth, features, cuts.astype(np.uint8), values.astype(np.float32)))
        if round_ + 1 < rounds:
            before, rows = rows, rows.moved(_moved_on(work, len(labels), False), round_ % KEPT_ROUNDS == KEPT_ROUNDS - 1)
    rows.drop()
    if written is not None:
        written.drop_written()
    factors = [1.0] + [step] * (rounds - 1)
    return [_finished(grown, limits, factors) for grown in models]


def _grow_level(rows, labels, trees, opened, held, level, round_, chosen, share, rng, seed):
    """Sums the open nodes of a level, or of two sisters the smaller, and splits them.

    ``opened`` has the nodes of each tree and, below the root, in pairs (smaller, larger); ``held`` their parents' histograms.
    """
    width, work, wanted = trees[0].width, [], []
    for line, (label, tree, nodes) in enumerate(zip(labels, trees, opened)):
        summed = nodes[::2]
        if not summed:
            continue
        slot = np.full(1 << level, -1)
        slot[np.array(summed) - ((1 << level) - 1)] = np.arange(len(summed))
        work.append((label, line, *tree.upto(level), len(summed), slot))
        wanted.append((line, len(summed)))
    sums, at = rows.total(_slope_sums(work, level, width, seed, round_, share)), 0
    next_opened, next_held = [[] for _ in trees], [None] * len(trees)
    for line, count in wanted:
        small, at = sums[:, at : at + count], at + count
        nodes, tree = opened[line], trees[line]
        if level:
            found = np.empty((2, 2 * count, width, BINS))
            found[:, ::2], found[:, 1::2] = small, held[line] - small
        else:
            found = small
        upto = found.cumsum(axis=3)
        count_low, low = upto[0, :, :, :-1], upto[1, :, :, :-1]
        count_all, all_ = upto[0, :, :1, -1:], upto[1, :, :1, -1:]
        count_high, high = count_all - count_low, all_ - low
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = low**2 / count_low + high**2 / count_high - all_**2 / count_all
        tiny = 1e-9 * count_all
        gain[(count_low <= tiny) | (count_high <= tiny)] = -np.inf
        hidden = rng.permuted(np.tile(np.arange(width), (len(nodes), 1)), axis=1)[:, chosen:]
        np.put_along_axis(gain, hidden[:, :, None], -np.inf, axis=1)
        best, feature, cut = _best(gain)
        kept = []
        for i, node in enumerate(nodes):
            total = float(count_all[i, 0, 0])
            if node == 0:
                tree.values[0] = np.array([all_[i, 0, 0] / total if total > 0 else 0.0])
            if not best[i] > TINY_GAIN * total:
                continue
            place = i, feature[i], cut[i]
            sides = [(count_low[place], low[place]), (count_high[place], high[place])]
            tree.split(node, int(feature[i]), int(cut[i]), float(best[i]), *(np.array([g / n]) for n, g in sides))
            pair = [2 * node + 1, 2 * node + 2]
            next_opened[line] += pair if sides[0][0] <= sides[1][0] else pair[::-1]
            kept.append(i)
        next_held[line] = found[:, kept]
    return next_opened, next_held


# --- scores ----------------------------------------------------------------------------------------------------------


def chances_of(vector: str, models: Sequence[Trees], finish: Callable[[list[np.ndarray]], np.ndarray]) -> Column:
    """Array of chances that ``finish`` makes of the models' sums for each row."""

    def score(x: pa.Array) -> pa.Array:
        raw = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        parts = []
        for at in range(0, len(raw), SCORED_ROWS):
            bins = bins_of(raw[at : at + SCORED_ROWS], models[0].limits)
            parts.append(finish([m.sums(bins) for m in models]))
        found = np.concatenate(parts) if parts else np.zeros((0, 1))
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), found.ravel())

    return F.arrow_udf(score, "array<double>")(vector_to_array(vector))


def label_shares_of(sums: list[np.ndarray]) -> np.ndarray:
    """Shares of the labels, of one forest."""
    return sums[0] / sums[0].sum(axis=1, keepdims=True)


def chances_against_rest(sums: list[np.ndarray]) -> np.ndarray:
    """Chance of each label against all others."""
    return 1.0 / (1.0 + np.exp(-2.0 * np.concatenate(sums, axis=1)))
