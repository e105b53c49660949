"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q that is at least max(6, 4 q) words long and that no
neighbouring word extends with period q. For 2**k <= q < 2**(k+1) every such run holds an aligned block of 2**k words among
its first 2 q words, and that block occurs again q words later. So, for each k:

* the texts of a pool of documents stand behind one another, each closed by a mark of its own, as one sequence of word
  numbers; prefix doubling ranks all its factors of 2**k words and ends in the suffix array;
* a wavelet tree over the suffix array answers range successor queries: of the places at which a block occurs (an interval
  of the suffix array), the first, the second and the last one in the window from 2**k to 2**(k+1) words behind it. The
  window is twice as long as the block, so the occurrences in it form one arithmetic progression, whose members minus
  the block's place are the candidate periods;
* the ranks of all k give the longest common extension of two places in log n steps, to either side: a candidate becomes
  the longest stretch with that period or is rejected. A stretch found with several periods keeps the smallest.

Blocks that occur less than three times in a pool cannot lie in a run and are not asked for. All queries of one k are
answered together, in numpy. Spark deals out the documents and there is no shuffle; a pool is about POOL_BYTES of text.

Null and empty texts have no words, no runs and an empty collapsed text. A very long text is a pool of its own, searched
whole, in about 60 bytes a word and level of k. Repeated rows and repeated or null ids: every row is searched on its own.
An empty table gives an empty table. All input columns are kept, except that ``runs`` and ``collapsed`` replace columns of
these names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, map_arrow, words
from .pieces import by_bytes

POOL_BYTES = 1 << 20
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _ranks(codes: np.ndarray, most: int) -> list[np.ndarray]:
    """For k = 0, 1, ...: how many suffixes have a smaller prefix of 2**k numbers. Ends at ``most`` or when all differ."""
    size = len(codes)
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    rank = np.empty(size, np.int32)
    rank[order] = np.repeat(first, np.diff(np.r_[first, size]))
    levels, step = [rank], 1
    while len(levels) <= most:
        many = np.bincount(rank, minlength=size)[rank] > 1
        open_ = np.flatnonzero(many)
        if not open_.size:
            break
        ahead = open_ + step
        second = np.where(ahead < size, rank[np.minimum(ahead, size - 1)], -1).astype(np.int64)
        pair = rank[open_].astype(np.int64) * (size + 1) + second + 1
        order = np.argsort(pair, kind="stable")
        pair, member = pair[order], open_[order]
        group = pair // (size + 1)
        place = np.arange(len(pair))
        new_group = np.r_[True, group[1:] != group[:-1]]
        new_pair = np.r_[True, pair[1:] != pair[:-1]]
        base = np.maximum.accumulate(np.where(new_group, place, 0))
        start = np.maximum.accumulate(np.where(new_pair, place, 0))
        rank = rank.copy()
        rank[member] = group + start - base
        levels.append(rank)
        step *= 2
    return levels


class _Successors:
    """Wavelet tree over a permutation: counts and order statistics of its values in intervals."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            high = ones.astype(bool)
            low = values[~high]
            self.levels.append((bit, before, np.int32(len(low))))
            values = np.concatenate([low, values[high]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each interval are smaller than its bound."""
        count = np.zeros(len(low), np.int32)
        for bit, before, zeros in self.levels:
            low_ones, high_ones = before[low], before[high]
            up = (bound >> bit) & 1 == 1
            low_zeros, high_zeros = low - low_ones, high - high_ones
            count += np.where(up, high_zeros - low_zeros, 0)
            low, high = np.where(up, zeros + low_ones, low_zeros), np.where(up, zeros + high_ones, high_zeros)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with n smaller ones in each interval."""
        value = np.zeros(len(low), np.int32)
        for bit, before, zeros in self.levels:
            low_ones, high_ones = before[low], before[high]
            low_zeros, high_zeros = low - low_ones, high - high_ones
            smaller = high_zeros - low_zeros
            up = n >= smaller
            n = np.where(up, n - smaller, n)
            value |= up.astype(np.int32) << bit
            low, high = np.where(up, zeros + low_ones, low_zeros), np.where(up, zeros + high_ones, high_zeros)
        return value


def _extension(levels: list[np.ndarray], one: np.ndarray, two: np.ndarray, back: bool) -> np.ndarray:
    """Equal numbers from ``one`` and ``two`` on (or, ``back``, up to and with them). ``two`` is the later place."""
    size, length = len(levels[0]), np.zeros(len(one), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step, rank = 1 << k, levels[k]
        active = np.arange(len(one))
        while active.size:
            a, b = one[active], two[active]
            if back:
                a, b = a - length[active] - step + 1, b - length[active] - step + 1
            else:
                a, b = a + length[active], b + length[active]
            inside = (a >= 0) & (b + step <= size)
            same = inside & (rank[np.maximum(a, 0)] == rank[np.minimum(b, size - 1)])
            active = active[same]
            length[active] += step
            if k < len(levels) - 1:
                break
    return length


def _candidates(levels: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block place, candidate period); ``sizes`` has the words of the document at each place."""
    rank = levels[-1]
    # ties, where the doubling ended before all suffixes differ, in order of place
    tree = _Successors(np.argsort(rank, kind="stable").astype(np.int32))
    places, periods = [], []
    for k, rank in enumerate(levels):
        step = 1 << k
        block = np.arange(0, len(rank) - step + 1, step, dtype=np.int32)
        count = np.bincount(rank, minlength=len(rank)).astype(np.int32)
        low = rank[block]
        asked = (count[low] >= 3) & (sizes[block] >= max(LEAST_LENGTH, LEAST_EXPONENT * step))
        block, low = block[asked], low[asked]
        high = low + count[low]
        smaller = tree.below(low, high, block + step)
        found = tree.below(low, high, np.minimum(block + 2 * step, len(rank) - 1)) - smaller
        hit = found > 0
        block, low, high, smaller, found = block[hit], low[hit], high[hit], smaller[hit], found[hit]
        if not block.size:
            continue
        first = tree.nth(low, high, smaller)
        apart = np.zeros(len(block), np.int32)
        more = found > 1
        apart[more] = tree.nth(low[more], high[more], smaller[more] + 1) - first[more]
        member = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
        places.append(np.repeat(block, found))
        periods.append(np.repeat(first - block, found) + member * np.repeat(apart, found))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places).astype(np.int64), np.concatenate(periods).astype(np.int64)


def pool_runs(texts: list[list[bytes]]) -> list[Runs]:
    """(starts, lengths, periods) of the runs of each word list, by start and then period."""
    numbers = _Numbers()
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # a mark follows each text
    codes = np.empty(int(sizes.sum()) + len(texts), np.int64)
    for text, start in zip(texts, starts):
        codes[start : start + len(text)] = [numbers[w] for w in text]
    codes[starts + sizes] = len(numbers) + np.arange(len(texts))
    longest = int(sizes.max(initial=0))
    if longest < LEAST_LENGTH:
        return [(np.zeros(0, np.int64),) * 3] * len(texts)
    levels = _ranks(codes, max(0, (longest // LEAST_EXPONENT).bit_length() - 1))
    place, period = _candidates(levels, np.repeat(sizes, sizes + 1))
    right = _extension(levels, place, place + period, back=False)
    left = _extension(levels, place - 1, place + period - 1, back=True)
    start, length = place - left, left + right + period
    good = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    if len(start):
        smallest = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
        start, length, period = start[smallest], length[smallest], period[smallest]
        order = np.lexsort((period, start))
        start, length, period = start[order], length[order], period[order]
    cuts = np.searchsorted(start, [*starts, len(codes)])
    return [(start[a:b] - s, length[a:b], period[a:b]) for a, b, s in zip(cuts, cuts[1:], starts)]


def kept_words(text: list[bytes], runs: Runs) -> list[bytes]:
    """The words that no run contains behind its first period."""
    if not len(runs[0]):
        return text
    start, length, period = runs
    depth = np.zeros(len(text) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return [text[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``docs`` with ``runs``, by start and then period, and ``collapsed``: the kept words, joined by one space.

    ``rewrite`` (doc_id, words) may give the words to search instead of those of the text.
    """
    kept = docs.drop("runs", "collapsed")
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema]
    parts = {name: pa.int64() for name in ("start", "length", "period")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bytes(batches, POOL_BYTES):
            texts = [words(t) for t in byte_texts(rows.column("text"))]
            if rewrite:
                texts = [rewrite(i, t) for i, t in zip(rows.column("doc_id").to_pylist(), texts)]
            found = pool_runs(texts)
            collapsed = [b" ".join(kept_words(t, r)) for t, r in zip(texts, found)]
            ends = np.cumsum([0, *[len(r[0]) for r in found]]).astype(np.int32)
            values = [pa.array(np.concatenate([r[i] for r in found] or [np.zeros(0, np.int64)]), pa.int64()) for i in range(3)]
            runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, names=list(parts)))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*rows.schema.names, "runs", "collapsed"]
            )

    return map_arrow(kept, run, ", ".join([*fields, f"runs array<{RUN}>", "collapsed string"]))


def run_report(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the run with the greatest exact exponent, digests of runs and kept words."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    # runs are in order of start and period, so the first of equal exponents stays
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda b, r: F.when(longer(b, r), r).otherwise(b))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("_best"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
