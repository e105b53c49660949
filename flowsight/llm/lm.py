"""Language-model scoring with a gated recurrent unit and a class-factored softmax.

All words of the training documents are counted by Spark: N tokens, V distinct ones. The ``HEAD`` most frequent words are
divided into classes of about equal size by frequency; every other word, also a word never seen, is in one more class.
The network gives the probability of a token's class and, for a frequent word, of the word within its class. Within
the last class words have their add-half unigram probability from the full counts, so the model is a distribution
over the same V + 1 words as the base score, and what it learns from grows with the corpus.

The unit is trained in numpy by backpropagation truncated at ``UNROLL`` tokens, with the state carried from one window
to the next within a document. Every token of every training document is trained on once in each of ``ROUNDS`` rounds. The
documents are dealt to tasks and into ``PARTS`` parts; for each part every task starts from the common weights, streams its
documents of that part and returns its own weights, which Spark averages block by block. A step counts by the share of
its window that is filled, so that the last stream to end doesn't outweigh the others.
Output biases start at the unigram logarithms. Scoring runs over whole documents, many side by side, one token a step.

A task knows the ``KNOWN`` most frequent words (a proven bound); occurrences of rarer words are joined with the table of counts,
where no word is frequent enough to be a hot key. Rows are told apart by their task and place in it, so repeated ids
do no harm. Null and empty texts are the end token alone. With no training token the scores are those of V = N = 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .common import FOLD, byte_texts, map_arrow, pooled, ship, words

END = b"\n"  # no word holds a blank
HEAD = 2048
CLASSES = 45
HIDDEN = 24
KNOWN = 200_000
UNROLL = 16
STREAMS = 128
LEAST_STEPS = 100  # a small corpus is trained on in fewer streams, so that a pass has about so many steps
ROUNDS = 1
PARTS = 2
TASK_TOKENS = 2_000_000
RATE = 0.01
POOL_BYTES = 16 << 20
_FLUSH = 300_000
_BLOCK = 4096
_ROWS, _BESIDE, _TOGETHER = 2048, 512, 8  # states, texts and classes that products are formed of at once, so that they stay in cache
LN10 = math.log(10)


def tokens(text: bytes) -> list[bytes]:
    return [*words(text.translate(FOLD)), END]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences of every token in ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in byte_texts(batch.column("text")):
                seen.update(tokens(text))
            if len(seen) >= _FLUSH:
                yield out()
                seen = Counter()
        yield out()

    found = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Ids of the frequent words by falling count, their classes, and the counts of all words a task knows."""

    def __init__(self, known: list[tuple[bytes, int]], n: int, v: int, head: int = HEAD, classes: int = CLASSES):
        self.n, self.v = n, v
        self.places = {w: k for k, (w, _) in enumerate(known)}
        self.counts = np.array([c for _, c in known], np.int64)
        top = known[:head]
        self.ids = {w: k for k, (w, _) in enumerate(top)}
        # Classes of falling size in words: each holds about the square root of a share of the mass.
        mass = np.sqrt(np.array([c for _, c in top], float)) if top else np.zeros(0)
        self.class_of = np.minimum((np.cumsum(mass) - mass) / max(mass.sum(), 1e-9) * classes, classes - 1).astype(np.int64)
        self.class_of = np.unique(self.class_of, return_inverse=True)[1] if len(top) else self.class_of
        self.classes = int(self.class_of.max()) + 1 if len(top) else 0
        self.starts = np.searchsorted(self.class_of, np.arange(self.classes + 1))
        self.group_of = np.append(self.class_of, self.classes).astype(np.int16)  # of every id
        self.rare = len(top)  # the id of every other word
        self.rare_n = n - sum(c for _, c in top)
        self.rare_v = v - len(top)
        self.head_counts = np.array([c for _, c in top], float)

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the add-half probability of words with these counts."""
        return np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def encode(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, ws, repeat(self.rare)), np.int32, len(ws))


def first_weights(vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    v, c, h = vocabulary.rare + 1, vocabulary.classes + 1, hidden
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    head = vocabulary.head_counts + 0.5
    by_class = np.array([*(head[a:b].sum() for a, b in zip(vocabulary.starts, vocabulary.starts[1:], strict=False)), vocabulary.rare_n + 0.5 * (vocabulary.rare_v + 1)])
    return {
        "E": draw(v, h), "W": draw(h, 3 * h), "U": draw(h, 3 * h), "b": np.zeros(3 * h, np.float32),
        "C": draw(h, c) * 0.1, "cb": np.log(by_class / by_class.sum()).astype(np.float32),
        "O": draw(vocabulary.rare, h) * 0.1, "ob": np.log(head).astype(np.float32),
    }


def _unshifted(weights: np.ndarray, bias: np.ndarray, starts: np.ndarray) -> bool:
    """Can no exponential of a product with states in (-1, 1) overflow, nor a sum over the rows from one of ``starts`` to the next vanish?"""
    if not len(bias):
        return True
    reach = np.abs(weights).sum(1)
    return bool((bias + reach).max() < 75 and np.maximum.reduceat(bias - reach, starts).min() > -75)


def _logits(weights: np.ndarray, bias: np.ndarray, hidden: np.ndarray, unshifted: bool) -> np.ndarray:
    """One column for each row of ``hidden``, so that sums over outcomes run along rows; columns are shifted if they have to be."""
    out = weights @ hidden.T
    out += bias[:, None]
    if not unshifted:
        out -= out.max(0)
    return out


def _by_class(target: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each target, their order by class, and where each class begins in that order."""
    group = vocabulary.group_of[target]
    order = np.argsort(group, kind="stable")
    return group, order, np.searchsorted(group[order], np.arange(vocabulary.classes + 1))


def _step(inner: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next state, the gates (in place of the first rows of ``inner``) and the new values; one column for each text."""
    h = len(state)
    gates, given = inner[: 2 * h], inner[2 * h :]
    gates += x[: 2 * h]
    gates *= 0.5  # the logistic function
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    new = gates[h:] * given
    new += x[2 * h :]
    np.tanh(new, out=new)
    out = state - new
    out *= gates[:h]
    out += new
    return out, gates, new


def log_likelihoods(w: dict[str, np.ndarray], vocabulary: Vocabulary, hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logarithms: of the class and, for frequent words, of the word in it."""
    group, order, cuts = _by_class(target, vocabulary)
    out = np.empty(len(target))
    classes = np.ascontiguousarray(w["C"].T)
    plain = _unshifted(classes, w["cb"], np.zeros(1, np.int64))
    for at in range(0, len(target), _ROWS):
        part = slice(at, at + _ROWS)
        logits = _logits(classes, w["cb"], hidden[part], plain)
        out[part] = logits[group[part], np.arange(logits.shape[1])]
        out[part] -= np.log(np.exp(logits, out=logits).sum(0))
    plain = _unshifted(w["O"], w["ob"], vocabulary.starts[:-1])
    inside, mine = hidden[order[: cuts[-1]]], target[order[: cuts[-1]]]
    more = np.zeros(cuts[-1])
    for k in np.flatnonzero(np.diff(cuts)):
        part = slice(vocabulary.starts[k], vocabulary.starts[k + 1])
        for at in range(cuts[k], cuts[k + 1], _ROWS):
            rows = slice(at, min(at + _ROWS, cuts[k + 1]))
            logits = _logits(w["O"][part], w["ob"][part], inside[rows], plain)
            more[rows] = logits[mine[rows] - part.start, np.arange(logits.shape[1])]
            more[rows] -= np.log(np.exp(logits, out=logits).sum(0))
    out[order[: cuts[-1]]] += more
    return out


def score_texts(w: dict[str, np.ndarray], vocabulary: Vocabulary, texts: list[np.ndarray], steps: int = 32) -> np.ndarray:
    """Sum of log_likelihoods over each text; the state starts at zero and is carried through the whole text."""
    out = np.zeros(len(texts))
    order = np.argsort([-len(t) for t in texts], kind="stable")
    inputs = np.concatenate([w["E"] @ w["W"], np.zeros((1, w["W"].shape[1]), w["W"].dtype)]) + w["b"]  # the last: no token before the first
    recurrent = np.ascontiguousarray(w["U"].T)
    for at in range(0, len(texts), _BESIDE):
        some = order[at : at + _BESIDE]
        out[some] = _score_beside(w, vocabulary, [texts[k] for k in some], inputs, recurrent, steps)
    return out


def _score_beside(w: dict[str, np.ndarray], vocabulary: Vocabulary, texts: list[np.ndarray], inputs: np.ndarray, recurrent: np.ndarray, steps: int) -> np.ndarray:
    """Scores of texts by falling length, one token of each a step."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts))
    flat = np.concatenate([*texts, np.full(1, -1, np.int64)])
    starts = np.cumsum(sizes) - sizes
    h = len(recurrent) // 3
    state = np.zeros((h, len(texts)), inputs.dtype)
    for at in range(0, int(sizes[0]), steps):
        times = np.arange(at, min(at + steps, int(sizes[0])))
        lives = np.searchsorted(-sizes, -times, side="left")  # texts that are longer
        ends = np.cumsum(lives)
        hidden = np.empty((ends[-1], h), inputs.dtype)
        owner, target = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.int64)
        for t, live, end in zip(times.tolist(), lives.tolist(), ends.tolist(), strict=True):
            place = starts[:live] + t
            x = inputs[flat[place - 1]] if t else inputs[np.full(live, -1)]
            state = _step(recurrent @ state[:, :live], x.T, state[:, :live])[0]
            hidden[end - live : end] = state.T
            owner[end - live : end], target[end - live : end] = np.arange(live), flat[place]
        out += np.bincount(owner, log_likelihoods(w, vocabulary, hidden, target), minlength=len(texts))
    return out


class Trainer:
    """Adam steps over windows of UNROLL tokens of ``streams`` texts side by side."""

    def __init__(self, weights: dict[str, np.ndarray], vocabulary: Vocabulary, rate: float = RATE, streams: int = STREAMS):
        self.streams = streams
        self.w = {k: v.copy() for k, v in weights.items()}
        self.vocabulary, self.rate, self.t = vocabulary, rate, 0
        self.fill = 1.0  # share of a full window that the present step rests on
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.g, self.some = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
        self.spaces: dict[str, np.ndarray] = {}
        np.empty(16 << 20, np.uint8)  # freed at once: from then on the C library keeps smaller freed blocks for the next window

    def space(self, name: str, *shape: int) -> np.ndarray:
        """An array of that shape with any values. It lies where the last one of that name lay: fresh pages in each window cost as much as the arithmetic."""
        size = math.prod(shape)
        if name not in self.spaces or self.spaces[name].size < size:
            self.spaces[name] = np.empty(size, self.w["U"].dtype)
        return self.spaces[name][:size].reshape(shape)

    def outcomes(self, g: dict[str, np.ndarray], hidden: np.ndarray, target: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Adds the gradients of class and word to ``g`` and puts those of the states into ``out``. All for the sum over the rows."""
        w, vocabulary = self.w, self.vocabulary
        group, order, cuts = _by_class(target, vocabulary)
        hidden, target, group = hidden[order], target[order], group[order]
        back = np.empty_like(hidden)
        classes = np.ascontiguousarray(w["C"].T)
        plain = _unshifted(classes, w["cb"], np.zeros(1, np.int64))
        for at in range(0, len(target), _ROWS):
            rows = slice(at, at + _ROWS)
            d = _logits(classes, w["cb"], hidden[rows], plain)
            np.exp(d, out=d)
            d *= 1 / d.sum(0)
            d[group[rows], np.arange(d.shape[1])] -= 1
            g["C"] += (d @ hidden[rows]).T
            g["cb"] += d.sum(1)
            np.matmul(d.T, classes, out=back[rows])
        plain = _unshifted(w["O"], w["ob"], vocabulary.starts[:-1])
        for low in range(0, vocabulary.classes, _TOGETHER):  # classes of about equal size, filled up to the largest
            high = min(low + _TOGETHER, vocabulary.classes)
            a, b, first, last = cuts[low], cuts[high], vocabulary.starts[low], vocabulary.starts[high]
            if a == b:
                continue
            counts, sizes = np.diff(cuts[low : high + 1]), np.diff(vocabulary.starts[low : high + 1])
            row_on, word_on = np.arange(counts.max()) < counts[:, None], np.arange(sizes.max()) < sizes[:, None]
            mine, words_, bias = np.zeros((*row_on.shape, hidden.shape[1]), hidden.dtype), np.zeros((*word_on.shape, hidden.shape[1]), hidden.dtype), np.full(word_on.shape, -np.inf, hidden.dtype)
            mine[row_on], words_[word_on], bias[word_on] = hidden[a:b], w["O"][first:last], w["ob"][first:last]
            d = words_ @ mine.transpose(0, 2, 1)
            d += bias[:, :, None]
            if not plain:
                d -= d.max(1, keepdims=True)
            np.exp(d, out=d)
            d *= row_on[:, None] / d.sum(1, keepdims=True)
            which, place = np.nonzero(row_on)
            d[which, target[a:b] - vocabulary.starts[low + which], place] -= 1
            g["O"][first:last] = (d @ mine)[word_on]
            g["ob"][first:last] = d.sum(2)[word_on]
            back[a:b] += (d.transpose(0, 2, 1) @ words_)[row_on]
        out[order] = back
        return out

    def window(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, state: np.ndarray) -> np.ndarray:
        """One step on inputs x, targets y (both time by stream, input -1: none) from ``state``; returns the next state."""
        w, h, (times, streams) = self.w, state.shape[1], x.shape
        kind = w["U"].dtype
        embedded = self.space("embedded", times, streams, h)
        np.take(w["E"], x, 0, out=embedded, mode="clip")
        embedded[x < 0] = 0
        # Gates, states and their gradients have one column for each stream.
        given = np.matmul(w["W"].T, embedded.transpose(0, 2, 1), out=self.space("given", times, 3 * h, streams))
        given += w["b"][:, None]
        recurrent = np.ascontiguousarray(w["U"].T)
        states, inner, new = self.space("states", times + 1, h, streams), self.space("inner", times, 3 * h, streams), self.space("new", times, h, streams)
        states[0] = state.T
        for t in range(times):
            np.matmul(recurrent, states[t], out=inner[t])
            states[t + 1], _, new[t] = _step(inner[t], given[t], states[t])
        update, reset, inner = inner[:, :h], inner[:, h : 2 * h], inner[:, 2 * h :]
        g = self.g
        for k in g:
            g[k].fill(0)
        hidden = self.space("hidden", times, streams, h)
        hidden[:] = states[1:].transpose(0, 2, 1)
        hidden = hidden.reshape(-1, h)
        on = np.flatnonzero(live.ravel())
        n = max(len(on), 1)
        rows = self.space("rows", times, streams, h)
        if len(on) == len(hidden):
            self.outcomes(g, hidden, y.ravel(), rows.reshape(-1, h))
        else:
            rows.fill(0)
            rows.reshape(-1, h)[on] = self.outcomes(g, hidden[on], y.ravel()[on], np.empty((len(on), h), kind))
        for k in ("C", "cb", "O", "ob"):
            g[k] *= 1 / n
        back = np.multiply(rows.transpose(0, 2, 1), kind.type(1 / n), out=self.space("back", times, h, streams))
        # Factors of the gradients of new values, update, reset and reset values.
        of_state, of_new = self.space("factors", 2, times, 2, h, streams)
        spare = np.subtract(1, update, out=self.space("spare", times, h, streams))
        np.subtract(states[:-1], new, out=of_state[:, 1])
        of_state[:, 1] *= update
        of_state[:, 1] *= spare
        np.multiply(new, new, out=of_state[:, 0])
        np.subtract(1, of_state[:, 0], out=of_state[:, 0])
        of_state[:, 0] *= spare
        np.subtract(1, reset, out=spare)
        np.multiply(inner, reset, out=of_new[:, 0])
        of_new[:, 0] *= spare
        of_new[:, 1] = reset
        d = self.space("d", times, 4, h, streams)
        flat_d = d.reshape(times, 4 * h, streams)
        carried = np.zeros((h, streams), kind)
        for t in reversed(range(times)):
            carried += back[t]
            np.multiply(carried, of_state[t], out=d[t, :2])
            np.multiply(d[t, 0], of_new[t], out=d[t, 2:])
            carried *= update[t]
            carried += w["U"] @ flat_d[t, h:]
        g["U"][:] = np.matmul(states[:-1], flat_d[:, h:].transpose(0, 2, 1)).sum(0)
        dx = self.space("dx", times, streams, 3 * h)
        dx[:] = flat_d[:, : 3 * h].transpose(0, 2, 1)
        dx = dx.reshape(-1, 3 * h)
        turn = np.roll(np.arange(3 * h), -h)  # new values stand first in dx and last in W and b
        g["b"][:] = (np.ones(len(dx), kind) @ dx)[turn]
        g["W"][:] = (embedded.reshape(-1, h).T @ dx)[:, turn]
        # Rows of one word are added up as differences of running sums, in double precision.
        np.matmul(dx, w["W"].T[turn.argsort()], out=(rows := rows.reshape(-1, h)))
        ids = x.ravel()
        order = np.argsort(ids.astype(np.int16 if len(w["E"]) < 1 << 15 else np.int64), kind="stable")
        last = np.flatnonzero(np.append(ids[order][1:] != ids[order][:-1], True))
        sums = np.cumsum(rows[order], 0, np.float64)[last]
        sums[1:] -= sums[:-1].copy()
        ids = ids[order][last]
        g["E"][ids[ids >= 0]] = sums[ids >= 0]
        self.apply(g)
        return states[-1].T.copy()

    def apply(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = math.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        rate = self.rate * self.fill * math.sqrt(1 - 0.995**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            m, v, some, kind = self.m[k], self.v[k], self.some[k], x.dtype.type
            m *= kind(0.9)
            m += np.multiply(x, kind(0.1 * scale), out=some)
            x *= x
            v *= kind(0.995)
            v += np.multiply(x, kind(0.005 * scale * scale), out=some)
            np.sqrt(v, out=some)
            some += kind(1e-8)
            np.divide(m, some, out=some)
            some *= kind(rate)
            self.w[k] -= some

    def texts(self, texts: Iterable[np.ndarray]) -> None:
        """Truncated backpropagation over whole texts; a stream that ends takes up the next text with a fresh state."""
        waiting = (t for t in texts if len(t))
        h = self.w["U"].shape[0]
        state = np.zeros((self.streams, h), np.float32)
        now: list[np.ndarray | None] = [None] * self.streams
        at = [0] * self.streams
        last = np.full(self.streams, -1, np.int64)
        while True:
            y = np.zeros((self.streams, UNROLL), np.int64)
            sizes = [0] * self.streams
            for s, text in enumerate(now):
                if text is None:
                    text = now[s] = next(waiting, None)
                    at[s], state[s], last[s] = 0, 0, -1
                    if text is None:
                        continue
                part = text[at[s] : at[s] + UNROLL]
                sizes[s] = size = len(part)
                y[s, :size] = part
                at[s] += UNROLL
                if at[s] >= len(text):
                    now[s] = None
            live = np.arange(UNROLL) < np.array(sizes)[:, None]
            x = np.concatenate([last[:, None], y[:, :-1]], 1)
            x[~live] = -1
            last = y[:, -1].copy()
            on = np.flatnonzero(live[:, 0])
            if not len(on):
                return
            self.fill = live.sum() / live.size
            state[on] = self.window(*(np.ascontiguousarray(a[on].T) for a in (x, y, live)), state[on])


def pack_weights(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unpack_weights(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, pool_bytes: int = POOL_BYTES) -> dict[str, np.ndarray]:
    """Weights after ``rounds`` passes over all rows of ``docs``: every task trains on its documents, Spark averages the results."""
    weights = first_weights(vocabulary)
    tasks = max(1, math.ceil(vocabulary.n / TASK_TOKENS))
    streams = max(8, min(STREAMS, vocabulary.n // (UNROLL * LEAST_STEPS)))
    dealt = docs.select(F.col("text").cast("string").alias("text")).repartition(tasks)
    parts = staged(dealt.withColumn("part", F.monotonically_increasing_id() % PARTS), "lm-train")

    def trainer(start: dict[str, np.ndarray], rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, seen = Trainer(start, vocabulary, rate, streams), 0

            def texts() -> Iterator[np.ndarray]:
                """All texts of the task, the longest of a pool first, so that few streams end late."""
                nonlocal seen
                for pool in pooled(batches, pool_bytes):
                    coded = [vocabulary.encode(tokens(t)) for t in byte_texts(pool.column("text").combine_chunks())]
                    seen += sum(map(len, coded))
                    yield from sorted(coded, key=len, reverse=True)

            mine.texts(texts())
            flat = pack_weights(mine.w)
            blocks = [flat[at : at + _BLOCK] for at in range(0, len(flat), _BLOCK)] if seen else []
            salt = TaskContext.get().partitionId() % salts
            arrays = [pa.array(range(len(blocks)), pa.int32()), pa.array([salt] * len(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary()), pa.array([float(seen)] * len(blocks), pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "salt", "weights", "n"])

        return run

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        each = np.stack([np.frombuffer(b, np.float32) for b in group["weights"]])
        flat = np.average(each, 0, group["n"]).astype(np.float32)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "weights": [flat.tobytes()], "n": [group["n"].sum()]})

    salts = math.isqrt(tasks)  # no group of blocks has more than about that many rows
    averaged = "block int, weights binary, n double"
    for k in range(rounds * PARTS):
        each = map_arrow(parts.where(F.col("part") == k % PARTS).select("text"), trainer(weights, RATE / (1 + k / PARTS)), "block int, salt int, weights binary, n double")
        some = each.groupBy("block", "salt").applyInPandas(mean, averaged)
        found = some.groupBy("block").applyInPandas(mean, averaged).collect()  # the weights once, in blocks
        if found:
            flat = np.concatenate([np.frombuffer(r.weights, np.float32) for r in sorted(found, key=lambda r: r.block)])
            weights = unpack_weights(flat, weights)
    return weights


_SCORED = "task int, place long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<binary>"


def _scorer(vocabulary: Vocabulary, weights: dict[str, np.ndarray], pool_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        places, rare_id = vocabulary.places, vocabulary.rare
        rare_total = math.log10(max(vocabulary.rare_n + 0.5 * (vocabulary.rare_v + 1), 0.5))
        for pool in pooled(batches, pool_bytes):
            texts, rows = [], []
            for doc_id, text in zip(pool.column("doc_id").to_pylist(), byte_texts(pool.column("text").combine_chunks()), strict=True):
                ws = tokens(text)
                place_of = np.fromiter(map(places.get, ws, repeat(-1)), np.int32, len(ws))  # the first places are the ids
                known, outside = place_of >= 0, (place_of < 0) | (place_of >= rare_id)
                coded = np.where(outside, np.int32(rare_id), place_of)
                found = vocabulary.counts[place_of[known]]
                # log10 within the last class of the words the task knows; the others follow from the join.
                inside = np.log10(found[outside[known]] + 0.5).sum() - rare_total * int(outside.sum())
                base = vocabulary.base(found).sum()
                texts.append(coded)
                rows.append((task, place, doc_id, len(ws), int(known.sum()), float(base), float(inside), [ws[k] for k in np.flatnonzero(~known)]))
                place += 1
            scores = score_texts(weights, vocabulary, texts) / LN10
            columns = list(zip(*rows, strict=True))
            columns[6] = (np.array(columns[6]) + scores).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return run


_ARROW = pa.schema(
    [
        ("task", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary())),
    ]
)


def score_documents(docs: DataFrame, training: DataFrame, known: int = KNOWN, rounds: int = ROUNDS, pool_bytes: int = POOL_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    counts = staged(count_words(training), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(known).collect()  # at most `known` words
    vocabulary = Vocabulary([(bytes(r.word), r.c) for r in top], total.n, total.v)
    weights = train(training, vocabulary, rounds, pool_bytes)
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = staged(map_arrow(texts, _scorer(vocabulary, weights, pool_bytes), _SCORED), "lm-scores")
    # Counts of the words no task knows: both sides are spread by word, and none of them is frequent.
    rare = scored.select("task", "place", F.explode("rare").alias("word")).join(counts, "word", "left")
    size = F.coalesce("c", F.lit(0))
    more = rare.groupBy("task", "place").agg(
        F.sum((size > 0).cast("long")).alias("more_known"), F.count("*").alias("more"), F.sum(F.log10(size + 0.5)).alias("logs")
    )
    n, v = total.n, total.v
    none = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(more, ["task", "place"], "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + none("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + none("logs") - none("more") * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        (F.col("score") + none("logs")).alias("score"),
    )
