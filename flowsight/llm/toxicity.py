"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Tokens are labelled from labelled documents: a token of a toxic document is toxic if its word, or its first letters, are
found in far more toxic than clean documents (``LIFT`` times the share, ``LEAST`` documents). The field has two labels,
hashed features of the word (whole, beginnings, end) and a matrix of transitions; it is fitted by gradient steps on
the difference of observed and expected features, the latter from forward-backward. A document's score is a
logistic function of the expected number of toxic tokens and the largest marginal, fitted on the document labels;
offending offsets are the runs of tokens with a marginal of at least ``SPAN_AT``.

It learns from a hash-chosen sample of at most about ``TOXIC`` toxic and ``CLEAN`` clean documents; their ids are few
enough to be sent to every task, so the texts of the others are not moved. The sample gives the token labels and the
document score. The field is fitted on about ``FIT_BYTES`` of its text, cut into chains of ``CHAIN`` tokens and chosen by
chain, so that neither long nor repeated documents change the bound; every step is one pass in which tasks add up gradients.

Null and empty texts have no token and get the score of a document with nothing toxic in it. Words are kept whole
however long. Without a label of either kind every score is the share of toxic labels, 0 without any. A document labelled
twice counts twice; null labels and labels of unknown documents don't count. Repeated rows are scored each by itself.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .common import byte_texts, map_arrow, pooled, words

TOXIC, CLEAN = 6_000, 12_000
BITS = 18
LIFT, LEAST = 12.0, 3
STEPS, RATE, PENALTY = 60, 0.5, 1e-4
CHAIN = 200  # tokens of the chains that a training text is cut into
SPAN_AT = 0.5
FIT_BYTES = 8 << 20  # of the sample's text, in expectation, that the field is fitted on; all of it gives the token labels
FIT_TASKS = 4
POOL_BYTES = 6 << 20
CACHED_BYTES = 2 << 20  # of words whose potentials a task keeps from one pool to the next
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(word: bytes) -> list[str]:
    """Features of a word: itself in lower case without marks around it, its beginnings and its end."""
    plain = word.decode("utf-8", "replace").strip(_MARKS).lower()
    return [f"w={plain}", f"4={plain[:4]}", f"5={plain[:5]}", f"6={plain[:6]}", f"e={plain[-4:]}"]


def lexical(word: bytes) -> list[str]:
    """The features that labels of tokens are drawn from."""
    found = features(word)
    return [found[0], *(f for f in found[2:4] if len(f) >= 7)]


_MASK = (1 << BITS) - 1
_W, _4, _5, _6, _E = (zlib.crc32(mark) for mark in (b"w=", b"4=", b"5=", b"6=", b"e="))


def bins(word: bytes) -> tuple[int, int, int, int, int]:
    """Hashed ``features`` of a word: the checksum of each, its mark taken in before."""
    plain = word.decode("utf-8", "replace").strip(_MARKS).lower()
    crc = zlib.crc32
    return (
        crc(plain.encode(), _W) & _MASK, crc(plain[:4].encode(), _4) & _MASK, crc(plain[:5].encode(), _5) & _MASK,
        crc(plain[:6].encode(), _6) & _MASK, crc(plain[-4:].encode(), _E) & _MASK,
    )


class Chains:
    """Several sequences side by side, packed by time: all first tokens, all second ones, and so on."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        sorted_ = sizes[self.order]
        steps = int(sorted_[0]) if len(sorted_) else 0
        self.live = np.searchsorted(-sorted_, -np.arange(steps), side="left")
        self.at = np.cumsum([0, *self.live])
        lane = np.repeat(np.arange(len(sizes)), sorted_)
        time = np.arange(len(lane)) - np.repeat(np.cumsum(sorted_) - sorted_, sorted_)
        starts = np.cumsum(sizes) - sizes
        self.place = np.zeros(len(lane), np.int64)  # of every token of the texts in their own order
        self.place[np.repeat(starts[self.order], sorted_) + time] = self.at[time] + lane

    def marginals(self, odds: np.ndarray, step: np.ndarray, first: float, transitions: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of label 1 of every packed token, expected transitions if wanted) for exp potentials: ``odds`` of the
        tokens, ``step[i, j]`` from label i to j, ``first`` of label 1 at the start."""
        forward, back = np.zeros(len(odds)), np.ones(len(odds))
        for t, n in enumerate(self.live):
            now = slice(self.at[t], self.at[t] + n)
            if t:
                p = forward[self.at[t - 1] : self.at[t - 1] + n]
                one, zero = p * step[1, 1] + (1 - p) * step[0, 1], p * step[1, 0] + (1 - p) * step[0, 0]
            else:
                one, zero = np.full(n, first), np.ones(n)
            one = one * odds[now]
            forward[now] = one / (one + zero)
        for t in range(len(self.live) - 2, -1, -1):
            n = self.live[t + 1]
            r = odds[self.at[t + 1] : self.at[t + 1] + n] * back[self.at[t + 1] : self.at[t + 1] + n]
            back[self.at[t] : self.at[t] + n] = (step[1, 0] + step[1, 1] * r) / (step[0, 0] + step[0, 1] * r)
        joint = forward * back
        marginal = joint / (joint + 1 - forward)
        pairs = np.zeros((2, 2))
        for t in range(1, len(self.live) if transitions else 0):
            n = self.live[t]
            p = forward[self.at[t - 1] : self.at[t - 1] + n]
            r = odds[self.at[t] : self.at[t] + n] * back[self.at[t] : self.at[t] + n]
            each = [(1 - p) * step[0, 0], (1 - p) * step[0, 1] * r, p * step[1, 0], p * step[1, 1] * r]
            total = sum(each)
            pairs += np.array([(x / total).sum() for x in each]).reshape(2, 2)
        return marginal, pairs


class Field:
    """Weights of the field and of the document score."""

    def __init__(self, prior: float = 0.0):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.step = np.ones((2, 2))  # exp potentials
        self.first = 1.0
        self.score_weights: np.ndarray | None = None
        self.prior = prior
        self.cache: dict[bytes, float] = {}
        self.cached = 0

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cache": {}, "cached": 0}

    def odds(self, texts: list[list[bytes]]) -> Iterator[float]:
        """Exp potentials of all tokens in order; each distinct word is worked out once a pool, most once a task."""
        distinct = set().union(*texts)
        size = sum(map(len, distinct))
        if self.cached + size > CACHED_BYTES:
            self.cache.clear()
            self.cached = 0
        weights = self.weights.tolist()
        for word in distinct - self.cache.keys():
            a, b, c, d, e = bins(word)
            self.cache[word] = math.exp(min(max(weights[a] + weights[b] + weights[c] + weights[d] + weights[e], -30.0), 30.0))
            self.cached += len(word)
        return map(self.cache.__getitem__, chain.from_iterable(texts))

    def tag(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Marginals of every text's tokens, and its (log of expected toxic tokens, largest marginal)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return [np.zeros(0) for _ in texts], np.zeros((len(texts), 2))
        flat = np.fromiter(self.odds(texts), float, int(sizes.sum()))
        chains = Chains(sizes)
        packed = np.empty(len(flat))
        packed[chains.place] = flat
        marginal = chains.marginals(packed, self.step, self.first, transitions=False)[0][chains.place]
        each = np.split(marginal, np.cumsum(sizes)[:-1])
        return each, np.array([(np.log1p(m.sum()), m.max()) if len(m) else (0.0, 0.0) for m in each])

    def score(self, found: np.ndarray) -> np.ndarray:
        if self.score_weights is None:
            return np.full(len(found), self.prior)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(found)), found]) @ self.score_weights, -40, 40)))


_CHAINS = "bins binary, label binary, tokens int, ones long, begun long, s00 long, s01 long, s10 long, s11 long"


def _chain_rows(lexicon: set[str], share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chains of at most ``CHAIN`` tokens of labelled texts (doc_id, text, toxic), a hashed ``share`` of them, with what is observed in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pool in pooled(batches, POOL_BYTES):
            rows: list[tuple] = []
            texts = byte_texts(pool.column("text").combine_chunks())
            for doc_id, toxic, text in zip(pool.column("doc_id").to_pylist(), pool.column("toxic").to_pylist(), texts, strict=True):
                ws = words(text)
                for at in range(0, len(ws), CHAIN):
                    if zlib.crc32(b"%d:%d" % (doc_id, at)) >= share * (1 << 32):
                        continue
                    part = ws[at : at + CHAIN]
                    hashed = np.array([bins(w) for w in part], "<i4")
                    label = np.array([toxic and any(f in lexicon for f in lexical(w)) for w in part], np.uint8)
                    pairs = np.bincount(2 * label[:-1] + label[1:], minlength=4).tolist()
                    rows.append((hashed.tobytes(), label.tobytes(), len(part), int(label.sum()), int(label[0]), *pairs))
            if rows:
                names = [c.split()[0] for c in _CHAINS.split(", ")]
                types = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _gradients(weights: np.ndarray, step: np.ndarray, first: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per task: observed less expected features of its chains, their expected transitions and starts."""
    used = np.flatnonzero(weights).astype(np.int32)
    values = weights[used].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, missing = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS)
        dense[used] = values
        pairs, begun = np.zeros((2, 2)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            chains = Chains(batch.column("tokens").to_numpy().astype(np.int64))
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8)
            hashed = np.frombuffer(b"".join(batch.column("bins").to_pylist()), "<i4").reshape(len(label), -1)
            packed = np.empty(len(label))
            packed[chains.place] = np.exp(np.clip(dense[hashed].sum(1), -30, 30))
            marginal, expected = chains.marginals(packed, step, first)
            missing += np.bincount(hashed.ravel(), np.repeat(label - marginal[chains.place], hashed.shape[1]), minlength=1 << BITS)
            pairs += expected
            begun += float(marginal[: chains.live[0]].sum())
        at = np.flatnonzero(missing).astype("<i4")
        arrays = [at.tobytes(), missing[at].astype("<f4").tobytes(), pairs.astype("<f8").tobytes()]
        yield pa.RecordBatch.from_arrays([*(pa.array([a], pa.binary()) for a in arrays), pa.array([begun], pa.float64())], ["at", "missing", "pairs", "begun"])

    return run


def fit_field(chains: DataFrame, prior: float) -> Field:
    """The field from labelled chains, by gradient steps whose sums Spark's tasks add up; ``prior`` is the share of toxic labels."""
    field = Field(prior)
    o = chains.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "ones", "begun", "s00", "s01", "s10", "s11"))).first()
    if not o.tokens:
        return field
    seen = np.array([[o.s00, o.s01], [o.s10, o.s11]], float)
    rate_of_one = max(o.ones / o.tokens, 1e-6)
    weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    log_step, log_first = np.zeros((2, 2)), float(np.log(rate_of_one))
    log_step[:, 1] = log_first
    step_squares, first_squares = np.full((2, 2), 1e-8), 1e-8
    for _ in range(STEPS):
        g, gs, gf = -PENALTY * o.tokens * rate_of_one * weights, seen.copy(), float(o.begun)
        sums = map_arrow(chains.select("bins", "label", "tokens"), _gradients(weights, np.exp(log_step), float(np.exp(log_first))), "at binary, missing binary, pairs binary, begun double")
        for r in sums.collect():  # a row per task, about FIT_TASKS of them
            g[np.frombuffer(r.at, "<i4")] += np.frombuffer(r.missing, "<f4")
            gs -= np.frombuffer(r.pairs, "<f8").reshape(2, 2)
            gf -= r.begun
        squares += g * g
        weights += RATE * g / np.sqrt(squares)
        step_squares += gs * gs
        log_step += RATE * gs / np.sqrt(step_squares)
        first_squares += gf * gf
        log_first += RATE * gf / np.sqrt(first_squares)
    field.weights, field.step, field.first = weights.astype(np.float32), np.exp(log_step), float(np.exp(log_first))
    return field


def fit_score(found: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    """Weights of the logistic document score over what ``Field.tag`` says of labelled documents."""
    x, y = np.column_stack([np.ones(len(found)), found]), toxic.astype(float)
    # The sample holds more toxic documents than the labels do.
    share = max(y.mean(), 1e-9)
    weight = np.where(y == 1, prior / share, (1 - prior) / max(1 - share, 1e-9))
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        beta += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-2 * beta)
    return beta


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, fit_bytes: int = FIT_BYTES) -> Field:
    """A field from the documents that ``labels`` (doc_id, toxic) knows."""
    given = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = n.get(1, 0) / max(sum(n.values()), 1)
    if len(n) < 2:
        return Field(prior)
    share = F.when(F.col("toxic") == 1, toxic / n[1]).otherwise(clean / n[0])
    ids = staged(given.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_003)) < share * 1_000_003), "toxic-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = staged(texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic"), "toxic-sample")  # toxic + clean ids, bounded

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, bad in zip(byte_texts(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                found = sorted({f for w in set(words(text)) for f in lexical(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([bad] * len(found), pa.int64())], ["feature", "toxic"])

    counted = map_arrow(sample.select("text", "toxic"), seen, "feature string, toxic long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    totals = {r.toxic: r for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).collect()}
    if len(totals) < 2:
        return Field(prior)
    strong = counted.where((F.col("a") >= LEAST) & (F.col("a") * float(totals[0].n) >= LIFT * (F.col("b") + 0.5) * float(totals[1].n)))
    lexicon = {r.feature for r in strong.select("feature").collect()}  # of a bounded sample
    part = min(1.0, fit_bytes / max(totals[0].bytes + totals[1].bytes, 1))
    chains = staged(map_arrow(sample, _chain_rows(lexicon, part), _CHAINS).repartition(FIT_TASKS), "toxic-chains")
    field = fit_field(chains, prior)
    tagged = map_arrow(sample, _found(field), "expected double, largest double, toxic int").collect()  # of a bounded sample
    field.score_weights = fit_score(np.array([(r.expected, r.largest) for r in tagged]), np.array([r.toxic for r in tagged]), prior)
    return field


def _found(field: Field) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pool in pooled(batches, POOL_BYTES):
            _, found = field.tag([words(t) for t in byte_texts(pool.column("text").combine_chunks())])
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pool.column("toxic").combine_chunks()], ["expected", "largest", "toxic"])

    return run


_OUT = "doc_id long, score double, expected double, spans array<struct<start: long, stop: long>>"


def _tagger(field: Field, pool_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pool in pooled(batches, pool_bytes):
            texts = byte_texts(pool.column("text").combine_chunks())
            split = [words(t) for t in texts]
            marginals, found = field.tag(split)
            spans = [_spans(t, ws, m) for t, ws, m in zip(texts, split, marginals, strict=True)]
            arrays = [
                pool.column("doc_id").combine_chunks(), pa.array(field.score(found), pa.float64()),
                pa.array(np.expm1(found[:, 0]), pa.float64()), pa.array(spans, _SPANS),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "expected", "spans"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _spans(text: bytes, ws: list[bytes], marginal: np.ndarray) -> list[dict[str, int]]:
    """Code points of the runs of toxic tokens."""
    hot = np.flatnonzero(marginal >= SPAN_AT)
    if not len(hot):
        return []
    out: list[dict[str, int]] = []
    marked, at, point = set(hot.tolist()), 0, 0
    last = -2
    for k, w in enumerate(ws[: int(hot[-1]) + 1]):
        start = text.index(w, at)
        point += len(text[at:start].decode())
        end = point + len(w.decode())
        if k in marked:
            if last == k - 1:
                out[-1]["stop"] = end
            else:
                out.append({"start": point, "stop": end})
            last = k
        at, point = start + len(w), end
    return out


def score(docs: DataFrame, field: Field, pool_bytes: int = POOL_BYTES) -> DataFrame:
    """doc_id, score, expected number of toxic tokens and offending ``spans`` of every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, _tagger(field, pool_bytes), _OUT)
