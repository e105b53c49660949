"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built. A text is parsed against it: each phrase is the longest
piece from the present place that occurs in the labelled text, an unknown character is a phrase of its own. The
number of phrases, times the logarithm of the labelled text's length over the text's length, estimates the cross
entropy; the language with the least wins. The score is the runner-up's share of the two least entropies, so from
0.5 (no difference) towards 1.

Labelled text is a hash-chosen sample of ``CHARS`` characters of the distinct lines of each language, all of them if they are
shorter, and less where there are so many languages that all automata together would have more than ``STATES`` states; it is all a task is sent, and each
Python worker builds the automata once. All whole texts are parsed, many side by side, one character a step.

The steps of the ``DENSE_LETTERS`` most frequent letters lie in a table; scripts with more letters have theirs in a sorted list beside
it, so every letter of the labelled text tells languages apart.

Before parsing letters are lower-cased and runs of anything else become one blank. Texts that are null or have no
letter are ``und`` with score 0. Equal entropies: the first language in order of name. With no labelled text
everything is ``und``. A null lang labels nothing. Repeated rows are judged each by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .common import map_arrow, pooled

CHARS = 40_000
STATES = 400_000
DENSE_LETTERS = 96  # with a column of the table each; the steps of all others are searched for
_CANDIDATES = 4
POOL_BYTES = 24 << 20
_STEPS = 256
_LETTER = re.compile(r"[^\W\d_]")
_BREAK = np.uint32(1 << 31)
_POINTS = 0x110000


def _codes(text: str, classes: np.ndarray) -> np.ndarray:
    """Letter classes of a text; 0 is a blank, of which no two follow each other."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = classes[np.minimum(points, len(classes) - 1)]
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    return codes[keep] if len(codes) else codes


def letter_classes(texts: list[str]) -> tuple[np.ndarray, int, int]:
    """(class of each code point, common letters, rarer letters).

    Classes are 0 blank, 1 a letter that no text has, then the ``DENSE_LETTERS`` most frequent letters, one class that stands for
    nothing, and all others.
    """
    points = np.frombuffer("".join(texts).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    values, counts = np.unique(points, return_counts=True)
    letters = [int(v) for _, v in sorted(zip(-counts, values, strict=True)) if chr(v).isalpha()]
    common = min(len(letters), DENSE_LETTERS)
    classes = np.fromiter((chr(p).isalpha() for p in range(_POINTS)), np.min_scalar_type(len(letters) + 3), _POINTS)
    for k, v in enumerate(letters):
        classes[v] = k + 2 + (k >= common)
    return classes, common, len(letters) - common


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Parser:
    """The automata of all languages in one table: the next state for (state, class), with a mark where a phrase begins."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        self.classes, common, self.rare = letter_classes([text for _, text in samples])
        self.pad = common + 2  # a class that changes nothing
        self.width = self.pad + 1
        tables, offset, roots, lengths = [], 0, [], []
        rare_roots, rare_steps = [], {}
        for _, text in samples:
            codes = _codes(text, self.classes).tolist()
            states = suffix_automaton(codes)
            root = np.full(self.width + self.rare, offset, np.uint32)  # an unknown character leads back to the root
            for c, to in states[0].items():
                root[c] = offset + to * self.width
            table = np.tile(root[: self.width] | _BREAK, (len(states), 1))
            for state, steps in enumerate(states):
                if state:
                    for c, to in steps.items():
                        if c < self.width:
                            table[state, c] = offset + to * self.width
                        else:
                            rare_steps[(offset // self.width + state) * self.rare + c - self.width] = offset + to * self.width
            table[:, self.pad] = offset + np.arange(len(states)) * self.width
            tables.append(table.ravel())
            roots.append(offset)
            rare_roots.append(root[self.width :] | _BREAK)
            lengths.append(max(len(codes), 2))
            offset += table.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.uint32)
        self.roots = np.array(roots, np.uint32)
        self.bits = np.log2(np.array(lengths, float))
        self.rare_roots = np.array(rare_roots, np.uint32)
        self.rare_keys = np.array(sorted(rare_steps), np.int64)
        self.rare_next = np.array([rare_steps[k] for k in self.rare_keys.tolist()], np.uint32)

    def _step(self, now: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states, one row per language, where some letters are not among the common ones."""
        rare = codes >= self.width
        out = self.table[now + np.where(rare, np.uint32(1), codes)]
        letters = codes[rare].astype(np.int64) - self.width
        start = self.rare_roots[:, letters]
        if len(self.rare_keys):
            keys = (now[:, rare] // self.width).astype(np.int64) * self.rare + letters
            at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
            start = np.where(self.rare_keys[at] == keys, self.rare_next[at], start)
        out[:, rare] = start
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases, one row per text and one column per language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        if not len(texts) or not sizes.max():
            return out.T
        flat = np.concatenate([texts[k] for k in order])
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        state = np.repeat(self.roots[:, None], len(texts), 1)
        for at in range(0, int(sizes.max()), _STEPS):
            live = int(np.searchsorted(-sizes[order], -at, side="left"))
            index = starts[:live] + at + np.arange(_STEPS)[:, None]
            block = np.where(index < ends[:live], flat[np.minimum(index, len(flat) - 1)], flat.dtype.type(self.pad)).astype(np.uint32)
            rare = self.rare and block.max(axis=1, initial=0) >= self.width
            now = np.ascontiguousarray(state[:, :live])
            seen = np.zeros(now.shape, np.uint32)
            for k, codes in enumerate(block[: int(min(_STEPS, sizes.max() - at))]):
                now = self._step(now, codes) if self.rare and rare[k] else self.table[now + codes]
                seen += now >> np.uint32(31)
                now &= ~_BREAK
            state[:, :live] = now
            out[:, order[:live]] += seen
        return out.T

    def entropies(self, texts: list[str]) -> np.ndarray:
        codes = [_codes(t, self.classes) for t in texts]
        sizes = np.maximum([len(c) for c in codes], 1)
        return self.phrases(codes) * self.bits / sizes[:, None]


def brute_phrases(text: list[int], sample: list[int]) -> int:
    """Phrases of a text against a sample by searching for each longest match; for tests."""
    text, count, at = list(text), 0, 0
    pieces = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, len(sample) + 1)}
    while at < len(text):
        size = 0
        while at + size < len(text) and tuple(text[at : at + size + 1]) in pieces:
            size += 1
        at += max(size, 1)
        count += 1
    return count


@lru_cache(maxsize=1)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def labelled_samples(labelled: DataFrame, chars: int = CHARS) -> tuple[tuple[str, str], ...]:
    """(lang, text) pairs: hash-chosen distinct lines of rows (text, lang), ``chars`` characters of each language or all it has."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    langs = rows.where(F.col("text").rlike(r"\p{L}")).select("lang").distinct().count()
    if not langs:
        return ()
    each = min(chars, STATES // (2 * langs))
    lines = rows.select("lang", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"\p{L}"))
    # A line longer than a tenth of the sample is taken in pieces, so that no single one fills it.
    piece = max(each // 10, 1)
    pieces = lines.select("lang", F.explode(F.expr(f"transform(sequence(0, (length(line) - 1) div {piece}), i -> substring(line, i * {piece} + 1, {piece}))")).alias("line"))
    pieces = pieces.withColumns({"hash": F.xxhash64("line", F.lit(3)), "size": F.length("line") + 1})
    once = pieces.groupBy("lang", "hash").agg(F.max("size").alias("size"))
    totals = staged(once.groupBy("lang").agg(F.sum("size").alias("total")), "language-totals")
    # Candidates of several times the size, a bounded number; the first of them by hash fill the sample.
    chance = F.pmod("hash", F.lit(1 << 40)) / float(1 << 40)
    some = pieces.join(totals, "lang").where(chance * F.col("total") < _CANDIDATES * each).select("lang", "hash", "size", "line").distinct()
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy(chance, "line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = some.withColumn("before", before).where(F.col("before") < each)
    picked = picked.select("lang", F.col("line").substr(F.lit(1), F.lit(each) - F.col("before").cast("int")).alias("line"))
    found = picked.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("line")), " ").alias("text"))
    return tuple((r.lang, r.text) for r in found.orderBy("lang").collect())


def _identifier(samples: tuple[tuple[str, str], ...], pool_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for pool in pooled(batches, pool_bytes):
            texts = pool.column("text").to_pylist()
            rows = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if samples else []
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if rows:
                values = parser.entropies([texts[k] for k in rows])
                best = np.argmin(values, axis=1)
                least = np.partition(values, min(1, values.shape[1] - 1), axis=1)
                second = least[:, 1] if values.shape[1] > 1 else 2 * least[:, 0] + 1
                share = np.where(second > 0, second / np.maximum(second + least[:, 0], 1e-12), 0.5)
                for k, b, s in zip(rows, best, share, strict=True):
                    lang[k], score[k] = parser.langs[b], float(s)
            arrays = [pool.column("doc_id").combine_chunks(), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, labelled: DataFrame, chars: int = CHARS, pool_bytes: int = POOL_BYTES) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``, learnt from the text and lang of ``labelled``."""
    samples = labelled_samples(labelled, chars)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, _identifier(samples, pool_bytes), "doc_id long, lang_pred string, score double")
