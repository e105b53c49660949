"""Best-fit packing of token pieces by minimum bin slack.

Tokens: ``word_bpe_49k.json`` without special tokens, then the end id. Pieces of at most ``window`` tokens are
packed into bins of ``window``. One bin is filled by a subset-sum over the lengths that are left, kept as a bitset
of reachable sums; the fullest feasible combination is taken out, and taken again for as long as the counts allow,
which gives the same bins as one search per bin. Only a histogram of at most ``window`` lengths is needed for
that, so the plan has a bounded size whatever the number of documents. Every piece then finds its place by its
rank among the pieces of its length: the rank within its task plus the counts of the tasks before it.

Null texts are empty: one piece with the end id alone. A piece of the full window is a bin. Repeated rows are packed
each. Texts that spell a special token are ordinary text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .common import byte_texts, map_arrow, remembered, ship, sliced, words

WINDOW = 4096
END_ID = 1
CACHED_WORDS = 400_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, in_task long"
_PIECES_IDS = _PIECES + ", ids binary"


class WordIds:
    """Ids of blank-free chunks as little-endian bytes, remembered for up to two generations of CACHED_WORDS chunks.

    Chunks end at ASCII blanks. The tokenizer's normaliser turns blanks into one space and its splitter never crosses
    one, so the ids of a text are those of its chunks in order, and chunks can be encoded together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, chunks: list[bytes]) -> None:
        """Encode chunks as one text and cut its ids where the chunks begin."""
        texts = [c.decode() for c in chunks]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = (4 * np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), starts)).tolist()
        self.young.update(zip(chunks, (ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)), strict=True))

    def of(self, text: bytes) -> bytes:
        chunks = words(text)
        missing = []
        for chunk in set(chunks).difference(self.young):
            ids = self.old.get(chunk)
            if ids is None:
                missing.append(chunk)
            else:
                self.young[chunk] = ids
        if missing:
            self.learn(missing)
        out = b"".join(map(self.young.__getitem__, chunks))
        if len(self.young) >= CACHED_WORDS:
            self.young, self.old = {}, self.young
        return out


def _word_ids(path: str) -> WordIds:
    return remembered(("word ids", path), lambda: WordIds(path))


def _cutter(path: str, window: int, end_id: int, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _word_ids(path), TaskContext.get().partitionId()
        ranks = np.zeros(window + 1, np.int64)
        for batch in chain.from_iterable(map(sliced, batches)):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                ids = encoder.of(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * window)):
                    part = ids[at : at + 4 * window]
                    length = len(part) // 4
                    row = (doc_id, piece, at // 4, length, zlib.crc32(part), task, int(ranks[length]))
                    rows.append((*row, part) if keep_ids else row)
                    ranks[length] += 1
            schema = _ARROW.append(pa.field("ids", pa.binary())) if keep_ids else _ARROW
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("task", pa.int32()), ("in_task", pa.int64()),
    ]
)


def cut_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document; ``in_task`` counts the earlier pieces of the same length in the same task."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(texts, _cutter(path, window, end_id, keep_ids), _PIECES_IDS if keep_ids else _PIECES)


def fullest(counts: dict[int, int], window: int) -> dict[int, int]:
    """The longest length with the combination of the others that leaves the least slack: {length: how many}."""
    order = sorted(counts, reverse=True)
    seed = order[0]
    room = window - seed
    steps: list[tuple[int, int, int]] = []  # (length, how many, sums reachable before)
    sums, goal, mask = 1, 1 << room, (1 << (room + 1)) - 1
    for length in order:
        left = min(counts[length] - (length == seed), room // length if length else 0)
        size = 1
        while left > 0 and not sums & goal:
            many = min(size, left)
            steps.append((length, many, sums))
            sums |= (sums << (length * many)) & mask
            left -= many
            size *= 2
        if sums & goal:
            break
    rest = sums.bit_length() - 1
    out = {seed: 1}
    for length, many, before in reversed(steps):
        if not before >> rest & 1:
            out[length] = out.get(length, 0) + many
            rest -= length * many
    return out


def plan_bins(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, {length: pieces in each}) for a histogram of lengths; every piece is placed."""
    left = {length: n for length, n in counts.items() if n > 0}
    plan = []
    while left:
        use = fullest(left, window)
        times = min(left[length] // n for length, n in use.items())
        plan.append((times, use))
        for length, n in use.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
    return plan


class Places:
    """For each length the ranges of ranks that a pattern takes, to look places up by rank."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        base = 0
        for times, use in plan:
            offset = 0
            for length in sorted(use, reverse=True):
                ranges.setdefault(length, []).append((taken.get(length, 0), use[length], base, offset))
                taken[length] = taken.get(length, 0) + times * use[length]
                offset += length * use[length]
            base += times
        self.bins = base
        self.ranges = {length: np.array(rows, np.int64).T for length, rows in ranges.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for size in np.unique(length):
            mine = np.flatnonzero(length == size)
            start, each, base, first = self.ranges[int(size)]
            row = np.searchsorted(start, rank[mine], side="right") - 1
            nth = rank[mine] - start[row]
            sequence[mine] = base[row] + nth // each[row]
            offset[mine] = first[row] + nth % each[row] * size
        return sequence, offset


def _placer(places: Places) -> Callable:
    def run(frames):
        for frame in frames:
            sequence, offset = places.find(frame["length"].to_numpy(), frame["rank"].to_numpy())
            yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return run


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of cut_pieces; no text is moved, only one short row per piece."""
    pieces = staged(pieces, "pieces")
    tasks = staged(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {row.length: row.n for row in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    ship(pieces.sparkSession)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["task", "length"]).select(
        *(c for c in pieces.columns if c not in ("task", "in_task")), (F.col("before") + F.col("in_task")).alias("rank")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInPandas(_placer(Places(plan_bins(counts, window))), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; with ``keep_ids`` every piece carries its ids as little-endian bytes."""
    return pack(cut_pieces(docs, path, window, end_id, keep_ids), window)
