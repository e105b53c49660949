"""Benchmark decontamination with training suffix arrays.

Each task sorts the word positions of its documents into suffix arrays, one for every shard of about a million
words, and looks up every suffix of the benchmark items by binary search. A suffix that agrees with the array
over a whole window gives the range of all its occurrences; windows that follow one another on the same
diagonal are one longest verbatim match. A position enters the array only if as many benchmark words follow it
as the shortest window has, since no other position can match.

The benchmark is the stated query set. It is cut into blocks of at most ``block_words`` words, which bounds
what a task is sent; the blocks are passed one after another over the same rows, without a shuffle.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after folding A-Z. Null or wordless documents have no
hit; null or wordless items have no window; items with the same text each count; repeated documents are judged
each by itself; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, byte_texts, forget, map_arrow

WINDOW = 10
BLOCK_WORDS = 1_000_000
SHARD_WORDS = 1_000_000

_BLANKED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_WORDS = bytes(_BLANKED[c] for c in FOLD)
_FOUND = "doc_id long, text string, n_words long, hits array<long>, items array<string>, longest long, match_item string, match_at long"


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Queries:
    """The windows of a block of items: word ids (from 1), one row per distinct window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, (_, ws) in enumerate(items):
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in ws]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                places.setdefault(tuple(ids[at : at + size]), []).append((item, at))
        self.names = [name for name, _ in items]
        self.places = list(places.values())
        self.sizes = np.array([len(w) for w in places], np.int64)
        self.shortest = int(self.sizes.min()) if len(places) else 0
        self.words = np.zeros((len(places), window), np.int32)
        for row, w in enumerate(places):
            self.words[row, : len(w)] = w
        self.first = np.array([p[0] for p in self.places], np.int64).reshape(-1, 2)


def suffix_array(ids: np.ndarray, shortest: int, depth: int) -> np.ndarray:
    """Positions whose next ``shortest`` ids are all above 0, ordered by their next ``depth`` ids."""
    reach = np.zeros(len(ids) + 1, np.int64)  # how many ids above 0 follow
    zeros = np.flatnonzero(np.append(ids, 0) == 0)
    reach[: len(ids)] = zeros[np.searchsorted(zeros, np.arange(len(ids)))] - np.arange(len(ids))
    at = np.flatnonzero(reach[:-1] >= shortest)
    if not len(at):
        return at
    padded = np.append(ids, np.zeros(depth, ids.dtype)).astype(np.int64)
    bits = max(1, int(padded.max()).bit_length())
    per_key = max(1, 63 // bits)
    keys = []
    for start in range(0, depth, per_key):
        key = np.zeros(len(at), np.int64)
        for k in range(start, min(depth, start + per_key)):
            key = (key << bits) | padded[at + k]
        keys.append(key)
    return at[np.lexsort(keys[::-1])] if len(keys) > 1 else at[np.argsort(keys[0], kind="stable")]


def search(ids: np.ndarray, order: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """For every window the range [low, high) of its occurrences in the suffix array, by binary search."""
    padded = np.append(ids, np.zeros(queries.words.shape[1], ids.dtype))

    def bound(upper: bool) -> np.ndarray:
        low = np.zeros(len(queries.sizes), np.int64)
        high = np.full(len(queries.sizes), len(order), np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            at = order[mid]
            sign = np.zeros(len(open_), np.int8)  # of suffix against window
            for k in range(queries.words.shape[1]):
                live = np.flatnonzero((sign == 0) & (queries.sizes[open_] > k))
                if not len(live):
                    break
                mine, theirs = padded[at[live] + k], queries.words[open_[live], k]
                sign[live] = np.sign(mine - theirs)
            right = (sign <= 0) if upper else (sign < 0)
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
            open_ = open_[low[open_] < high[open_]]
        return low

    return bound(False), bound(True)


def find(ids: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(positions, window numbers) of all occurrences, by position."""
    if not len(queries.sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_array(ids, queries.shortest, queries.words.shape[1])
    low, high = search(ids, order, queries)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    start = np.repeat(low - np.cumsum(count) + count, count)
    at = order[start + np.arange(len(which))] if len(which) else np.zeros(0, np.int64)
    by = np.lexsort((which, at))
    return at[by], which[by]


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _matches(at: np.ndarray, which: np.ndarray, queries: Queries) -> tuple[int, str | None, int | None]:
    """Longest run of windows on one diagonal of one item: (words, item, position)."""
    item, place = queries.first[which].T
    by = np.lexsort((at, at - place, item))
    at, item, place, size = at[by], item[by], place[by], queries.sizes[which[by]]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(at) != 1) | (np.diff(place) != 1)
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    length = np.bincount(run) - 1 + size[starts]
    best = int(np.lexsort((at[starts], -length))[0])
    return int(length[best]), queries.names[item[starts[best]]], int(at[starts[best]])


def _searcher(queries: Queries, shard_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shard(rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
        starts = np.cumsum([0, *(len(x) + 1 for x in ids)])
        gap = np.zeros(1, np.int32)
        at, which = find(np.concatenate([y for x in ids for y in (x, gap)]), queries)
        owner = np.searchsorted(starts, at, side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[k], cuts[k + 1])
            doc_id, text, n_words, hits, items, longest, match_item, match_at = rows[k]
            here, seen = at[part] - starts[k], which[part]
            old = list(zip(hits[::2], hits[1::2], strict=True))
            new = zip(here.tolist(), (here + queries.sizes[seen]).tolist(), strict=True)
            names = {queries.names[item] for w in set(seen.tolist()) for item, _ in queries.places[w]}
            match = _matches(here, seen, queries)
            if match[0] > longest:
                longest, match_item, match_at = match
            rows[k] = (doc_id, text, n_words, _merged([*old, *new]), sorted({*items, *names}), longest, match_item, match_at)
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows: list[tuple] = []
        ids: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            kept = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for row, text in zip(kept, texts, strict=True):
                ws = item_words(text)
                ids.append(np.fromiter(map(queries.ids.get, ws, repeat(0)), np.int32, len(ws)))
                rows.append((*row[:2], len(ws), *row[3:]))
                size += len(ws) + 1
                if size >= shard_words:
                    yield shard(rows, ids)
                    rows, ids, size = [], [], 0
        if rows:
            yield shard(rows, ids)

    return run


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())),
        ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("match_item", pa.string()), ("match_at", pa.int64()),
    ]
)


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most ``block_words`` words; an item with more is a block of its own."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator()
    for name, text in rows:
        ws = item_words((text or "").encode())
        if not ws:
            continue
        if block and size + len(ws) > block_words:
            yield block
            block, size = [], 0
        block.append((name or "", ws))
        size += len(ws)
    if block:
        yield block


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Per document: ``n_words``, ``hits`` (merged word ranges as start, end, start, ...), ``items`` (ids of items with
    an occurring window), ``longest`` (words of the longest verbatim match), ``match_item``, ``match_at`` and the text.
    """
    empty = "CAST(array() AS array<{}>)"
    out = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(0).cast("long").alias("n_words"),
        F.expr(empty.format("long")).alias("hits"), F.expr(empty.format("string")).alias("items"),
        F.lit(0).cast("long").alias("longest"), F.lit(None).cast("string").alias("match_item"),
        F.lit(None).cast("long").alias("match_at"),
    )
    for block in [*blocks(benchmark, block_words)] or [[]]:
        out = map_arrow(out, _searcher(Queries(block, window), shard_words), _FOUND)
    return out


def leak_report(found: DataFrame) -> DataFrame:
    """One row per document with hit counts and the digest of the items found."""
    n_hit = F.expr("aggregate(transform(hits, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest", "match_item", "match_at",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with all their columns; of rows that share an id, all go if one is hit."""
    leaked = find_leaks(docs, benchmark, **options).where(F.size("hits") > 0).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"].cast("long").eqNullSafe(leaked["_leaked"]), "left_anti")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same report by comparing every window with every position; for tests."""
    listed = [(str(name), item_words((text or "").encode())) for name, text in items]
    out = []
    for doc_id, text in docs:
        ws = item_words((text or "").encode())
        hit: set[int] = set()
        names = set()
        for name, item in listed:
            size = min(window, len(item))
            wanted = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if size else set()
            for at in range(len(ws) - size + 1):
                if tuple(ws[at : at + size]) in wanted:
                    hit.update(range(at, at + size))
                    names.add(name)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(names), digest, bool(hit)))
    return out


SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM item WHERE len(w) > 0)
), place AS (
  SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
), found AS (
  SELECT p.r, p.k, p.size, win.item_id FROM place p JOIN win ON win.g = p.g AND win.size = p.size
), hit AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS pos FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
