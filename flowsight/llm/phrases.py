"""Phrase collocations of two to four words, counted by multikey three-way quicksort of suffix pointers.

Texts are cut at marks and line ends into pieces and these into words. Every word starts a suffix, of which the first
DEPTH words within its piece matter: its window. The windows of a pool of documents are counted there, sorted, and sent to
the route that holds their leading words: routes are ranges of (language, window), cut at quantiles of a sample, so that
each has about ROUTE_BYTES of text and a leading word however frequent is spread over as many routes as it fills. In
a route the pointers to its windows are sorted by the first word into smaller, equal and larger ones, equal ones then by the
next word, to the maximum depth. The size of an equal partition is the count of a phrase, and partitions with fewer
occurrences than a candidate needs are abandoned unsorted. Only phrases that lead a range bound can lie in two routes, six
at most for a route; their parts are counted apart and summed afterwards. The sample decides the cost, not the result.

What is left are the frequent phrases, a table that Spark joins with itself for the parts of every cut and for longer
phrases. Scores are exact decimals.

Null and empty texts have no words; a null language is ``und``. A very long text is cut into windows like any other and its
windows are sent in rows of at most ROW_WINDOWS. Repeated rows, repeated or null ids: every row counts. An empty table gives
an empty table. Columns other than text and language are not read, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import row_ids
from ..sources.scratch import staged
from .common import FOLD, byte_texts, map_arrow
from .pieces import by_bytes

DEPTH = 4
LEAST_COUNT = 30
TOP = 2000
COVERED = 80  # a candidate goes if a longer one has this many percent of its occurrences
SCALE = 2_000_000

POOL_BYTES = 2 << 20
ROUTE_BYTES = 4 << 20
ROW_WINDOWS = 200_000
BOUND_SAMPLES = 128  # sampled windows a route
THIN = 128  # of a sampled document's windows one in so many

MARKS = b".,;:!?\n\v\f\r"
_TO_LINES = FOLD.translate(bytes.maketrans(MARKS, b"\n" * len(MARKS)))
Bound = tuple[bytes, bytes]


def document_windows(text: bytes) -> Iterator[bytes]:
    """For every word: it and the next ones of its piece, DEPTH in all, joined by tabs; missing ones are empty."""
    flat: list[bytes] = []
    gap = [b""] * (DEPTH - 1)
    for piece in text.translate(_TO_LINES).split(b"\n"):
        found = piece.split()
        if found:
            flat += found
            flat += gap
    shifted = [islice(flat, i, None) for i in range(DEPTH)]
    return (w for w in map(b"\t".join, zip(*shifted)) if w[0] != 9)


def _languages(rows: pa.RecordBatch) -> dict[bytes, list[bytes]]:
    """Texts of each language."""
    found: dict[bytes, list[bytes]] = {}
    for lang, text in zip(byte_texts(rows.column("lang")), byte_texts(rows.column("text"))):
        found.setdefault(lang, []).append(text)
    return found


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in by_bytes(batches, POOL_BYTES):
        pairs = [
            (lang, window)
            for lang, texts in _languages(rows).items()
            for text in texts
            for window in islice(document_windows(text), crc32(text) % THIN, None, THIN)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(pa.string()) for c in zip(*pairs)] if pairs else
                                         [pa.array([], pa.string())] * 2, names=["lang", "window"])


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text"))


def route_bounds(docs: DataFrame, route_bytes: int = ROUTE_BYTES) -> list[Bound]:
    """Where the routes are cut: one fewer than there are routes, in order."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routes = max(partitions, -(-total // route_bytes))
    share = min(1.0, 6.0 * BOUND_SAMPLES * THIN * routes / max(1, total))  # a word takes about six bytes
    draw = F.pmod(F.xxhash64("text", *[c for c in docs.columns if c == "doc_id"]), F.lit(1 << 30))
    sample = map_arrow(_inputs(docs.where(draw < int(share * (1 << 30)))), _sampled, "lang string, window string")
    sample = staged(sample, "phrase-sample")
    step = max(1, sample.count() // routes)
    cuts = row_ids(sample, ["lang", "window"]).where(F.col("row_id") % step == step - 1).select("lang", "window")
    return sorted({(r["lang"].encode(), r["window"].encode()) for r in cuts.toLocalIterator()})


def _route(bounds: list[Bound]):
    """Function from documents to (route, lang, windows, counts): windows joined by line ends, counts as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bytes(batches, POOL_BYTES):
            out: list[tuple[int, bytes, bytes, bytes]] = []
            for lang, texts in _languages(rows).items():
                counted = Counter(chain.from_iterable(map(document_windows, texts)))
                ordered = sorted(counted)
                counts = np.fromiter(map(counted.__getitem__, ordered), np.int32, len(ordered))
                route = start = 0
                while start < len(ordered):
                    route = bisect_left(bounds, (lang, ordered[start] + b"\0"), route)
                    inside = route < len(bounds) and bounds[route][0] == lang
                    stop = bisect_left(ordered, bounds[route][1], start) if inside else len(ordered)
                    for a in range(start, stop, ROW_WINDOWS):
                        b = min(stop, a + ROW_WINDOWS)
                        out.append((route, lang, b"\n".join(ordered[a:b]), counts[a:b].tobytes()))
                    start = stop
            if out:
                number, langs, windows, counts_ = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number, pa.int32()),
                        pa.array(langs, pa.binary()).cast(pa.string()),
                        pa.array(windows, pa.binary()),
                        pa.array(counts_, pa.binary()),
                    ],
                    names=["route", "lang", "windows", "counts"],
                )

    return run


class _Codes(dict):
    """Word -> number; the empty word is 0."""

    def __init__(self):
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def frequent_prefixes(columns: list[np.ndarray], counts: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(pointer, words, occurrences) of each prefix that occurs ``least`` times.

    Multikey quicksort of pointers into the windows, three-way by one word at a time. Word 0 ends a window.
    """
    todo = [(np.arange(len(counts)), 0)] if counts.sum() >= least else []
    while todo:
        pointers, depth = todo.pop()
        words, weights = columns[depth][pointers], counts[pointers]
        size = len(words)
        pivot = sorted((words[0], words[size // 2], words[-1]))[1]
        for side in (words < pivot, words > pivot):
            if weights[side].sum() >= least:
                todo.append((pointers[side], depth))
        equal = words == pivot
        total = int(weights[equal].sum())
        if total >= least and pivot:
            same = pointers[equal]
            yield int(same[0]), depth + 1, total
            if depth + 1 < DEPTH:
                todo.append((same, depth + 1))


def _edges(bounds: list[Bound], route: int, lang: bytes) -> set[tuple[bytes, ...]]:
    """Phrases of a language that may lie in this route and another one: those that lead one of its two bounds."""
    found = set()
    for bound_lang, window in bounds[max(0, route - 1) : route + 1]:
        words = window.split(b"\t")
        found |= {tuple(words[:k]) for k in range(1, DEPTH) if bound_lang == lang and words[k - 1]}
    return found


def _count(bounds: list[Bound], least: int):
    """Function from the rows of routes to (lang, words, phrase, f), whole or, for edges and the total, in parts."""

    def counted(route: int, lang: bytes, blocks: list[tuple[bytes, bytes]]) -> list[tuple[bytes, int, bytes, int]]:
        codes = _Codes()
        parts = []
        for windows, _ in blocks:
            flat = windows.replace(b"\n", b"\t").split(b"\t")
            parts.append(np.fromiter(map(codes.__getitem__, flat), np.int32, len(flat)).reshape(-1, DEPTH))
        table = np.concatenate(parts)
        columns = [np.ascontiguousarray(table[:, i]) for i in range(DEPTH)]
        counts = np.concatenate([np.frombuffer(c, np.int32) for _, c in blocks]).astype(np.int64)
        names = list(codes)
        edges = _edges(bounds, route, lang)
        out = [(lang, 0, b"", int(counts.sum()))]
        for phrase in edges:
            if all(w in codes for w in phrase):
                hit = np.logical_and.reduce([columns[i] == codes[w] for i, w in enumerate(phrase)])
                out.append((lang, len(phrase), b" ".join(phrase), int(counts[hit].sum())))
        for pointer, size, total in frequent_prefixes(columns, counts, least):
            phrase = tuple(names[table[pointer, i]] for i in range(size))
            if phrase not in edges:
                out.append((lang, size, b" ".join(phrase), total))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], list[tuple[bytes, bytes]]] = {}
        for rows in batches:
            fields = [rows.column(c).to_pylist() for c in ("route", "lang", "windows", "counts")]
            for route, lang, windows, counts in zip(*fields):
                found.setdefault((route, lang.encode()), []).append((windows, counts))
        for (route, lang), blocks in found.items():
            langs, sizes, phrases, totals = zip(*counted(route, lang, blocks))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.binary()).cast(pa.string()),
                    pa.array(sizes, pa.int32()),
                    pa.array(phrases, pa.binary()).cast(pa.string()),
                    pa.array(totals, pa.int64()),
                ],
                names=["lang", "size", "phrase", "f"],
            )

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, route_bytes: int = ROUTE_BYTES) -> DataFrame:
    """(lang, size, phrase, f): phrases of one to DEPTH words that occur ``least`` times, and all words as size 0."""
    bounds = route_bounds(docs, route_bytes)
    sent = map_arrow(_inputs(docs), _route(bounds), "route int, lang string, windows binary, counts binary")
    dealt = sent.repartitionById(len(bounds) + 1, F.col("route"))
    parts = map_arrow(dealt, _count(bounds, least), "lang string, size int, phrase string, f long")
    whole = parts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return staged(whole.where((F.col("f") >= least) | (F.col("size") == 0)), "frequent-phrases")


def collocations(frequent: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates that no longer candidate covers."""
    part = lambda name: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(name[0]))
    candidates = frequent.where(F.col("size") >= 2).select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    piece = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": piece(F.lit(1), F.col("k")), "rest": piece(F.col("k") + 1, F.col("size") - F.col("k"))})
    scored = cuts.join(part("left"), ["lang", "left"]).join(part("rest"), ["lang", "rest"])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + r)")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = candidates.where(F.col("size") > 2).withColumn("n_words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n_words") + 1)))
    inner = inner.select("lang", piece(F.col("start"), F.col("n_words")).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    free = F.col("most").isNull() | (100 * wide("most") < covered * wide("a"))
    return best.join(longer, ["lang", "phrase"], "left").where(free).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def top_collocations(docs: DataFrame, top: int = TOP, least: int = LEAST_COUNT, route_bytes: int = ROUTE_BYTES) -> DataFrame:
    """The best ``top`` candidates of each language with rank, counts, all words ``n`` and score."""
    frequent = frequent_phrases(docs, least, route_bytes)
    place = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(frequent).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    totals = frequent.where(F.col("size") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


SQL = rf"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), pieces AS (
    SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), split AS (
    SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces
), flat AS (
    SELECT lang, id, unnest(words) AS w1, unnest(range(len(words))) AS i FROM split
), ahead AS (
    SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4
    FROM flat WINDOW p AS (PARTITION BY id ORDER BY i)
), counted AS (
    SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM ahead GROUP BY ALL
    UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL
), frequent AS (
    SELECT * FROM counted WHERE f >= {LEAST_COUNT}
), candidates AS (
    SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM frequent WHERE size >= 2
), cuts AS (
    SELECT c.*, k, x.f AS l, y.f AS r, CAST({SCALE} AS HUGEINT) * c.a // (x.f + y.f) AS score
    FROM candidates c JOIN (VALUES (1), (2), (3)) v(k) ON k < c.size
    JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:k], ' ')
    JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1:c.size], ' ')
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
    SELECT lang, array_to_string(words[s:s + m - 1], ' ') AS phrase, max(a) AS most
    FROM candidates, (VALUES (2), (3)) v(m), (VALUES (1), (2), (3)) w(s) WHERE m < size AND s + m - 1 <= size GROUP BY ALL
), ranked AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
    FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
    WHERE most IS NULL OR 100 * most < {COVERED} * a
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
