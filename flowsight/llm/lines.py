"""Substring dedup by line hashing.

A unit is a line of a text; its digest is the md5 of the line with letters lower-cased and blanks collapsed. Units
with at least ``least_words`` words, by default every line with a word, are grouped by digest over the whole corpus; the
earliest ranked occurrence, by (doc_id, start), stays and every other one is removed. Offsets of removed units are kept as code points of the
original text; the newline that ends a unit goes with it.

The digests of repeated units are found by an aggregate with partial sums and written down before they are joined
back, so both sides of that join are plain exchanges and a very frequent line is split over tasks.

Null texts have no units and stay null; empty texts stay empty, and an empty table gives an empty one. A row is known by its
doc_id and a hash of its text: of rows that share both the units rank equal and stay in all of them, rows that share a doc_id
with different texts are documents of their own, ranked by that hash, and a null doc_id ranks first. Very long texts are split in
one pass and give their units in batches. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .common import byte_texts, map_arrow

LEAST_WORDS = 1

_UNITS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.binary())])
_BATCH = 50_000


def line_units(text: bytes, least_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of every line with enough words, in code points; the end lies after the newline."""
    at, lines = 0, text.decode().split("\n")
    for k, line in enumerate(lines):
        end = at + len(line) + (k < len(lines) - 1)
        ws = line.encode().split()
        if len(ws) >= least_words:
            yield at, end, hashlib.md5(b" ".join(ws).decode().lower().encode(), usedforsecurity=False).digest()
        at = end


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``text_key``, which tells texts of one doc_id apart."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.withColumn("text_key", F.xxhash64("text"))


def units(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_key, start, stop, digest of the units that are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _UNITS, strict=True)], schema=_UNITS)

        rows: list[tuple] = []
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            for doc_id, key, text in zip(ids, keys, byte_texts(batch.column("text")), strict=True):
                for unit in line_units(text, least_words):
                    rows.append((doc_id, key, *unit))
                    if len(rows) >= _BATCH:
                        yield out()
                        rows = []
        if rows:
            yield out()

    return map_arrow(keyed(docs), run, "doc_id long, text_key long, start long, stop long, digest binary")


def repeated_units(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_key, start, stop of every unit that an earlier ranked one repeats."""
    all_units = staged(units(docs, least_words), "units")
    rank = F.struct("doc_id", "text_key", "start")
    repeated = all_units.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first < last")
    first = staged(repeated.select("digest", "first"), "repeated-units")
    return all_units.join(first, "digest").where(rank > F.col("first")).select("doc_id", "text_key", "start", "stop")


def removals(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_key and ``spans``, the removed (start, stop) ranges in order; only documents that lose something."""
    gone = repeated_units(docs, least_words).distinct()
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if text is not None and spans:
                kept, at = [], 0
                for span in spans:
                    kept.append(text[at : span["start"]])
                    at = span["stop"]
                text = "".join([*kept, text[at:]])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("spans")], ["doc_id", "text", "spans"])


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, ``text`` without the repeated units, and the removed ``spans``, for every row of ``docs``."""
    gone = removals(docs, least_words).withColumnsRenamed({"doc_id": "_gone", "text_key": "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.col("text_key") == F.col("_key"))
    joined = keyed(docs).join(gone, same, "left")
    spans = F.coalesce("spans", F.expr("CAST(array() AS array<struct<start: bigint, stop: bigint>>)")).alias("spans")
    return map_arrow(joined.select("doc_id", "text", spans), _cut, "doc_id long, text string, spans array<struct<start: long, stop: long>>")


SQL = r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, k, lines[k] AS line, len(lines) AS n,
    coalesce(list_sum([length(x) + 1 for x in lines[1:k - 1]]), 0)::BIGINT AS start
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM split)
), unit AS (
  SELECT doc_id, start, start + length(line) + CASE WHEN k < n THEN 1 ELSE 0 END AS stop,
    lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS norm
  FROM line WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) AS nth FROM unit
), gone AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(start || ':' || stop, ',' ORDER BY start) AS removed,
    sum(stop - start) AS removed_chars
  FROM ranked WHERE nth > 1 GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line || CASE WHEN l.k < l.n THEN chr(10) ELSE '' END, '' ORDER BY l.k) AS clean
  FROM line l LEFT JOIN (SELECT doc_id, start FROM ranked WHERE nth > 1) g ON g.doc_id = l.doc_id AND g.start = l.start
  WHERE g.doc_id IS NULL GROUP BY l.doc_id
)
SELECT s.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars,
  coalesce(removed, '') AS removed,
  CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(clean, '') END AS clean_text
FROM split s LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
