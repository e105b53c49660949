"""Near duplicates by bottom-k sketches from one hash function.

A document's set holds its distinct word shingles as 64-bit hashes; its sketch is the ``k`` smallest of them. Documents
with equal sets form a class that its smallest id represents; only representatives are compared.

Candidates come from inverted lists of retained values. Of a set of ``n`` shingles the first ``n - ceil(0.75 n) + 1`` in the
order of the hash are retained, which no link can avoid: two sets that share enough have a common value among them, at
places that their sizes bound (``_placed``). One order for all documents is enough for that, so the most
frequent shingles, counted in a sample of the documents, come last in it: passages that many documents have in common are
only retained where they are most of a document. Pairs from the lists are filtered by size and by the estimate from
the union's sketch (a link at the threshold fails it with a chance below 1e-7, and none does whose sets have at most
``k`` shingles); what is left is confirmed on the full sets.

Pairs within a list are not all formed. In each of ``rounds`` rounds every list compares its members with one
pivot, first the member that is in the most lists, and confirmed links merge components; a last round forms
the pairs of members that are still in different components, so a group of any number of copies costs a few
comparisons a member and no link between components is left untested. Components are found by alternating
large-star and small-star steps on written tables.

Texts are lower-cased in A-Z. With fewer words than a shingle the whole word sequence is the one shingle. Null or
wordless texts have an empty set and are linked with nothing. Rows that share an id and a text give equal rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .common import FOLD, byte_texts, map_arrow, remembered, sliced, words

SHINGLE = 5
K = 64
PERCENT = 75
ROUNDS = 2
CACHED_WORDS = 300_000
FREQUENT = 200_000  # values that the order puts last, at most
SAMPLED = 16  # frequencies are counted in one of so many documents
LEAST_SAMPLED = 4  # and such a value is in so many of them at least


class WordHashes(dict):
    """64-bit hash of a word, remembered for up to CACHED_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value
        return value


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    ws = words(text.translate(FOLD))
    if not ws:
        return np.zeros(0, np.int64)
    hashed = np.fromiter(map(remembered("word hashes", WordHashes).__getitem__, ws), np.uint64, len(ws))
    width = min(shingle, len(ws))
    n = len(ws) - width + 1
    out = np.full(n, width, np.uint64)  # a short text never equals a window of a longer one
    for at in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[at : at + n]
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((out ^ (out >> np.uint64(31))).view(np.int64))


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent_values(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """The most frequent shingles of a hash-chosen sample of the documents, by rising frequency; at most FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(sliced, batches)):
            for text in byte_texts(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle), pa.int64())], ["value"])

    sample = _texts(docs).where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(SAMPLED)) == 0)
    counts = map_arrow(sample, run, "value long").groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SAMPLED)
    top = counts.orderBy(F.desc("n"), "value").limit(FREQUENT).collect()
    return np.array([r.value for r in reversed(top)], np.int64)


def retained(values: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, int]:
    """The first values of a sorted set that a link cannot avoid, and how many of them are not ``frequent``.

    The frequent values (sorted) come last, by ``place``.
    """
    take = len(values) - -(-PERCENT * len(values) // 100) + 1
    at = np.minimum(np.searchsorted(frequent, values), max(len(frequent) - 1, 0))
    late = frequent[at] == values if len(frequent) else np.zeros(len(values), bool)
    first = values[~late][:take]
    if len(first) < take:
        last = values[late][np.argsort(place[at[late]])][: take - len(first)]
        return np.concatenate([first, last]), len(first)
    return first.copy(), take


def sketches(docs: DataFrame, frequent: np.ndarray, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id, n_shingles, set_digest (of the whole set), sketch (its k smallest values), the retained values and how many
    of them come ``first``, before the frequent ones."""
    order = np.argsort(frequent)
    by_value, place = frequent[order], order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(sliced, batches)):
            sizes, digests, bottom, kept, firsts = [], [], [], [], []
            for text in byte_texts(batch.column("text")):
                values = shingle_set(text, shingle)
                sizes.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                bottom.append(values[:k].copy())
                mine, first = retained(values, by_value, place) if len(values) else (values, 0)
                kept.append(mine)
                firsts.append(first)
            arrays = [
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _longs(bottom), _longs(kept),
                pa.array(firsts, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_digest", "sketch", "retained", "first"])

    return map_arrow(_texts(docs), run, "doc_id long, n_shingles long, set_digest binary, sketch array<long>, retained array<long>, first int")


def full_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its full shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(sliced, batches)):
            values = _longs([shingle_set(text, shingle) for text in byte_texts(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "shingles"])

    return map_arrow(_texts(docs), run, "doc_id long, shingles array<long>")


def least_shared(size: Column) -> Column:
    """Values that a linked pair's sketches share at least, for a sketch of ``size`` values."""
    return F.greatest(F.ceil(size * 0.4375), F.lit(1)).cast("int")


def inverted_lists(reps: DataFrame) -> DataFrame:
    """(value, node, n, place, weight): the retained values that others retain too, with their place among them.

    The members of a list are counted where its rows meet, except for the frequent values, whose lists are long: those are
    counted by an aggregate first. ``weight`` is the number of a node's lists: the centre of a group of edited copies,
    which has the fewest values of its own, has the most.
    """
    entries = reps.select("node", "n", "first", F.posexplode("retained").alias("place", "value"))
    entries = entries.withColumn("frequent", F.col("place") >= F.col("first")).drop("first")
    rare = entries.where(~F.col("frequent")).withColumn("members", F.count("*").over(Window.partitionBy("value")))
    often = entries.where("frequent")
    counts = staged(often.groupBy("value").agg(F.count("*").alias("members")), "frequent-values")
    lists = rare.unionByName(often.join(counts, "value")).where("members > 1").drop("frequent")
    lists = staged(lists, "lists")
    weights = staged(lists.groupBy("node").agg(F.count("*").alias("weight")), "weights")
    return staged(lists.drop("members").join(weights, "node"), "weighted-lists")


def _placed(a: str, b: str) -> Column:
    """A value two linked sets have in common lies within these places of both, counted from 0; the sizes fit too."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    overlap = F.ceil((na + nb) * PERCENT / (100 + PERCENT) - 1e-9)
    return (F.col(f"place{a}") <= na - overlap) & (F.col(f"place{b}") <= nb - overlap)


def _estimated(pairs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves a link possible, with the estimate."""
    sketch = reps.select("node", "sketch")
    both = (
        pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        .withColumn("union", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
        .withColumn("common", F.size(F.array_intersect(F.array_intersect("sa", "sb"), "union")))
    )
    kept = both.where(F.col("common") >= least_shared(F.size("union")))
    return kept.select("a", "b", (F.col("common") / F.size("union")).alias("estimate"))


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs whose full sets meet the threshold; sets are made of the documents in a pair only."""
    pairs = staged(pairs.select("a", "b").distinct(), "candidates")
    wanted = staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "candidate-ids")
    sets = staged(full_sets(_texts(docs).join(wanted, "doc_id", "left_semi"), shingle).dropDuplicates(["doc_id"]), "sets")
    both = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= PERCENT * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of the component, for every node of an edge (a, b). Distributed stars."""
    stars = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(stars.select("v", "v").distinct()).distinct()
        before = mark
        both = stars.union(stars.select("v", "u"))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large-star")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = staged(moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "small-star")


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _pivot_pairs(lists: DataFrame, seed: int) -> DataFrame:
    """(a, b): the pivot of a list with each member of another component."""
    order = F.struct(F.xxhash64("node", F.lit(seed))) if seed else F.struct(-F.col("weight"), "node")
    pivots = lists.groupBy("value").agg(
        F.min_by(F.struct("node", "n", "place", "comp"), order).alias("p"), F.min("comp").alias("least"), F.max("comp").alias("most")
    )
    pivots = pivots.where("least < most").select("value", *(F.col(f"p.{c}").alias(f"{c}2") for c in ("node", "n", "place", "comp")))
    pairs = lists.join(staged(pivots, "pivots"), "value").where((F.col("comp") != F.col("comp2")) & _placed("", "2"))
    return pairs.select(F.col("node2").alias("a"), F.col("node").alias("b")).distinct()


def _best(likely: DataFrame) -> DataFrame:
    """For each member the pivot that it most likely links to."""
    return likely.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))


def _rest_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): members of a list in different components; lists within one component form none."""
    mixed = lists.groupBy("value").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    open_ = staged(lists.join(staged(mixed.select("value"), "mixed"), "value"), "open-lists")
    other = open_.select("value", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "place", "comp")))
    pairs = open_.join(other, "value").where((F.col("comp") < F.col("comp2")) & _placed("", "2"))
    return pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for every row of ``docs``."""
    sketched = staged(sketches(docs, frequent_values(docs, shingle), shingle, k), "sketches")
    filled = sketched.where("n_shingles > 0")
    ids = filled.select("doc_id", "set_digest", "n_shingles")
    classes = staged(ids.groupBy("set_digest", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    # Copies are few, or as many as they are: Spark sees the size of this table and broadcasts it or not.
    copies = staged(ids.join(classes, ["set_digest", "n_shingles"]).where("doc_id > node").select("doc_id").distinct(), "copies")
    reps = filled.join(copies, "doc_id", "left_anti").withColumnsRenamed({"doc_id": "node", "n_shingles": "n"})
    lists = inverted_lists(reps.select("node", "n", "retained", "first"))
    sketch = reps.select("node", "sketch")
    links: DataFrame | None = None
    labels: DataFrame | None = None
    for seed in range(rounds + 1):
        now = lists.withColumn("comp", F.col("node")) if labels is None else staged(_labelled(lists, labels), "labelled")
        if seed < rounds:
            new = _confirmed(_best(_estimated(_pivot_pairs(now, seed), sketch, k)), docs, shingle)
        else:
            new = _confirmed(_estimated(_rest_pairs(now), sketch, k), docs, shingle)
        new = staged(new, "links")
        links = new if links is None else links.union(new)
        labels = components(links)
    joined = sketched.select("doc_id", "n_shingles", "set_digest").join(classes, ["set_digest", "n_shingles"], "left").join(labels, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("comp", "node"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id; of repeated rows one stays.

    Rows with that id and another text stay too, as do different texts without an id: an id alone makes no duplicate.
    """
    kept = near_duplicates(docs, **options).where("kept OR doc_id IS NULL").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates(["doc_id", "text"])


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS k FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), comp AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""
