"""Quality rules: base rules on counts, then robust multivariate outliers within each language and source.

Every text gives a vector of transformed statistics. For each (lang, source) group the minimum covariance
determinant (MCD) estimate is found as FAST-MCD does: many small random starts on a bounded hash-chosen sample of the
group, then concentration steps over all rows of all groups, in which the ``h`` rows nearest to the present centre
give the next centre and covariance. The nearest rows are taken by whole distance buckets of ``2**-7`` relative width
that hold at least ``h`` rows, so one pass with partial aggregation finds them and no group meets in one task. A row is
rejected if its squared Mahalanobis distance is beyond ``cutoff`` after the usual consistency scaling by the median.

Rates are drawn towards the corpus rate by ``PRIOR_WORDS`` words, so that short texts, whose rates are noisy, are
not outliers for being short; ``FLOORS`` is the least standard deviation that counts, so that a statistic which most rows
share exactly doesn't make every other value infinitely far.

Groups with fewer than ``least_rows`` rows use the estimate of their language, then of the whole corpus; these rest on
all rows of the language or corpus, those of large groups included. A null
lang or source is a group value like any other. Null and empty texts have no words and fail the base rules. With
no row that passes the base rules nothing is estimated. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .common import byte_texts, forget, map_arrow, ship, sliced, words

WINDOW = 8
PRIOR_WORDS = 60.0
STATS = ("word_length", "symbols", "upper", "letters", "bare", "distinct", "repeats", "dup_lines")
# Least standard deviation of each statistic after its transformation. Repeats have a base rule; here they weigh little.
FLOORS = (0.08, 0.06, 0.06, 0.06, 0.06, 0.15, 0.25, 0.25)
SHARE = 0.75  # of a group's rows that the estimate rests on
SAMPLE = 1500  # rows of a group in which starts are sought
STARTS = 60
STEPS = 3  # concentration steps over all rows
LEAST_ROWS = 200
CUTOFF = 60.0  # squared distance; 5e-10 of a chi-square with 8 degrees of freedom lies beyond
BUCKETS = 128  # distance buckets per doubling
SALTS, SALT_ROWS = 8, 250_000  # a group is spread over so many tasks, and one more for so many rows

_COUNTS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("n_lines", pa.int64()), ("n_upper", pa.int64()), ("n_letters", pa.int64()),
    ("n_distinct", pa.int64()), ("n_bare", pa.int64()),
]
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\v\f\r"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(ws: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the text, the first occurrence included."""
    n = len(ws) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws))
    if len(ids) == len(ws):
        return 0
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + at[k : k + n].astype(np.uint64)
    order = np.sort(hashed)
    if not (order[1:] == order[:-1]).any():  # equal windows have equal hashes, so there are none
        return 0
    rows = np.lib.stride_tricks.sliding_window_view(at, window)
    _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[which.ravel()] > 1)
    edge = np.zeros(len(ws) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of _COUNTS."""
    ws = words(text)
    decoded = text.decode()
    seen: set[bytes] = set()
    lines = dups = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    chars = len(decoded) - (len(text) - len(text.translate(None, _BLANKS)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    upper = len(text) - len(text.translate(None, _CAPITALS))
    marks = len(text.translate(None, _LETTERS_OR_MORE))
    return (len(ws), chars, symbols, dups, repeated_words(ws), lines, upper, len(decoded) - marks, len(set(ws)), _bare(text))


def _bare(text: bytes) -> int:
    """Words without a letter or digit."""
    return len(_BARE.findall(text))


# A run of ASCII marks between blanks.
_BARE = re.compile(rb"(?<![^ \t\n\v\f\r])[!-/:-@\[-`{-~]+(?![^ \t\n\v\f\r])")
# Bytes that are no ASCII letter are marks, blanks or digits; what is beyond ASCII counts as letters.
_LETTERS_OR_MORE = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalpha())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in chain.from_iterable(map(sliced, batches)):
        rows = [text_counts(t) for t in byte_texts(batch.column("text"))]
        columns = list(zip(*rows, strict=True)) or [[] for _ in _COUNTS]
        arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _COUNTS, strict=True)]
        keys = [batch.column(name).cast(kind) for name, kind in (("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()))]
        yield pa.RecordBatch.from_arrays([*keys, *arrays], ["doc_id", "lang", "source", *(n for n, _ in _COUNTS)])


def count_texts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row of ``docs``."""
    schema = ", ".join(f"{name} long" for name, _ in _COUNTS)
    rows = docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("text", "lang", "source")))
    return map_arrow(rows, _count, f"doc_id long, lang string, source string, {schema}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vectors(counts: DataFrame) -> DataFrame:
    """Add ``x``, the transformed statistics; the corpus rates are one row."""
    ratios = {
        "symbols": ("n_symbols", "word_chars"), "upper": ("n_upper", "word_chars"), "letters": ("n_letters", "word_chars"), "bare": ("n_bare", "n_words"),
        "distinct": ("n_distinct", "n_words"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    }
    of = {"word_chars": 6.0, "n_words": 1.0, "n_lines": 0.05}  # of each unit in a word
    rate = counts.where(~base_failed()).agg(
        *(F.coalesce(F.sum(a) / F.greatest(F.sum(b), F.lit(1)), F.lit(0.0)).alias(k) for k, (a, b) in ratios.items()),
        F.coalesce(F.sum("word_chars") / F.greatest(F.sum("n_words"), F.lit(1)), F.lit(1.0)).alias("word_length"),
    ).first()
    columns = [F.log((F.col("word_chars") + PRIOR_WORDS * rate["word_length"]) / (F.col("n_words") + PRIOR_WORDS) + 1e-9)]
    for k, (a, b) in ratios.items():
        weight = PRIOR_WORDS * of[b]
        share = (F.col(a) + weight * rate[k]) / (F.col(b) + weight)
        if k == "distinct":  # falls with the length of any text: taken against the logarithm of the length
            columns.append(F.log(F.greatest(F.col(a), F.lit(1))) - 0.75 * F.log(F.greatest(F.col(b), F.lit(1))))
        else:
            columns.append(F.asin(F.sqrt(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))))
    return counts.withColumn("x", F.array(*columns))


def _scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(0), np.cov(x, rowvar=False, bias=True) + np.diag(np.square(FLOORS))


def _distances(x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    y = x - centre
    return np.einsum("ij,ij->i", y, np.linalg.solve(cov, y.T).T)


def start_estimate(x: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Best of STARTS small random subsets after concentration on the rows of ``x``."""
    rng, h, p = np.random.default_rng(seed), max(2, int(np.ceil(SHARE * len(x)))), x.shape[1]
    tried = []
    for _ in range(STARTS):
        few = x[rng.choice(len(x), min(len(x), p + 1), replace=False)]
        centre, cov = _scatter(few)
        for _ in range(2):
            centre, cov = _scatter(x[np.argsort(_distances(x, centre, cov), kind="stable")[:h]])
        tried.append((np.linalg.slogdet(cov)[1], centre, cov))
    best = None
    for _, centre, cov in sorted(tried, key=lambda t: t[0])[:5]:
        for _ in range(30):
            old = np.linalg.slogdet(cov)[1]
            centre, cov = _scatter(x[np.argsort(_distances(x, centre, cov), kind="stable")[:h]])
            if np.linalg.slogdet(cov)[1] > old - 1e-9:
                break
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = (np.linalg.slogdet(cov)[1], centre, cov)
    return best[1], best[2]


def _inverse(cov: np.ndarray) -> list[float]:
    return np.linalg.inv(cov).ravel().tolist()


_FIT = "key string, centre array<double>, inverse array<double>"


def _start(group: pd.DataFrame) -> pd.DataFrame:
    centre, cov = start_estimate(np.array(group["x"].tolist()))
    return pd.DataFrame({"key": [group["key"].iloc[0]], "centre": [centre.tolist()], "inverse": [_inverse(cov)]})


def _next(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the concentrated rows, one row per group, to the next estimate."""
    p = len(STATS)
    for f in frames:
        out = []
        for key, n, sums, products in zip(f["key"], f["n"], f["sums"], f["products"], strict=True):
            mean = np.array(sums) / n
            cov = np.zeros((p, p))
            cov[np.triu_indices(p)] = np.array(products) / n
            cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean) + np.diag(np.square(FLOORS))
            out.append((key, mean.tolist(), _inverse(cov)))
        yield pd.DataFrame(out, columns=["key", "centre", "inverse"])


def _with_distance(rows: DataFrame, fits: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    p = len(STATS)
    y = [F.col("x")[i] - F.col("centre")[i] for i in range(p)]
    lines = [reduce(lambda a, b: a + b, [F.col("inverse")[i * p + j] * F.col(f"_y{j}") for j in range(p)]) * F.col(f"_y{i}") for i in range(p)]
    joined = rows.join(fits, list(by)).withColumns({f"_y{i}": c for i, c in enumerate(y)})
    return joined.withColumn("d2", F.greatest(reduce(lambda a, b: a + b, lines), F.lit(0.0))).drop(*(f"_y{i}" for i in range(p)))


def _bucket() -> Column:
    """Bucket number that grows with the distance."""
    return F.floor(F.log2(F.col("d2") + 1e-12) * BUCKETS).cast("long")


def _cut(rows: DataFrame, share: float) -> DataFrame:
    """For each key the first bucket at which at least ``share`` of its rows are reached. Buckets are few thousand a key."""
    per = rows.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    listed = per.groupBy("key").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("all"))
    reached = F.aggregate(
        "all",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("cut")),
        lambda a, b: F.struct(
            (a["seen"] + b["n"]).alias("seen"),
            F.coalesce(a["cut"], F.when(a["seen"] + b["n"] >= F.ceil(F.col("total") * share), b["bucket"])).alias("cut"),
        ),
    )
    return listed.select("key", reached["cut"].alias("cut"))


def _levels(vectors: DataFrame, least_rows: int) -> DataFrame:
    """Give every row ``key``, the finest level with enough rows (language and source, language, corpus), and ``keys``, the
    levels whose estimates rest on it: language and source if large enough, and each coarser level that some small group needs."""
    name = lambda *cols: F.to_json(F.struct(*(F.col(c) for c in cols)), {"ignoreNullFields": "false"})
    keyed = vectors.withColumns({"fine": name("lang", "source"), "mid": name("lang")})
    sizes = keyed.where(~base_failed()).groupBy("mid", "fine").agg(F.count("*").alias("n_fine"))
    mids = sizes.groupBy("mid").agg(F.sum("n_fine").alias("n_mid"), F.min("n_fine").alias("smallest"))
    whole = mids.agg(F.coalesce(F.max(F.col("n_mid") < least_rows), F.lit(False)).alias("whole"))
    fine = F.when(F.col("n_fine") >= least_rows, F.col("fine"))
    mid = F.when(F.col("n_mid") >= least_rows, F.col("mid"))
    needed = [fine, F.when(F.col("smallest") < least_rows, mid), F.when(F.col("whole"), F.lit(""))]
    chosen = sizes.join(mids, "mid").crossJoin(whole).select("fine", F.coalesce(fine, mid, F.lit("")).alias("key"), F.array_compact(F.array(*needed)).alias("keys"))
    return keyed.join(chosen, "fine", "left").drop("fine", "mid")


def estimate(rows: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """(key, centre, inverse, scale): the MCD estimate of every key over all of its rows."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("total"))
    sizes = staged(sizes.withColumn("salts", (SALTS + F.floor(F.col("total") / SALT_ROWS)).cast("int")), "group-sizes")
    salt = F.pmod(F.xxhash64("doc_id", "x", F.lit(1)), F.col("salts")).cast("int")
    rows = staged(rows.join(sizes, "key").withColumn("salt", salt).drop("salts"), "group-rows")
    # equal rows are picked together, so they count once here; a group of which none is picked starts from one row
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 30)) < float(sample) / F.col("total") * (1 << 30))
    first = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id", "x"), "doc_id", "x")).alias("r")).select("key", "r.doc_id", "r.x")
    picked = picked.select("key", "doc_id", "x").unionByName(first).distinct().select("key", "x")
    ship(rows.sparkSession)
    fits = staged(picked.groupBy("key").applyInPandas(_start, _FIT), "mcd-start")
    p = len(STATS)
    products = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(p) for j in range(i, p)]

    def near() -> DataFrame:
        """Rows with the bucket of their distance; a group's rows are spread by salt, so sums are formed in many tasks."""
        spread = fits.join(sizes.select("key", "salts"), "key").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")
        return staged(_with_distance(rows, spread, ("key", "salt")).select("key", "x", "salt", _bucket().alias("bucket")), "distances")

    for step in range(steps):
        found = near()
        cuts = _cut(found, SHARE).join(sizes.select("key", "salts"), "key")
        cuts = cuts.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")
        core = found.join(cuts, ["key", "salt"]).where(F.col("bucket") <= F.col("cut"))
        sums = core.groupBy("key").agg(
            F.count("*").alias("n"), F.array(*(F.sum(F.col("x")[i]) for i in range(p))).alias("sums"), F.array(*products).alias("products")
        )
        fits = staged(sums.mapInPandas(_next, _FIT), f"mcd-{step}")
    middle = _cut(near(), 0.5).select("key", (F.pow(F.lit(2.0), F.col("cut") / BUCKETS) / chi_square_median(p)).alias("scale"))
    return staged(fits.join(middle, "key").withColumn("scale", F.greatest("scale", F.lit(1.0))), "mcd")


def chi_square_median(p: int) -> float:
    """Median of a chi-square with ``p`` degrees of freedom (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p)) ** 3


def judge(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``distance`` (squared, scaled; null if the base rules failed) and ``kept``."""
    counts = staged(count_texts(docs), "text-counts")
    rows = staged(_levels(_vectors(counts), least_rows), "text-vectors")
    passed = rows.where(~base_failed()).select("doc_id", F.explode("keys").alias("key"), "x")
    fits = estimate(passed, sample, steps)
    near = _with_distance(rows.where(~base_failed()), fits).withColumn("distance", F.col("d2") / F.col("scale"))
    names = [n for n, _ in _COUNTS]
    good = near.select("doc_id", "lang", "source", *names, F.lit(False).alias("base_failed"), "distance", (F.col("distance") <= cutoff).alias("kept"))
    bad = rows.where(base_failed()).select(
        "doc_id", "lang", "source", *names, F.lit(True).alias("base_failed"), F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")
    )
    return good.unionByName(bad)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass; rows that share an id stay if one of them passes."""
    kept = judge(docs, **options).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")
