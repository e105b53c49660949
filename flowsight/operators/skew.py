"""Joining per-key results back to rows when one key may own a large part of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task should take. A key with more is hot, so there is fewer than one hot
# key per TASK_ROWS rows of the table: under a quarter of a million short keys in 10**12 rows.
TASK_ROWS = 4_000_000
KEYLESS_SALTS = 4096


def hot_keys(per_key: DataFrame, key: str, weight: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Keys with more rows than one task should take, and the number of tasks they fill."""
    return per_key.where(F.col(weight) > task_rows).select(key, F.ceil(F.col(weight) / task_rows).cast("int").alias("_salts"))


def join_per_key(df: DataFrame, per_key: DataFrame, key: str, weight: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """LEFT join of a table with one row per key (``weight`` = rows of that key) onto the rows.

    The rows of a hot key are spread over as many tasks as they fill, and its one row is repeated for
    each, which adds less than two rows per ``task_rows``. All other keys meet in one place as usual.
    The list of hot keys is the only thing broadcast by hand; see TASK_ROWS for its bound. Rows without
    a key match nothing and are spread too.

    The salt is a hash of the whole row and not a random number, so a re-run task sends its rows where the
    first run did. Copies of one row share a salt; both join sides are plain shuffles, which lets
    AQE split such a partition further.
    """
    hot = F.broadcast(hot_keys(per_key, key, weight, task_rows))
    by = [c for c in df.columns if c != key] or [key]
    salts = F.when(F.col(key).isNull(), KEYLESS_SALTS).otherwise(F.coalesce("_salts", F.lit(1)))
    rows = df.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("_salts")
    last = F.greatest(F.ceil(F.col(weight) / task_rows).cast("int") - 1, F.lit(0))
    facts = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop(weight)
    return rows.join(facts, [key, "_salt"], "left").drop("_salt")
