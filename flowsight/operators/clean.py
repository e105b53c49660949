"""Casting, filling, quarantine, duplicate removal and data-quality counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CORRUPT, FLOW_DEFAULTS, FLOW_KEY, NUMERIC_COLUMNS, TEXT_COLUMNS, quoted


def cast_flows(df: DataFrame) -> DataFrame:
    """Measures to double and text fields to text, in one projection; a measure that is no number becomes null."""
    kinds = {**dict.fromkeys(NUMERIC_COLUMNS, "double"), **dict.fromkeys(TEXT_COLUMNS, "string")}
    return df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else quoted(c) for c in df.columns])


def fill_defaults(df: DataFrame) -> DataFrame:
    """Per-column default for null (and, in measures, NaN)."""
    return df.fillna({c: v for c, v in FLOW_DEFAULTS.items() if c in df.columns})


def normalize_label(df: DataFrame, column: str = "anomaly") -> DataFrame:
    text = F.lower(F.trim(F.col(column).cast("string")))
    return df.withColumn(column, F.coalesce(text, F.lit("normal")))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, corrupt) rows of a parse that carries the corrupt-record column.

    Select data columns from either side, or stage the parse first: Spark refuses a query on the raw
    file that touches the corrupt column alone.
    """
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull())


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [quoted(c).isNull() for c in columns], F.lit(False))


def rows_with_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with a null in any of the columns."""
    return df.where(any_null([c for c in (columns or df.columns) if c != CORRUPT]))


def dedupe_flows(df: DataFrame, key: Sequence[str] = FLOW_KEY, order: Sequence[str] = ()) -> DataFrame:
    """One row per flow key: the first by ``order``, then by every other column, so always the same one.

    The rank limit is applied before the shuffle as well as after (partial and final group limit),
    so however many copies a key has, each map task sends on one of them.
    """
    rest = [*order, *[c for c in df.columns if c not in (*key, *order)]]
    place = W.partitionBy(*[quoted(c) for c in key]).orderBy(*[quoted(c) for c in (rest or key)])
    return df.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") == 1).drop("_rank")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def heal(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Fill, remove duplicate flows, normalise the label (where there is one)."""
    healed = dedupe_flows(fill_defaults(df), order=order)
    return normalize_label(healed) if "anomaly" in healed.columns else healed


def _filled(column: str) -> Column:
    """The column with its default in place of null and NaN, as ``fill_defaults`` leaves it."""
    default = F.lit(FLOW_DEFAULTS[column])
    return F.coalesce(F.nanvl(column, default) if column in NUMERIC_COLUMNS else F.col(column), default)


def quality_report(df: DataFrame) -> DataFrame:
    """One row of counts over canonical, cast, unfilled rows; a corrupt-record column is honoured.

    A single pass: duplicates are clean rows less distinct filled keys, and the distinct keys are
    pre-aggregated per map task, so a group of copies costs one key per task.
    """
    has_corrupt = CORRUPT in df.columns
    corrupt = F.col(CORRUPT).isNotNull() if has_corrupt else F.lit(False)
    data = [c for c in df.columns if c != CORRUPT]
    filled = [_filled(c) for c in FLOW_KEY]
    counts = df.select(
        corrupt.alias("corrupt"),
        (any_null(data) & ~corrupt).alias("gap"),
        *[F.when(~corrupt, v).alias(c) for c, v in zip(FLOW_KEY, filled)],
    ).agg(
        F.count_if("corrupt").alias("corrupted_rows_quarantined"),
        F.count_if(~F.col("corrupt")).alias("clean_rows"),
        F.count_if("gap").alias("null_rows"),
        F.count_distinct(*FLOW_KEY).alias("rows_processed"),
    )
    return counts.select(
        "rows_processed",
        F.greatest(F.lit(0), F.col("clean_rows") - F.col("rows_processed")).alias("duplicates_removed"),
        "null_rows",
        "corrupted_rows_quarantined",
    )
