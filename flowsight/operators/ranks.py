"""Global positions, exact quantiles and short rolling windows without a one-task sort.

All three rest on one sorted, staged copy of the data: Spark range-partitions and sorts it, every
row remembers its partition and its place there, and a table of one row per partition turns that
into global positions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import quoted
from ..sources.scratch import staged

PART, PLACE = "_part", "_place"
BLOCK_ROWS = 1_000_000


def _as_order(order: Sequence[str | Column]) -> list[Column]:
    return [quoted(c) if isinstance(c, str) else c for c in order]


def _staged_order(df: DataFrame, order: Sequence[str | Column], label: str, ties: bool = True) -> DataFrame:
    """``df`` sorted and written once, with partition number and place within the partition.

    Where rows may tie, their position in a first written copy decides, so that full copies of a row
    can be split between range partitions. The position must come from a written table: after a
    shuffle a re-run task may see its rows in another order and send a row to two partitions or none.
    """
    by = _as_order(order)
    if ties:
        df = staged(df, f"{label}-input").withColumn("_tie", F.monotonically_increasing_id())
        by.append(F.col("_tie"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = df.orderBy(*by).drop("_tie")
    return staged(ordered.select("*", F.spark_partition_id().alias(PART), place.alias(PLACE)), label)


def _offsets(parts: DataFrame, amount: str) -> DataFrame:
    """Sum of ``amount`` over the partitions before each one; one row per partition, hence small."""
    before = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return parts.select(PART, F.coalesce(F.sum(amount).over(before), F.lit(0)).alias("_before"))


def row_ids(df: DataFrame, order: Sequence[str | Column], name: str = "row_id", unique: bool = False) -> DataFrame:
    """Dense 0-based position of every row in the global order.

    ``unique`` says that no two rows are equal in the order columns, which saves a copy of the data.
    """
    placed = _staged_order(df, order, "row-ids", ties=not unique)
    parts = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("_rows"))
    joined = placed.join(F.broadcast(_offsets(parts, "_rows")), PART)
    return joined.select(*[quoted(c) for c in df.columns], (F.col("_before") + F.col(PLACE)).alias(name))


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct numeric values with their counts, sorted and written once: (value, rows, place).

    Counting first folds repeated values, however common, before anything is sorted.
    """
    counted = (
        df.select(quoted(column).try_cast("double").alias("value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return _staged_order(counted, ["value"], "sorted-values", ties=False)


def value_positions(values: DataFrame) -> DataFrame:
    """``sorted_values`` with the number of smaller rows: (value, rows, below)."""
    parts = values.groupBy(PART).agg(F.sum("rows").alias("_rows"))
    running = F.sum("rows").over(W.partitionBy(PART).orderBy(PLACE).rowsBetween(W.unboundedPreceding, 0))
    return (
        values.withColumn("_upto", running)
        .join(F.broadcast(_offsets(parts, "_rows")), PART)
        .select("value", "rows", (F.col("_before") + F.col("_upto") - F.col("rows")).alias("below"))
    )


def exact_quantiles(values: DataFrame, probabilities: Sequence[float], total: int) -> list[float]:
    """Linearly interpolated quantiles of ``sorted_values`` holding ``total`` rows.

    The two ranks around each probability are looked up in one aggregate that keeps one value per rank.
    """
    if not probabilities or not total:
        return []
    places = [p * (total - 1) for p in probabilities]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})

    def at(rank: int) -> Column:
        holds = (F.col("below") <= rank) & (F.col("below") + F.col("rows") > rank)
        return F.max(F.when(holds, F.col("value")))

    found = dict(zip(ranks, value_positions(values).agg(*[at(r) for r in ranks]).first()))
    lows = [found[math.floor(p)] for p in places]
    highs = [found[math.ceil(p)] for p in places]
    return [low + (high - low) * (p - math.floor(p)) for low, high, p in zip(lows, highs, places)]


def rolling_mean(
    df: DataFrame, key: str, order: Sequence[str], score: str, size: int = 5, name: str = "rolling_mean",
    block_rows: int = BLOCK_ROWS, unique: bool = False,
) -> DataFrame:
    """Mean of the latest ``size`` scores of the same key, in order.

    Rows are numbered by (key, order) and cut into blocks; each block also receives the ``size - 1``
    rows before it. So a window task holds one block, not one key, and a key of any size is spread.
    """
    if block_rows < size:
        raise ValueError("a block must hold at least one whole window")
    numbered = row_ids(df, [key, *order], "_row", unique)
    block = F.floor(F.col("_row") / block_rows)
    last = F.pmod(F.col("_row"), F.lit(block_rows)) >= block_rows - (size - 1)
    homes = F.when(last, F.array(block, block + 1)).otherwise(F.array(block))
    spread = numbered.withColumn("_block", F.explode(homes))
    window = W.partitionBy("_block", quoted(key)).orderBy("_row").rowsBetween(-(size - 1), 0)
    averaged = spread.withColumn(name, F.avg(quoted(score)).over(window))
    return averaged.where(F.col("_block") == block).drop("_row", "_block")
