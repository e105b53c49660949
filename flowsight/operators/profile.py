"""Dataset profiling: value counts, histograms, duplicates, gaps, ingest summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import is_blank
from ..schema import detect_profile, profile_columns, quoted
from .ranks import exact_quantiles, sorted_values


def top_values(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """The ``n`` commonest values, null as UNKNOWN; ties by name."""
    name = F.coalesce(quoted(column).cast("string"), F.lit("UNKNOWN")).alias("name")
    counted = df.select(name).groupBy("name").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "name").limit(n)


def top_k(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
    """The ``n`` largest rows by a measure, key as tie-break."""
    return df.orderBy(quoted(by).desc(), quoted(key)).limit(n)


def quantile_histogram(df: DataFrame, column: str, q: int = 5) -> DataFrame:
    """Equal-frequency bins of a numeric column: (bin, lower, upper, count), right-closed.

    Edges are exact, linearly interpolated quantiles; equal edges merge, the first bin includes the
    minimum, and a column with fewer than two distinct values gives no bins. With fewer than ``q``
    distinct values there are as many bins as values.
    """
    values = sorted_values(df, column)
    total, distinct = values.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    q = min(q, distinct)
    edges = sorted(set(exact_quantiles(values, [i / q for i in range(q + 1)], total))) if distinct > 1 else []
    if len(edges) < 2:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count bigint")
    # the bin of a value is the number of inner edges strictly below it
    number = sum((F.when(F.col("value") > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    counted = values.select(number.alias("bin"), "rows").groupBy("bin").agg(F.sum("rows").alias("count"))
    bounds = F.array(*[F.lit(e) for e in edges])
    return counted.select(
        "bin", F.get(bounds, F.col("bin")).alias("lower"), F.get(bounds, F.col("bin") + 1).alias("upper"), "count"
    )


def _digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the columns' values, nulls kept apart from texts; -0.0 counts as 0.0, as in a group."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    values = [(quoted(c) + F.lit(0.0) if c in floating else quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    return F.unhex(F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).cast("binary"), 256))


def _copies(df: DataFrame, keys: Sequence[str] = (), **counts: Column) -> DataFrame:
    """Distinct rows with their number of copies, folded per map task; only digests and ``counts`` are shuffled."""
    key = _digest(df, keys) if keys else F.lit(None).cast("binary")
    rows = df.select(_digest(df, df.columns).alias("_row"), key.alias("_key"), *[c.alias(n) for n, c in counts.items()])
    once = [F.first(n).alias(n) for n in ("_key", *counts)]  # the same in every copy of a row
    return rows.groupBy("_row").agg(F.count(F.lit(1)).alias("_copies"), *once)


def _known_keys(df: DataFrame, keys: Sequence[str] | None) -> list[str]:
    if keys is None:
        roles = profile_columns(df)
        keys = [c for c in (roles["key"], roles["key_date"]) if c]
    return [k for k in keys if k in df.columns]


def _extra() -> Column:
    return F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0))


def _key_extra(copies: DataFrame, keys: Sequence[str]) -> Column:
    """Rows beyond the first of each key, as a scalar over the counted distinct rows."""
    if not keys:
        return F.lit(0).cast("bigint")
    return copies.groupBy("_key").agg(F.sum("_copies").alias("_copies")).agg(_extra()).scalar()


def duplicate_stats(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each full row and of each key; keys that do not exist are ignored.

    Without ``keys`` the profile's own key columns are used. Key counts are taken from the counted
    distinct rows, so the table is grouped once.
    """
    keys = _known_keys(df, keys)
    copies = _copies(df, keys)
    return copies.agg(_extra().alias("duplicate_rows")).select("duplicate_rows", _key_extra(copies, keys).alias("duplicate_key_rows"))


def _gaps(df: DataFrame) -> Column:
    """Missing cells of a row; NaN counts as missing in floating columns."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    gaps = [(quoted(c).isNull() | F.isnan(quoted(c))) if c in floating else quoted(c).isNull() for c in df.columns]
    return sum((g.cast("int") for g in gaps), F.lit(0))


def missing_stats(df: DataFrame) -> DataFrame:
    """Missing cells and rows with at least one."""
    counted = df.select(_gaps(df).alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("missing_values_count"), F.count_if(F.col("n") > 0).alias("missing_row_count")
    )


def file_stats(df: DataFrame) -> DataFrame:
    """Rows, full-row duplicates and blank cells over all rows; ``sampled`` is always false."""
    blank = sum((is_blank(quoted(c)).cast("int") for c in df.columns), F.lit(0))
    return _copies(df, blank=blank).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_processed"),
        _extra().alias("duplicates_removed"),
        F.coalesce(F.sum(F.col("_copies") * F.col("blank")), F.lit(0)).alias("null_cells"),
        F.lit(False).alias("sampled"),
    )


def ingest_summary(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: message count, throughput figure, quarantined and duplicate rows, column family, top channels.

    All counts come from one aggregate of distinct rows. ``throughput_rps`` is a formula of the row count, no
    measurement. ``top_channels`` lists the commonest values of the channel column as ``name=count``.
    """
    keys = _known_keys(df, keys)
    copies = _copies(df, keys, gap=(_gaps(df) > 0).cast("int"))
    channel = profile_columns(df)["channel"]
    top = F.lit("")
    if channel:
        listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "name")))  # eight rows
        pairs = F.transform(listed, lambda p: F.concat(p["name"], F.lit("="), -p["order"]))
        top = top_values(df, channel).agg(F.array_join(pairs, ";")).scalar()
    counted = copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("message_count"),
        F.coalesce(F.sum(F.col("_copies") * F.col("gap")), F.lit(0)).alias("gaps"),
        _extra().alias("by_row"),
    )
    n, by_key = F.col("message_count"), F.col("by_key")
    return counted.withColumn("by_key", _key_extra(copies, keys)).select(
        "message_count",
        F.greatest(F.lit(1), F.floor(n / 10)).cast("double").alias("throughput_rps"),
        n.alias("rows_processed"),
        F.col("gaps").alias("quarantined_rows"),
        F.col("gaps").alias("missing_rows_corrected"),
        F.when(by_key > 0, by_key).otherwise(F.col("by_row")).alias("duplicates_removed"),
        F.lit("youtube" if detect_profile(df) == "youtube" else "generic").alias("profile"),
        top.alias("top_channels"),
    )


def profile_sections(df: DataFrame) -> dict[str, DataFrame]:
    """Every section the table has columns for, each as a DataFrame."""
    roles = profile_columns(df)
    sections = {"duplicates": duplicate_stats(df), "missing": missing_stats(df), "summary": ingest_summary(df)}
    for role, title in (("channel", "top_channels"), ("category", "top_categories"), ("country", "country_distribution")):
        if roles[role]:
            sections[title] = top_values(df, roles[role])
    if roles["views"]:
        sections["views_distribution"] = quantile_histogram(df, roles["views"])
    return sections
