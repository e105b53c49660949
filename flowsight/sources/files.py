"""File sources of flow data."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CORRUPT
from .scratch import path_exists

DATASET_FORMATS = ("csv", "json", "parquet")
NORMALIZED_NAME = "active_dataset_normalized.csv"
# Layouts of one folder, each a parse of its own in the plan; and files whose first lines are asked for side by side.
MOST_LAYOUTS = 100
HEADER_READERS = 32
LISTING_SCHEMA = "name string, path string, updated_at timestamp, size_bytes bigint, is_active boolean"


def read_flows_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headed CSV with every field as text, plus the raw text of rows that do not fit the header.

    Only an explicit schema with a corrupt-record column makes short and long rows visible, so the
    header is read first. Column pruning is off for the parse because a pruned parse skips the
    check; stage the canonical columns as Parquet to get pruning back for everything after. A file whose
    header differs from the first one's fails the read, so no column is taken for another.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .option("enforceSchema", False)
        .csv(path)
    )


def _first_line(spark: SparkSession, file: str) -> str | None:
    """First line of a file, unpacked where its suffix says so; None of an empty one. Only its first block is read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        plain = stream if codec is None else codec.createInputStream(stream)
        utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, utf8)).readLine()
    finally:
        stream.close()


def files_by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The files below ``path`` grouped by their first line; empty files are in no group.

    What is read is one line a file, by ``HEADER_READERS`` threads; the list of files is the one that Spark makes for a scan.
    """
    found = sorted(spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        lines = list(pool.map(inheritable_thread_target(spark)(lambda file: _first_line(spark, file)), found))
    groups: dict[str, list[str]] = defaultdict(list)
    for file, line in zip(found, lines, strict=True):
        if line is not None:
            groups[line.removeprefix("\ufeff").rstrip("\r")].append(file)
    if len(groups) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different headers below {path}")
    return list(groups.values())


def _pattern_of(spark: SparkSession, file: str) -> str:
    """A pattern that matches the file of this URI and nothing else."""
    jvm = spark.sparkContext._jvm
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).toString())


def read_flow_layouts(spark: SparkSession, path: str | list[str]) -> list[DataFrame]:
    """``read_flows_csv`` of each group of files that share a header, for folders that gather several exports.

    The columns of a group are its own; map each onto the canonical ones before uniting them, since one layout's ``src_ip`` may
    be another one's ``Source IP``. A folder with one header is read as a whole.
    """
    groups = files_by_header(spark, path)
    if len(groups) < 2:
        return [read_flows_csv(spark, path)]
    return [read_flows_csv(spark, [_pattern_of(spark, file) for file in group]) for group in groups]


def dataset_format(path: str) -> str:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in DATASET_FORMATS:
        raise ValueError(f"unsupported dataset format {suffix!r}; expected one of {', '.join(DATASET_FORMATS)}")
    return suffix


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV, JSON or Parquet by suffix. CSV stays text: ``cast_flows`` decides types, not a sampling pass.

    JSON is one record per line, which can be split; with ``multi_line`` every file is one array or record
    of its own. Rows that do not parse, such as those of an array file read by lines or of a CSV row that is short or
    long, come back with their text in the corrupt-record column (JSON has it only where there are such rows).
    """
    fmt = dataset_format(path) if fmt is None else fmt
    if fmt not in DATASET_FORMATS:
        raise ValueError(f"unsupported dataset format {fmt!r}; expected one of {', '.join(DATASET_FORMATS)}")
    if fmt == "csv":
        return read_flows_csv(spark, path)
    if fmt == "json":
        return spark.read.option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return spark.read.parquet(path)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str = "src_ip string", fmt: str = "parquet",
    merge_schema: bool = False,
) -> DataFrame:
    """A stored table; an empty one of ``schema`` where nothing has been written yet.

    ``merge_schema`` opens every file's footer; only tables whose runs differ, as quarantine, need it.
    """
    try:
        return spark.read.format(fmt).option("mergeSchema", merge_schema).load(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def list_datasets(
    spark: SparkSession, folders: Sequence[str], limit: int = 30, active: str | None = None
) -> DataFrame:
    """The newest dataset files of several folders: name, path, size, time, active or not.

    Only file listings are read; the content column is pruned away. Folders that do not exist are skipped.
    """
    present = [folder for folder in dict.fromkeys(folders) if path_exists(spark, folder)]
    if not present:
        return spark.createDataFrame([], LISTING_SCHEMA)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{csv,json,parquet}")
        .load(present)
        .select("path", "length", "modificationTime")
    )
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.dropDuplicates(["path"])
        .withColumn("name", name)
        .where(F.col("name") != NORMALIZED_NAME)
        .orderBy(F.desc("modificationTime"), "path")
        .limit(limit)
        .select(
            "name",
            "path",
            F.col("modificationTime").alias("updated_at"),
            F.col("length").alias("size_bytes"),
            (F.lit(False) if active is None else F.col("path").endswith(active)).alias("is_active"),
        )
    )
