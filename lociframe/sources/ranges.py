"""Binary files by byte ranges, and text files with line numbers, without a whole file in any task.

Spark's binary reader tells names and sizes; its rows hold whole files of 2 GB at most, so contents are not read through it.
Rows of (file, offset, length) are dealt to tasks instead, which open their file where it is (a shared mount,
or a store that pyarrow's file systems know) and read their range alone."""

from __future__ import annotations

from typing import BinaryIO

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import settled

#: Bytes of one range, about.
CHUNK = 32 << 20


def plain_name(path: Column, encoded: bool = False) -> Column:
    """A file's name in one form, however Spark spells it."""
    name = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return F.regexp_replace(name, "^file:/+", "/")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files at a path or glob; no content is read."""
    return spark.read.format("binaryFile").load(path).select(plain_name(F.col("path")).alias("file"), F.col("length"))


def open_file(name: str) -> BinaryIO:
    """A file that tasks read by ranges: seek and read."""
    if "://" not in name:
        return open(name.removeprefix("file:"), "rb")
    store, path = pyarrow.fs.FileSystem.from_uri(name)
    return store.open_input_file(path)


def spread(ranges: DataFrame) -> DataFrame:
    """A range a row, dealt evenly; as many tasks as there are cores, or ranges."""
    return ranges.repartition(ranges.sparkSession.sparkContext.defaultParallelism, *ranges.columns[:2])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, index, line) of the lines that are not blank, numbered from 0 in each file. Tasks read parts of files; what moves
    between them is the number of lines of each part."""
    rows = spark.read.text(path).select(plain_name(F.col("_metadata.file_path"), True).alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("line"))
    rows = settled(rows.where(F.trim("line") != "").withColumn("at", F.monotonically_increasing_id()))
    parts = rows.groupBy("file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    parts = parts.select("file", "part", (before - F.col("first")).alias("move"))
    return rows.join(parts, ["file", "part"]).select("file", (F.col("at") + F.col("move")).alias("index"), "line")
