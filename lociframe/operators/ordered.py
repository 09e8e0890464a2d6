"""Running sums and minima over one global order without one task for all rows.

A window without partitions puts every row in one task. Here rows are ranged into
blocks by their order key; each block is summed; the few block totals are accumulated
and joined back, and windows run inside the blocks. Blocks come from the data's own
quantiles, so they are of like size whatever the distribution; equal keys share one
block. How many blocks there are follows from the counted rows; few rows are one block, in one task,
without quantiles or totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block, about, and the most blocks.
BLOCK_ROWS, BLOCKS = 200_000, 512


def _tree(key: Column, cuts: list, low: int) -> Column:
    """The number of cuts under key, plus low: a search by halves, so generated code tests a few."""
    if not cuts:
        return F.lit(low)
    half = len(cuts) // 2
    return F.when(key > F.lit(cuts[half]), _tree(key, cuts[half + 1 :], low + half + 1)).otherwise(_tree(key, cuts[:half], low))


def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows in partitions by their keys, as many as hold about BLOCK_ROWS each, so that what a task sorts or sums does not grow with the
    input. Windows and aggregations by these keys need no other shuffle."""
    return rows.repartition(max(1, -(-rows.count() // BLOCK_ROWS)), *by)


def block_cuts(rows: DataFrame, key: str, rows_each: int | None = None) -> list:
    """The quantiles of key that part rows into blocks of about rows_each; none for so few."""
    blocks = min(BLOCKS, -(-rows.count() // (rows_each or BLOCK_ROWS)))
    if blocks <= 1:
        return []
    return sorted(set(rows.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], max(1000, 4 * blocks)).alias("cuts")).first()["cuts"] or []))


def blocked(rows: DataFrame, key: str, cuts: list | None = None) -> DataFrame:
    """rows with __block, the number of cuts (block_cuts) under key; null keys are block -1, or in the only one. Rows that have
    blocks keep them."""
    if "__block" in rows.columns:
        return rows
    cuts = block_cuts(rows, key) if cuts is None else cuts
    return rows.withColumn("__block", F.when(F.col(key).isNull(), -1).otherwise(_tree(F.col(key), cuts, 0)) if cuts else F.lit(0))


def running_sums(rows: DataFrame, key: str, order: list[Column | str], sums: dict[str, Column], descending: bool = False, cuts: list | None = None) -> DataFrame:
    """rows with, for each name, the sum of its column over all rows up to this one in order.

    order begins with key, or its descending. cuts: block_cuts of rows, if they are known."""
    cuts = block_cuts(rows, key) if cuts is None else cuts
    r = blocked(rows, key, cuts)
    for name, c in sums.items():
        r = r.withColumn(f"__v_{name}", c)
    w = Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not cuts:
        return r.select(*rows.columns, *(F.sum(f"__v_{n}").over(w).alias(n) for n in sums))
    totals = r.groupBy("__block").agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))
    first = F.desc("__block") if descending else F.asc("__block")
    before = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)  # over at most as many rows as blocks
    offsets = totals.select("__block", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums))
    out = r.join(F.broadcast(offsets), "__block")
    return out.select(*rows.columns, *((F.sum(f"__v_{n}").over(w) + F.col(f"__o_{n}")).alias(n) for n in sums))


def running_min_from_end(rows: DataFrame, key: str, order: list[str], value: Column, out: str, cuts: list | None = None) -> DataFrame:
    """rows with the least value over this and all later rows in order. Windows run from the end, as Spark goes through
    all that follows anew for each row of a frame that is open there."""
    cuts = block_cuts(rows, key) if cuts is None else cuts
    r = blocked(rows, key, cuts).withColumn("__v", value)
    w = Window.partitionBy("__block").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, 0)
    if not cuts:
        return r.select(*rows.columns, F.min("__v").over(w).alias(out))
    totals = r.groupBy("__block").agg(F.min("__v").alias("__t"))
    later = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__block", F.min("__t").over(later).alias("__o"))
    return r.join(F.broadcast(offsets), "__block").select(*rows.columns, F.least(F.min("__v").over(w), "__o").alias(out))


def carried(rows: DataFrame, on: list[str], block: str, totals: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """rows joined with what the blocks of their keys before theirs come to. totals: one value a key and block,
    by aggregation; over: from these, aggregations over the blocks before (null for the first). Windows run
    over one row a block only, and the join has the keys that windows inside blocks need."""
    sums = rows.groupBy(*on, block).agg(*(c.alias(n) for n, c in totals.items()))
    before = Window.partitionBy(*on).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums.select(*on, block, *(c.over(before).alias(n) for n, c in over.items())), [*on, block])


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new temporary folder on one machine;
    on a cluster that is an error, as executors could not read each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that the plan of a loop of rounds stays short and
    a lost executor costs one round at most."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
