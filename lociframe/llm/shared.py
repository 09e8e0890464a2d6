"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where
    that is unset on one machine (as in tests), a fresh temporary folder. On a cluster an unset folder is an
    error, as executors could not read each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage like checkpoint(), but stays columnar and compressed, and the
    files outlive any executor. As with checkpoint(), the folder is for its owner to empty."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch where whole texts pass through Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From here on Arrow batches of this session have BATCH_ROWS rows at most, so that what a task holds of its texts, in the JVM and in
    Python, is a few MB. Neither plans nor results depend on it; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back(spark: SparkSession) -> None:
    """Have executors collect their garbage, a task a core, so that the heap which the work before has grown goes back to the machine and does not
    add up with what the next work takes beside it in Python. No result depends on it: an executor that gets no such task keeps its heap."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids of a side that may be broadcast: about 50 MB as a hashed relation.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs less the rows whose id is in ids; rows without an id stay. Few ids, counted, are broadcast, so that
    no text is moved; more are joined by shuffling."""
    drop = materialize(ids.select(id_col).distinct(), "ids")
    return docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, id_col, "left_anti").select(*docs.columns)


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, out: str) -> DataFrame:
    """Rows of docs that have a label of 0 or 1, with it as out. Few labels, counted, are broadcast, so
    that no text is moved; more are joined by shuffling. Of several labels of an id the least counts."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias(out)).where(F.col(out).isin(0, 1)).groupBy(id_col).agg(F.min(out).alias(out))
    return docs.join(F.broadcast(known) if labels.count() <= BROADCAST_ROWS else known, id_col)


#: Rows of one key that go into one group of a join, about.
HOT = 1000


def spread_join(rows: DataFrame, values: DataFrame, key: str, most: int = BROADCAST_ROWS // 10) -> DataFrame:
    """rows with the columns of values, one row a key, of their key; null without one. Few values, counted, are broadcast, so
    that no row is moved; else keys of more than HOT rows are split into parts of about that many."""
    values = materialize(values, "values")
    if values.count() <= most:
        return rows.join(F.broadcast(values), key, "left")
    hot = materialize(rows.groupBy(key).count().where(F.col("count") > HOT).select(key, F.ceil(F.col("count") / HOT).cast("int").alias("parts")), "hot")  # a key in HOT at most
    parts = F.coalesce("parts", F.lit(1))
    salted = rows.join(hot, key, "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("parts")
    spread = values.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return salted.join(spread, [key, "part"], "left").drop("part")
