"""Binary filesets written by the tasks themselves: each partition writes one complete fileset of its own into a
folder that driver and executors share, so nothing passes through the driver."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import chromosome_order


#: Variants that are Python values at a time.
SLICE = 64


def local(path: str) -> str:
    """A path that open() takes: a shared mount, with or without file://."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"binary parts need a folder that tasks can open: {path}")
    return path.removeprefix("file://")


def write_parts(variants: DataFrame, folder: str, write: Callable[[str, Iterator[dict]], None]) -> list[tuple[str, int]]:
    """(name, variants) of each part: variants in order of chromosome and position, each partition's handed to
    write(stem, rows) as a stream, a slice of rows in memory at a time; a part that a task writes again, after a failure, replaces the first."""
    target = local(folder)
    os.makedirs(target, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}"
        count = 0

        def rows() -> Iterator[dict]:
            nonlocal count
            for batch in chain([first], filled):
                for s in range(0, batch.num_rows, SLICE):
                    for r in batch.slice(s, SLICE).to_pylist():
                        count += 1
                        yield r

        filled = (b for b in batches if b.num_rows)
        first = next(filled, None)
        if first is not None:
            trial = os.path.join(target, f".{name}-{TaskContext.get().taskAttemptId()}")
            os.makedirs(trial, exist_ok=True)
            write(os.path.join(trial, name), rows())
            for file in os.listdir(trial):
                os.replace(os.path.join(trial, file), os.path.join(target, file))
            os.rmdir(trial)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], names=["name", "n"])

    o = chromosome_order(F.col("chrom").cast("string"))
    cols = [F.col("chrom").cast("string").alias("chrom"), F.col("pos").cast("long").alias("pos"), F.col("id").cast("string").alias("id"), "ref", "alt", F.col("dosages").cast("array<double>").alias("dosages")]
    ordered = variants.select(*cols, o.alias("o")).repartitionByRange("o", "pos").sortWithinPartitions("o", "pos").drop("o")
    return sorted((r["name"], r["n"]) for r in ordered.mapInArrow(run, "name string, n long").collect())  # one row a part
