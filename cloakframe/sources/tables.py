"""Reading tables, and the folder for written intermediate results."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, folder: str, name: str, spread_by: str | None = None) -> DataFrame:
    """A parquet table. A table of fewer splits than cores is spread by `spread_by`; a table with
    enough splits stays where it lies, so large data is never shuffled just to be read."""
    df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    return spread(df, spread_by) if spread_by else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *columns)


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the shared folder the session names; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return os.path.join(shared, f"{label}-{uuid.uuid4().hex}")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=f"run-{label}-")


def broadcast_if_small(df: DataFrame, text: str, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Broadcast a lookup side only after measuring it; a larger one is left to a shuffle join."""
    bytes_held = df.agg(F.count("*") * 64 + F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return F.broadcast(df) if bytes_held <= max_bytes else df


#: Bytes of the Arrow batches of rows with texts and their hits. A batch is held several times over, by the executor and by
#: each of its workers, and Spark's own limits, 10,000 rows or 64 MB, let them take most of an executor's memory.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside get Arrow batches of about BATCH_BYTES."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stage(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write an intermediate result once and read it back: later steps neither recompute it nor
    depend on its lineage, and it survives lost executors. With `small` it is made in small Arrow batches."""
    folder = work_folder(df.sparkSession, label)
    with small_batches(df.sparkSession) if small else contextlib.nullcontext():
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
