"""Tables written by runs: a job or a micro-batch that runs again adds no row.

A run writes its rows to a folder of its own and then one row to the table's log. Readers see the runs in the log only,
so a run that was lost halfway shows nothing, and when it starts again it replaces what it left. A run that stands in
the log is not written again. A run's name belongs to one job at a time.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_NAME = re.compile(r"^[A-Za-z0-9_.-]{1,150}$")
LOG = "run string, committed_at timestamp, replaces array<string>"


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """(run, committed_at, replaces) of every committed run; no rows where nothing was committed yet."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def is_committed(spark: SparkSession, path: str, run: str) -> bool:
    return run_log(spark, path).where(F.col("run") == run).limit(1).count() > 0


def write_rows(df: DataFrame, path: str, run: str) -> None:
    """Write a run's rows, which nobody sees before `commit_run`; rows that the same run left before are replaced."""
    if not RUN_NAME.match(run):
        raise ValueError(f"a run's name is 1 to 150 letters, digits, '_', '.' and '-': {run!r}")
    # the prefix keeps names such as 001 strings when Spark reads them from the folder
    df.write.mode("overwrite").parquet(f"{path}/rows/run=r-{run}")


def commit_run(spark: SparkSession, path: str, run: str, replaces: list[str] | None = None) -> None:
    """Make a run's rows visible, and those of the runs it replaces invisible, in one step: one file of the log."""
    row = spark.range(1).select(
        F.lit(run).alias("run"), F.current_timestamp().alias("committed_at"),
        F.array(*[F.lit(r) for r in replaces or []]).cast("array<string>").alias("replaces"),
    )
    if not is_committed(spark, path, run):
        row.coalesce(1).write.mode("append").parquet(f"{path}/log")


def write_run(df: DataFrame, path: str, run: str) -> bool:
    """Write and commit a run; False when it was committed before and nothing was done."""
    if is_committed(df.sparkSession, path, run):
        return False
    write_rows(df, path, run)
    commit_run(df.sparkSession, path, run)
    return True


def live_runs(spark: SparkSession, path: str, as_of=None) -> DataFrame:
    """(run): committed runs that no other one replaced, now or at the time `as_of`."""
    log = run_log(spark, path)
    if as_of is not None:
        log = log.where(F.col("committed_at") <= F.lit(as_of).cast("timestamp"))
    gone = log.select(F.explode("replaces").alias("run"))
    return log.select("run").distinct().join(gone, "run", "left_anti")


def read_runs(spark: SparkSession, path: str, as_of=None) -> DataFrame:
    """The rows of all live runs, without the run's name. The join is on the partition column, so Spark skips the folders
    of other runs. Reading a table without any committed run is an error, as reading a missing folder is."""
    live = live_runs(spark, path, as_of).select(F.concat(F.lit("r-"), "run").alias("run"))
    return spark.read.parquet(f"{path}/rows").join(live, "run", "left_semi").drop("run")


def compact(spark: SparkSession, path: str, run: str, partitions: int | None = None) -> bool:
    """Rewrite the rows of all live runs as one run, which replaces them. Earlier snapshots stay readable; folders of
    replaced runs may be deleted once nobody reads those. Only one compaction of a table may run at a time.
    False when the run was committed before, or there is nothing to replace."""
    if is_committed(spark, path, run):
        return False
    # names of runs since the last compaction: metadata, one short string a run
    runs = [r["run"] for r in live_runs(spark, path).orderBy("run").collect()]
    if not runs:
        return False
    rows = spark.read.parquet(f"{path}/rows").where(F.col("run").isin([f"r-{r}" for r in runs])).drop("run")
    write_rows(rows.coalesce(partitions) if partitions else rows, path, run)
    commit_run(spark, path, run, runs)
    return True
