"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(r"[^ \t-\r]+")

#: Stands for a null id where rows are joined or ordered.
NULL_ID = -(2**63)


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    if not text:
        return []
    found = text.split()
    # split() knows more kinds of white space; most texts have none of them
    if len(text) - len("".join(found)) == sum(map(text.count, " \n\t\r\x0b\x0c")):
        return found
    return _WORD.findall(text)


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two non-null columns that tell rows apart; rows with equal id and text count as one."""
    return [F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)).alias("k1"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k2")]


def staging_folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a folder of this machine only where all tasks run in the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="staged-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Bytes of the Arrow batches of rows with texts or sets. A batch is held several times over, in the executor and in its
#: worker, and Spark's own limits, 10,000 rows or 64 MB, let it grow to most of what a task needs.
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


def staged(df: DataFrame, small: bool = False) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read from there on; with `small` in small batches."""
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/staged-{uuid.uuid4().hex}"
    with small_batches(spark) if small else contextlib.nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freeing(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task function that gives freed memory back to the system, as idle workers share an executor's memory."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with a dot a field of a struct column."""
    top, _, field = name.partition(".")
    return pa.compute.struct_field(batch.column(top), field) if field else batch.column(top)


def slices(batches: Iterable[pa.RecordBatch], name: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one take about `limit` bytes, or are one row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `keys`; a table may hold several groups, one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        start = int(group_starts(batch, keys)[-2])  # the last group may go on in the next batch
        if held and any(held[-1].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First row of each group, and the number of rows."""
    change = np.zeros(table.num_rows - 1, dtype=bool)
    for k in keys:
        values = table[k].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[k].to_numpy()
        change |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


#: Rows of ids that are broadcast at most; larger tables of ids are shuffled.
BROADCAST_ROWS = 200_000


def if_small(ids: DataFrame) -> DataFrame:
    """The rows marked for broadcast if a count finds at most BROADCAST_ROWS of them."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
