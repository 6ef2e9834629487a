"""The bounded mapping store as keyed state of a stream (ST6): capacity and expiry per tenant."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUT = "tenant string, mapping_id string, last_ms long, op string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BoundedStore(StatefulProcessor):
    """Per tenant the ids in use with their last access, in milliseconds; never more than `capacity` stay. A timer at
    the first expiry wakes the tenant."""

    def __init__(self, capacity: int, ttl_seconds: int):
        self.capacity, self.ttl = capacity, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "id string", "at long")

    def _settle(self, tenant: str, held: dict[str, int], before: dict[str, int], now: int) -> Iterator[pd.DataFrame]:
        """Evicts, stores what changed, and tells of it."""
        kept = {i: at for i, at in held.items() if at + self.ttl > now}
        kept = dict(sorted(kept.items(), key=lambda x: (-x[1], _order(x[0])))[: self.capacity])
        gone = [i for i in {**before, **held} if i not in kept]
        put = [i for i, at in kept.items() if before.get(i) != at]
        for i in put:
            self.ids.updateValue((i,), (kept[i],))
        for i in gone:
            if i in before:
                self.ids.removeKey((i,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.handle.registerTimer(min(kept.values()) + self.ttl)
        rows = [(tenant, i, held[i], "put") for i in put] + [(tenant, i, held.get(i, before.get(i)), "gone") for i in gone]
        if rows:
            yield pd.DataFrame(rows, columns=["tenant", "mapping_id", "last_ms", "op"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.ids.iterator()}
        held = dict(before)
        for batch in rows:
            for i, at in zip(batch["mapping_id"], batch["at_ms"], strict=True):
                held[i] = max(held.get(i, int(at)), int(at))
        yield from self._settle(key[0], held, before, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.ids.iterator()}
        yield from self._settle(key[0], dict(before), before, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _order(i: str) -> tuple:
    """Numbers by size, before all other ids."""
    return (0, int(i), "") if i.lstrip("-").isdigit() else (1, 0, i)


def keep_bounded(
    accesses: DataFrame, tenant: str, mapping_id: str, at: str, capacity: int, ttl_seconds: int, out: str, checkpoint: str,
    delay: str = "0 seconds", trigger: dict | None = None,
) -> StreamingQuery:
    """Writes what is put into each tenant's store and what leaves it; `bounded_contents` reads the store from there.

    State is bounded by capacity. Accesses later than `delay` are dropped by the watermark.
    """
    spark = accesses.sparkSession
    rows = accesses.select(
        F.col(tenant).cast("string").alias("tenant"), F.col(mapping_id).cast("string").alias("mapping_id"),
        F.col(at).cast("timestamp").alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"),
    )
    ops = rows.withWatermark("at", delay).groupBy("tenant").transformWithStateInPandas(
        BoundedStore(capacity, ttl_seconds), OUT, "Append", "EventTime"
    )

    def work(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("last_access", F.timestamp_millis("last_ms")).drop("last_ms")
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # the query keeps the setting it is started with
    try:
        return (
            ops.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def bounded_contents(spark: SparkSession, out: str) -> DataFrame:
    """(tenant, mapping_id, last_access) of what is in the store after the last batch."""
    last = F.max_by(F.struct("op", "last_access"), F.struct("batch_id", "last_access", F.col("op") == "gone"))
    ops = spark.read.parquet(out).groupBy("tenant", "mapping_id").agg(last.alias("o"))
    return ops.where("o.op = 'put'").select("tenant", "mapping_id", "o.last_access")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
