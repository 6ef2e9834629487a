"""Structured Streaming forms (ST1-ST5) of redaction, restoration, expiry and audit counts.

Every write of a micro-batch goes to that batch's own folder in overwrite mode, so a batch that
runs again after a failure replaces its own output. Tokens are deterministic, so it writes the
same tokens. Mappings are written before the text that needs them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.operators.restore import restore_column, unresolved_tokens
from cloakframe.options import Options
from cloakframe.plans.columns import mapping_rows, redact_column
from cloakframe.plans.payloads import payload_mapping_rows, redact_payload, restore_payload
from cloakframe.sources.payloads import parse_payloads, split_quarantine
from cloakframe.sources.sinks import write_redacted_column
from cloakframe.sources.tables import spread


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over one table in a folder, a file or a folder of files. The path is a glob, as Spark streams no plain
    path of a single file."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _each_batch(
    stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], trigger: dict | None
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _place(batch: DataFrame, batch_id: int) -> str:
    """A batch's folder name: the same when it runs again, another for a query with a new checkpoint."""
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    return f"{run}-{batch_id}"


def redact_stream(
    stream: DataFrame, text: str, keys: list[str], out: str, mappings_out: str, checkpoint: str,
    options: Options = Options(), trigger: dict | None = None, runs: bool = False, **redact,
) -> StreamingQuery:
    """Redact each micro-batch (ST1): mappings first, then the redacted rows without entities. With `runs` each batch is a
    run of the tables that batch jobs write (`sources.runs`), so both share one store."""

    def work(batch: DataFrame, batch_id: int) -> None:
        done = redact_column(spread(batch, *keys), text, keys, options=options, **redact)
        if runs:
            return write_redacted_column(done, text, out, mappings_out, options, run=_place(batch, batch_id))
        done = done.persist()
        try:
            if options.keep_mappings:
                mapping_rows(done, text, options=options).write.mode("overwrite").parquet(
                    f"{mappings_out}/batch_id={_place(batch, batch_id)}"
                )
            done.drop("entities", text).write.mode("overwrite").parquet(f"{out}/batch_id={_place(batch, batch_id)}")
        finally:
            done.unpersist()

    return _each_batch(stream, checkpoint, work, trigger)


def restore_stream(
    stream: DataFrame, text: str, keys: list[str], mappings: Callable[[], DataFrame], out: str,
    unresolved_out: str, checkpoint: str, options: Options = Options(), trigger: dict | None = None,
) -> StreamingQuery:
    """Restore each micro-batch against the mappings committed by then (ST2). Tokens nobody knows
    (expired or evicted) stay in the text and go to the unresolved sink (ST4)."""

    def work(batch: DataFrame, batch_id: int) -> None:
        known = mappings()
        unresolved_tokens(batch, keys, text, known, options).write.mode("overwrite").parquet(
            f"{unresolved_out}/batch_id={_place(batch, batch_id)}"
        )
        restore_column(batch, text, known, keys, options=options).write.mode("overwrite").parquet(
            f"{out}/batch_id={_place(batch, batch_id)}"
        )

    return _each_batch(stream, checkpoint, work, trigger)


def redact_payload_stream(
    stream: DataFrame, keys: list[str], body: str, schema: str, out: str, mappings_out: str, quarantine_out: str,
    checkpoint: str, options: Options = Options(), trigger: dict | None = None, **redact,
) -> StreamingQuery:
    """Redact JSON requests of a declared schema (ST1). Unreadable bodies go to the quarantine, never on."""

    def work(batch: DataFrame, batch_id: int) -> None:
        readable, refused = split_quarantine(batch, body, options.on_error)
        refused.write.mode("overwrite").parquet(f"{quarantine_out}/batch_id={_place(batch, batch_id)}")
        typed = parse_payloads(readable, body, schema, "_payload").select(*keys, "_payload.*")
        done = redact_payload(spread(typed, *keys), keys, options=options, **redact).persist()
        try:
            if options.keep_mappings:
                payload_mapping_rows(done, options=options).write.mode("overwrite").parquet(f"{mappings_out}/batch_id={_place(batch, batch_id)}")
            done.drop("entities").write.mode("overwrite").parquet(f"{out}/batch_id={_place(batch, batch_id)}")
        finally:
            done.unpersist()

    return _each_batch(stream, checkpoint, work, trigger)


def restore_payload_stream(
    stream: DataFrame, keys: list[str], mappings: Callable[[], DataFrame], out: str, checkpoint: str,
    options: Options = Options(), trigger: dict | None = None, **restore,
) -> StreamingQuery:
    """Restore typed payloads by the handle in their metadata (ST2)."""

    def work(batch: DataFrame, batch_id: int) -> None:
        done = restore_payload(batch, mappings(), keys, options=options, **restore)
        done.write.mode("overwrite").parquet(f"{out}/batch_id={_place(batch, batch_id)}")

    return _each_batch(stream, checkpoint, work, trigger)


def ttl_join(
    mappings: DataFrame, responses: DataFrame, on: str, created: str, asked: str, ttl_seconds: int,
    delay: str = "10 minutes", how: str = "inner",
) -> DataFrame:
    """Stream-stream join of responses with mappings not older than the ttl (ST3). Both sides carry a
    watermark, so state is bounded by ttl and delay; `left_outer` also gives the unresolved ones."""
    left = responses.withWatermark(asked, delay).alias("r")
    right = mappings.withColumnRenamed(on, "_on").withWatermark(created, delay).alias("m")
    in_time = (
        (F.col(f"r.{on}") == F.col("m._on"))
        & (F.col(f"r.{asked}") >= F.col(f"m.{created}"))
        & (F.col(f"r.{asked}") <= F.col(f"m.{created}") + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))
    )
    return left.join(right, in_time, how).drop("_on")


def window_counts(
    events: DataFrame, time: str, by: str, width: str, slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Counts per time window and type (ST5); works on streams and tables alike."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        events.withWatermark(time, delay)
        .groupBy(window.alias("_w"), by)
        .agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), by, "n")
    )


def session_counts(events: DataFrame, time: str, user: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Counts per user session (ST5)."""
    return (
        events.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("_w"), user)
        .agg(F.count("*").alias("n"))
        .select(user, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n")
    )


def append_to(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Exactly-once file sink."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def count_windows(
    events: DataFrame, time: str, by: str, width: str, out: str, checkpoint: str, slide: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Whole counts per time window and type (ST5) without state: each batch writes the counts of its own rows, however
    late they are, to a folder of its own, and `counted_windows` adds them up. A batch that runs again replaces its
    folder; a query with a new checkpoint is another run."""
    window = F.window(time, width, slide) if slide else F.window(time, width)

    def work(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(window.alias("_w"), by).agg(F.count("*").alias("n"))
        rows = counts.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), by, "n")
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        rows.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/run={run}/batch_id={batch_id}")

    return _each_batch(events, checkpoint, work, trigger)


def counted_windows(spark: SparkSession, out: str, run: str | None = None) -> DataFrame:
    """The counts of a run of `count_windows` (a query's id), by default of the one that wrote last."""
    written = spark.read.parquet(out)
    if run is None:
        last = written.groupBy("run").agg(F.max("written_at").alias("at")).orderBy(F.desc("at"), "run").first()
        run = last["run"] if last else ""
    rows = written.where(F.col("run") == run)
    keys = [c for c in rows.columns if c not in ("n", "run", "batch_id", "written_at")]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def unresolved_responses(
    mappings: DataFrame, responses: DataFrame, on: str, created: str, asked: str, ttl_seconds: int, delay: str = "10 minutes"
) -> DataFrame:
    """Responses whose mapping never came, or had expired (ST4): the outer side of the expiry join, which state
    eviction emits once the watermark has passed."""
    joined = ttl_join(mappings, responses, on, created, asked, ttl_seconds, delay, "left_outer")
    return joined.where(F.col(created).isNull()).select(*responses.columns)
