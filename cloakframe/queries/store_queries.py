"""Queries over the mapping store, time joins and streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators import asof, audit, store, unique
from cloakframe.operators.restore import restore_column
from cloakframe.plans.columns import mapping_rows, redact_column
from cloakframe.queries.base import ORACLE, OPTIONS, PROFILES, documents, query
from cloakframe.queries.text_queries import _REDACT_ALL_SQL
from cloakframe.sources import runs
from cloakframe.sources.sinks import write_redacted_column
from cloakframe.sources.tables import load_table, stage, work_folder
from cloakframe.streaming import store as store_stream
from cloakframe.streaming import streams

TTL = 6 * 3600


def micros(column: str):
    """Microseconds since 1970 of a zone-less timestamp, comparable across engines."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "events")


@query(
    "mapping_upsert",
    """SELECT CAST(user_id AS VARCHAR) AS mapping_id, event_type AS placeholder, arg_max(event_id, (ts, event_id)) AS original
FROM events GROUP BY user_id, event_type""",
)
def mapping_upsert(spark: SparkSession, folder: str) -> DataFrame:
    added = events(spark, folder).select(
        F.col("user_id").cast("string").alias("mapping_id"), F.col("event_type").alias("placeholder"),
        F.col("event_id").alias("original"), F.col("ts").alias("created_at"),
    )
    return store.latest_mappings(added, ["created_at", "original"]).select("mapping_id", "placeholder", "original")


def _access(spark: SparkSession, folder: str) -> DataFrame:
    log = events(spark, folder)
    created = log.where("event_type = 'signup'").select(F.col("user_id").alias("mapping_id"), F.col("ts").alias("created_at"))
    used = log.where("event_type = 'view'").select(F.col("user_id").alias("mapping_id"), F.col("ts").alias("accessed_at"))
    return store.last_access(created, used)


@query(
    "mapping_touch",
    """SELECT user_id AS mapping_id, epoch_us(max(ts)) AS last_access_us FROM events WHERE event_type IN ('signup', 'view')
AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY 1""",
)
def mapping_touch(spark: SparkSession, folder: str) -> DataFrame:
    return _access(spark, folder).select("mapping_id", micros("last_access").alias("last_access_us"))


@query(
    "mapping_lru",
    """SELECT event_type AS tenant, user_id AS mapping_id, epoch_us(t) AS last_access_us FROM (
SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t DESC, user_id) AS r FROM (
SELECT event_type, user_id, max(ts) AS t FROM events GROUP BY 1, 2)) WHERE r <= 100""",
)
def mapping_lru(spark: SparkSession, folder: str) -> DataFrame:
    access = events(spark, folder).groupBy(F.col("event_type").alias("tenant"), F.col("user_id").alias("mapping_id")).agg(
        F.max("ts").alias("last_access")
    )
    return store.keep_recent(access, OPTIONS.store_capacity, ["tenant"]).select(
        "tenant", "mapping_id", micros("last_access").alias("last_access_us")
    )


@query(
    "mapping_lru_large",
    """SELECT event_type AS tenant, event_id AS mapping_id FROM (
SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 1500""",
)
def mapping_lru_large(spark: SparkSession, folder: str) -> DataFrame:
    access = events(spark, folder).select(
        F.col("event_type").alias("tenant"), F.col("event_id").alias("mapping_id"), F.col("ts").alias("last_access")
    )
    return store.keep_recent(access, 1500, ["tenant"]).select("tenant", "mapping_id")


@query(
    "mapping_ttl",
    f"""SELECT event_id AS mapping_id, epoch_us(ts) AS created_us FROM events
WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL {7 * 86400} SECONDS""",
)
def mapping_ttl(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).where("event_type = 'signup'").select(F.col("event_id").alias("mapping_id"), F.col("ts").alias("created_at"))
    kept = store.unexpired(rows, F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'"), 7 * 86400)
    return kept.select("mapping_id", micros("created_at").alias("created_us"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    log = events(spark, folder)
    requests = log.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("request_id"))
    responses = log.where("event_type = 'click'")
    return asof.asof_latest(requests, responses, "user_id", "ts", "request_id", ["event_id"])


_ASOF = """SELECT r.event_id, r.user_id, q.event_id AS latest_id, r.ts, q.ts AS qts FROM
(SELECT * FROM events WHERE event_type = 'click') r ASOF LEFT JOIN
(SELECT * FROM events WHERE event_type = 'view') q ON r.user_id = q.user_id AND r.ts >= q.ts"""


@query("asof_latest_mapping", f"SELECT event_id, user_id, latest_id FROM ({_ASOF})")
def asof_latest_mapping(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).select("event_id", "user_id", "latest_id")


@query(
    "ttl_interval_join",
    f"SELECT event_id, user_id, latest_id FROM ({_ASOF}) WHERE ts <= qts + INTERVAL {TTL} SECONDS",
)
def ttl_interval_join(spark: SparkSession, folder: str) -> DataFrame:
    return asof.within_ttl(_answers(spark, folder), "ts", TTL).select("event_id", "user_id", "latest_id")


@query(
    "agg_store_growth",
    """SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_us, count(DISTINCT user_id) AS n_ids FROM events GROUP BY 1""",
)
def agg_store_growth(spark: SparkSession, folder: str) -> DataFrame:
    return audit.store_growth(events(spark, folder), "ts", "user_id", "1 day").select(
        micros("window_start").alias("window_us"), "n_ids"
    )


def _stored(spark: SparkSession, folder: str) -> str:
    """A store of two runs, texts in English and all others; both jobs are run twice, as after a failure."""
    out = work_folder(spark, "store-runs")
    docs = documents(spark, folder)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for run, part in (("english", docs.where(english)), ("others", docs.where(~english))) * 2:
        done = redact_column(part, "text", ["doc_id"], PROFILES, "bare", options=OPTIONS)
        write_redacted_column(done, "text", f"{out}/texts", f"{out}/mappings", OPTIONS, run=run)
    return out


@query("store_runs", ORACLE["mapping_rows"])
def store_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All mappings (M3) of a store of repeated jobs, after its runs became one."""
    out = _stored(spark, folder)
    runs.compact(spark, f"{out}/mappings", "compacted")
    rows = runs.read_runs(spark, f"{out}/mappings")
    return rows.select("mapping_id", "path", "placeholder", "entity_type", "original", "score", "source")


@query("store_restore", "SELECT doc_id, text AS restored FROM documents")
def store_restore(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and mappings read back from their runs and put together."""
    out = _stored(spark, folder)
    texts = runs.read_runs(spark, f"{out}/texts").select("doc_id", "mapping_id", "redacted")
    back = restore_column(texts, "redacted", runs.read_runs(spark, f"{out}/mappings"), ["doc_id"], options=OPTIONS)
    return back.select("doc_id", "restored")


SHORT = replace(OPTIONS, scope="global", token_hex=4)


@query("unique_tokens", "SELECT doc_id, text AS restored FROM documents")
def unique_tokens_query(spark: SparkSession, folder: str) -> DataFrame:
    """Texts whose tokens of four digits would clash, restored without their ids: each token has one value in the table."""
    done = redact_column(documents(spark, folder), "text", ["doc_id"], PROFILES, "bare", options=SHORT)
    settled = stage(unique.unique_tokens(done.drop("text"), SHORT), "settled")
    known = mapping_rows(settled, "text", options=SHORT)
    back = restore_column(
        settled.select("doc_id", "redacted"), "redacted", known, ["doc_id"], mapping_id=F.lit("unknown"), options=SHORT, any_mapping=True
    )
    return back.select("doc_id", "restored")


# -- streams --------------------------------------------------------------------------------


@query("stream_redact", _REDACT_ALL_SQL)
def stream_redact(spark: SparkSession, folder: str) -> DataFrame:
    out = work_folder(spark, "stream-redact")
    source = streams.table_stream(spark, folder, "documents")
    streams.redact_stream(
        source, "text", ["doc_id"], f"{out}/texts", f"{out}/mappings", f"{out}/checkpoint", OPTIONS,
        profiles=PROFILES, profile="bare",
    ).awaitTermination()
    return spark.read.parquet(f"{out}/texts").select("doc_id", "mapping_id", "redacted")


@query("stream_restore", "SELECT doc_id, text AS restored FROM documents")
def stream_restore(spark: SparkSession, folder: str) -> DataFrame:
    out = work_folder(spark, "stream-restore")
    streams.redact_stream(
        streams.table_stream(spark, folder, "documents"), "text", ["doc_id"], f"{out}/texts", f"{out}/mappings",
        f"{out}/redact-checkpoint", OPTIONS, profiles=PROFILES, profile="bare",
    ).awaitTermination()
    written = spark.read.parquet(f"{out}/texts")
    responses = spark.readStream.schema(written.schema).parquet(f"{out}/texts")
    streams.restore_stream(
        responses, "redacted", ["doc_id"], lambda: spark.read.parquet(f"{out}/mappings"), f"{out}/restored",
        f"{out}/unresolved", f"{out}/restore-checkpoint", OPTIONS,
    ).awaitTermination()
    return spark.read.parquet(f"{out}/restored").select("doc_id", "restored")


@query(
    "stream_ttl_join",
    """SELECT event_id AS mapping_id, event_type, epoch_us(ts) AS created_us FROM events
WHERE CAST(floor(value) AS BIGINT) * 60 <= 3600""",
)
def stream_ttl_join(spark: SparkSession, folder: str) -> DataFrame:
    out = work_folder(spark, "stream-ttl")
    log = streams.table_stream(spark, folder, "events")
    created = log.select(F.col("event_id").alias("mapping_id"), F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    asked = streams.table_stream(spark, folder, "events").select(
        F.col("event_id").alias("mapping_id"),
        (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).cast("timestamp").alias("asked_at"),
    )
    joined = streams.ttl_join(created, asked, "mapping_id", "created_at", "asked_at", 3600)
    streams.append_to(joined, f"{out}/joined", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/joined").select("mapping_id", "event_type", F.unix_micros("created_at").alias("created_us"))


@query(
    "stream_window_counts",
    """SELECT epoch_us(w) AS window_us, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type FROM events)
GROUP BY w, event_type""",
)
def stream_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = work_folder(spark, "stream-counts")
    log = streams.table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    run = streams.count_windows(log, "ts", "event_type", "1 hour", f"{out}/counts", f"{out}/checkpoint")
    run.awaitTermination()
    counts = streams.counted_windows(spark, f"{out}/counts", str(run.id))
    return counts.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n")


def _closing(log: DataFrame, days: int) -> DataFrame:
    """One row after all others, which moves the watermark past them."""
    return log.agg((F.max("ts") + F.make_dt_interval(F.lit(days))).alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), "ts", F.lit("closing").alias("event_type"), F.lit(0.0).alias("value")
    )


@query(
    "stream_unresolved",
    """SELECT event_id AS mapping_id, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 60000000 AS asked_us FROM events
WHERE CAST(floor(value) AS BIGINT) * 60 > 3600""",
)
def stream_unresolved(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that come more than an hour after their mapping."""
    out = work_folder(spark, "stream-unresolved")
    log = events(spark, folder).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    feed = f"{out}/events"
    log.write.parquet(feed)
    for days in (10, 20, 30):
        come = lambda: spark.readStream.schema(log.schema).parquet(feed)
        created = come().select(F.col("event_id").alias("mapping_id"), F.col("ts").alias("created_at"))
        asked = come().select(
            F.col("event_id").alias("mapping_id"), (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("asked_at")
        )
        lost = streams.unresolved_responses(created, asked, "mapping_id", "created_at", "asked_at", 3600)
        streams.append_to(lost, f"{out}/lost", f"{out}/checkpoint").awaitTermination()
        _closing(log, days).write.mode("append").parquet(feed)
    lost = spark.read.parquet(f"{out}/lost").where("mapping_id >= 0")
    return lost.select("mapping_id", F.unix_micros("asked_at").alias("asked_us"))


STORE_TTL = 5 * 86400


@query(
    "stream_bounded_store",
    f"""WITH a AS (SELECT event_type AS tenant, user_id, max(ts) AS last FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY epoch_us(last) // 1000 DESC, user_id) AS rank FROM a)
SELECT tenant, CAST(user_id AS VARCHAR) AS mapping_id, epoch_us(last) // 1000 AS last_access_ms FROM r
WHERE rank <= {OPTIONS.store_capacity} AND epoch_us(last) // 1000 + {STORE_TTL * 1000} > (SELECT epoch_us(max(ts)) // 1000 FROM events)""",
)
def stream_bounded_store(spark: SparkSession, folder: str) -> DataFrame:
    """What a store of limited capacity and age holds after all events."""
    out = work_folder(spark, "stream-store")
    log = events(spark, folder).select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    feed = f"{out}/events"
    log.write.parquet(feed)
    for _ in range(2):  # in the second run the watermark of the first one holds, and timers wake
        accesses = spark.readStream.schema(log.schema).parquet(feed)
        store_stream.keep_bounded(
            accesses, "event_type", "user_id", "ts", OPTIONS.store_capacity, STORE_TTL, f"{out}/ops", f"{out}/checkpoint"
        ).awaitTermination()
        last = log.agg(F.max("ts").alias("ts")).select(F.lit("-1").alias("user_id"), "ts", F.lit("closing").alias("event_type"))
        last.write.mode("append").parquet(feed)
    kept = store_stream.bounded_contents(spark, f"{out}/ops").where("tenant <> 'closing'")
    return kept.select("tenant", "mapping_id", F.unix_millis("last_access").alias("last_access_ms"))
