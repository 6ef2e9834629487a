"""The durable mapping store (M1-M6, W4, S6): append, latest wins, access log, capacity, expiry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.sources.tables import stage

# Up to here Spark cuts each map task's rows per tenant before the shuffle (window group limit).
GROUP_LIMIT = 1000


def append_mappings(rows: DataFrame, path: str) -> None:
    """Append mapping rows, partitioned by day of creation."""
    rows.withColumn("created_date", F.to_date("created_at")).write.mode("append").partitionBy("created_date").parquet(path)


def read_mappings(spark: SparkSession, path: str, since=None) -> DataFrame:
    """All mappings (M3), or those created since a date: whole day folders are skipped."""
    rows = spark.read.parquet(path)
    return rows if since is None else rows.where(F.col("created_date") >= F.lit(since).cast("date"))


def latest_mappings(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per (mapping_id, placeholder), the latest by `order` (M1); map-side combined."""
    keys = ["mapping_id", "placeholder"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in rest]
    )


def get_mapping(rows: DataFrame, mapping_id: str) -> DataFrame:
    return rows.where(F.col("mapping_id") == mapping_id)


def last_access(created: DataFrame, accesses: DataFrame) -> DataFrame:
    """(mapping_id, last_access): creation or the latest logged access, whichever is later (M2).
    Accesses of ids that were never stored do not count."""
    added = created.groupBy("mapping_id").agg(F.max("created_at").alias("created_at"))
    touched = accesses.groupBy("mapping_id").agg(F.max("accessed_at").alias("accessed_at"))
    return added.join(touched, "mapping_id", "left").select(
        "mapping_id", F.greatest("created_at", "accessed_at").alias("last_access")
    )


def keep_recent(access: DataFrame, capacity: int, tenant: list[str] | None = None, tie: str = "mapping_id") -> DataFrame:
    """The `capacity` most recently used ids per tenant (M4). `access` is one row per id with
    `last_access`; ties go to the smaller id.

    Small capacities use Spark's per-task group limit, so a tenant with a third of all ids sends
    only `capacity` rows per task. Large ones count ids per second first and keep whole seconds that fit. The second
    that the limit falls into may hold very many ids, so it is dealt by ranges of time and id: whole ranges that fit are
    kept, and ranks are counted only inside the one range that is cut.
    """
    tenant = tenant or []
    order = [F.col("last_access").desc(), F.col(tie)]
    if capacity <= GROUP_LIMIT:
        if not tenant:
            return access.orderBy(*order).limit(capacity)
        ranked = access.withColumn("_rank", F.row_number().over(Window.partitionBy(*tenant).orderBy(*order)))
        return ranked.where(F.col("_rank") <= capacity).drop("_rank")
    by = tenant or ["_all"]
    rows = (access if tenant else access.withColumn("_all", F.lit(0))).withColumn(
        "_second", F.date_trunc("second", "last_access")
    )
    counts = rows.groupBy(*by, "_second").agg(F.count("*").alias("_n"))
    newest_first = Window.partitionBy(*by).orderBy(F.col("_second").desc())
    room = counts.withColumn("_room", F.lit(capacity) - F.sum("_n").over(newest_first) + F.col("_n")).where("_room > 0")
    joined = rows.join(room, [*by, "_second"])
    whole = joined.where(F.col("_n") <= F.col("_room"))
    part = joined.where(F.col("_n") > F.col("_room")).drop("_n")
    ranges = part.repartitionByRange(*[F.col(c) for c in by], F.col("last_access").desc(), F.col(tie))
    ranged = stage(ranges.withColumn("_range", F.spark_partition_id()), "eviction")
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.first("_room").alias("_most"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")
    left = sizes.withColumn("_left", F.col("_most") - before).where("_left > 0").select(*by, "_range", "_n", "_left")
    cut = ranged.join(left, [*by, "_range"])
    within = Window.partitionBy(*by, "_range").orderBy(*order)
    last = cut.where("_n > _left").withColumn("_rank", F.row_number().over(within)).where("_rank <= _left")
    kept = [whole, cut.where("_n <= _left"), last]
    return reduce(DataFrame.unionByName, [k.select(*access.columns) for k in kept])


def unexpired(rows: DataFrame, as_of: Column, ttl_seconds: int, created: str = "created_at") -> DataFrame:
    """Rows created within the ttl before `as_of` (M5)."""
    return rows.where(F.col(created) >= as_of - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))


def drop_evicted(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Mapping rows whose request is still kept: eviction is by request, never by leaf."""
    return rows.join(kept.select("mapping_id"), "mapping_id", "left_semi")
