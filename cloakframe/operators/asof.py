"""As-of lookup and expiry by time.

Requests and the instants asked for are first reduced to one row per (session, instant). The
running "latest so far" is then taken inside (session, bucket) and carried from bucket to bucket,
so no task ever holds a whole session: a bucket holds at most its width in microseconds of
distinct instants, a session at most its time span divided by the width of buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_latest(
    requests: DataFrame,
    responses: DataFrame,
    session: str,
    time: str,
    request_id: str,
    keep: list[str],
    bucket: str = "minute",
    to: str = "latest_id",
) -> DataFrame:
    """responses (session, time, keep) with the latest request at or before them, and its time.

    Several requests at one instant: the largest id counts. Without a request both are null.
    """
    added = requests.groupBy(session, time).agg(F.max(request_id).alias(to))
    asked = responses.select(session, time).distinct()
    points = (
        added.select(session, time, F.struct(F.col(time).alias("_at"), F.col(to).alias("_id")).alias("_hit"), F.lit(False).alias("_ask"))
        .unionByName(
            asked.select(session, time, F.lit(None).cast(_hit_type(added, time, to)).alias("_hit"), F.lit(True).alias("_ask"))
        )
        .withColumn("_bucket", F.date_trunc(bucket, time))
    )
    inside = Window.partitionBy(session, "_bucket").orderBy(F.col(time), F.col("_ask")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = points.withColumn("_seen", F.last("_hit", ignorenulls=True).over(inside)).where("_ask")
    per_bucket = added.groupBy(session, F.date_trunc(bucket, time).alias("_bucket")).agg(
        F.max(F.struct(F.col(time).alias("_at"), F.col(to).alias("_id"))).alias("_end")
    )
    buckets = local.select(session, "_bucket").distinct().join(per_bucket, [session, "_bucket"], "full")
    before = Window.partitionBy(session).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).select(
        session, "_bucket", "_carry"
    )
    answers = local.join(carried, [session, "_bucket"], "left").select(
        session, time, F.coalesce("_seen", "_carry").alias("_hit")
    )
    return (
        responses.select(session, time, *keep)
        .join(answers, [session, time], "left")
        .select(session, time, *keep, F.col("_hit._id").alias(to), F.col("_hit._at").alias(f"{to}_at"))
    )


def _hit_type(added: DataFrame, time: str, request_id: str) -> str:
    types = dict(added.dtypes)
    return f"struct<_at: {types[time]}, _id: {types[request_id]}>"


def within_ttl(answers: DataFrame, time: str, ttl_seconds: int, to: str = "latest_id") -> DataFrame:
    """Responses whose latest request is not older than the ttl (J8): one row each, no pairs."""
    return answers.where(F.col(time) <= F.col(f"{to}_at") + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))
