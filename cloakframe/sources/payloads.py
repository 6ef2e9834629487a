"""JSON payload sources (S1, S5, S7) and their error policy (F1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Turn numbers per row: bounds the array that a row holds. A conversation may have any number of rows.
MAX_TURNS = 64

MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"
PAYLOAD = f"STRUCT<messages: {MESSAGES}>"


def read_payload_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with a declared schema; no inference pass over the data."""
    return spark.read.schema(schema).json(path)


def parse_payloads(df: DataFrame, body: str, schema: str, to: str = "payload") -> DataFrame:
    """Parse a JSON text column with a declared schema; an unreadable body gives null fields."""
    return df.withColumn(to, F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"}))


def is_object(body: Column) -> Column:
    """A payload's top level must be a JSON object."""
    return F.coalesce(
        F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False)
    )


def split_quarantine(df: DataFrame, body: str, on_error: str = "closed") -> tuple[DataFrame, DataFrame]:
    """(readable, quarantine). Fail-closed: an unreadable body never goes on; `raise` fails the job."""
    if on_error == "raise":
        good = F.when(is_object(F.col(body)), F.col(body)).otherwise(
            F.raise_error(F.lit("payload is not a JSON object")).cast("string")
        )
        return df.withColumn(body, good), df.limit(0).withColumn("reason", F.lit(""))
    readable = is_object(F.col(body))
    reason = (
        F.when(F.col(body).isNull(), "missing")
        .when(F.try_parse_json(F.col(body)).isNull(), "invalid_json")
        .otherwise("not_an_object")
    )
    return df.where(readable), df.where(~readable).withColumn("reason", reason)


def payloads_from_turns(
    turns: DataFrame, conversation: str, turn: str, role: str, content: str, max_turns: int = MAX_TURNS
) -> DataFrame:
    """(conversation, chunk, first, messages): turns in order, at most `max_turns` turn numbers a row; `first` is the
    number of a row's first message in the whole conversation, so paths and scopes are those of the conversation."""
    chunk = F.floor(F.col(turn) / max_turns).cast("long")
    before = Window.partitionBy(conversation).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return (
        turns.groupBy(conversation, chunk.alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct(turn, role, content))).alias("_turns"))
        .select(
            conversation,
            "chunk",
            F.coalesce(F.sum(F.size("_turns")).over(before), F.lit(0)).cast("long").alias("first"),
            F.transform(
                "_turns", lambda t: F.struct(t[role].alias("role"), t[content].alias("content"))
            ).alias("messages"),
        )
    )
