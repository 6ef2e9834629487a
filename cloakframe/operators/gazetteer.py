"""Names, places and groups from a table (E8): word windows joined to the gazetteer on the words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.sqltext import quote
from cloakframe.functions.text import running_starts, shifted
from cloakframe.options import PRIORITY
from cloakframe.sources.tables import broadcast_if_small

# Fixed value: what separates words here; ASCII only, so every engine reads it alike.
WORD = "[^ \\t\\r\\n.,;:!?()\"<>]+"


def word_windows(leaves: DataFrame, keys: list[str], text: str, max_words: int) -> DataFrame:
    """(keys, start, value): windows of words that single blanks separate.

    Words, gaps and starts are zipped with themselves, shifted, so each word's row holds the
    next ones and the windows are built in generated code.
    """
    split = leaves.where(F.col(text).isNotNull()).select(
        *keys,
        F.expr(f"regexp_extract_all({text}, {quote(WORD)}, 0)").alias("_m"),
        F.expr(f"split({text}, {quote(WORD)}, -1)").alias("_g"),
    )
    located = split.withColumn("_s", F.expr(running_starts("_g", "_m")))
    ahead = [f"{shifted('_m', k)} AS _m{k}" for k in range(max_words)] + [
        f"{shifted('_g', k)} AS _g{k}" for k in range(1, max_words)
    ]
    names = ["_s", *[f"_m{k}" for k in range(max_words)], *[f"_g{k}" for k in range(1, max_words)]]
    rows = located.select(*keys, "_s", *[F.expr(a) for a in ahead]).select(*keys, F.inline(F.arrays_zip(*names)))
    cases = []
    for n in range(1, max_words + 1):
        parts = ", ".join(f"_m{k}" for k in range(n))
        blanks = " AND ".join([f"_m{n - 1} IS NOT NULL", *[f"_g{k} = ' '" for k in range(1, n)]])
        cases.append(f"CASE WHEN {blanks} THEN concat_ws(' ', {parts}) END")
    return rows.select(*keys, F.col("_s").alias("start"), F.expr(f"stack({max_words}, {', '.join(cases)}) AS (value)")).where(
        "value IS NOT NULL"
    )


def gazetteer_spans(
    leaves: DataFrame, keys: list[str], text: str, gazetteer: DataFrame, max_words: int = 3
) -> DataFrame:
    """(keys, span fields) from a gazetteer (entity_type, value, score), whose values are unique.
    It is broadcast when its measured size allows, else both sides are hashed on the value."""
    one = gazetteer.groupBy("value").agg(F.max(F.struct("score", "entity_type")).alias("_g")).select(
        "value", "_g.score", "_g.entity_type"
    )
    windows = word_windows(leaves, keys, text, max_words)
    return windows.join(broadcast_if_small(one, "value"), "value").select(
        *keys,
        "entity_type",
        "start",
        (F.col("start") + F.length("value")).alias("end"),
        "value",
        "score",
        F.lit("gazetteer").alias("source"),
        F.lit(PRIORITY["gazetteer"]).alias("priority"),
        F.lit(0).alias("type_ord"),
        F.lit(0).alias("value_ord"),
    )


def span_candidates(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, candidates): span rows from joins or models as extra candidates for redact_column.
    Values are made distinct first, so a value that recurs in a leaf travels once."""
    one = F.struct(
        "priority", "type_ord", "value_ord", (-F.col("score")).alias("neg_score"), "entity_type", "value", "source"
    )
    return (
        spans.groupBy(*keys, "entity_type", "value")
        .agg(
            F.min("priority").alias("priority"), F.min("type_ord").alias("type_ord"),
            F.min("value_ord").alias("value_ord"), F.max("score").alias("score"), F.min("source").alias("source"),
        )
        .groupBy(*keys)
        .agg(F.collect_list(one).alias("candidates"))
    )
