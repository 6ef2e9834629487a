"""Custom dictionary matching (E13), for small and for large dictionaries.

`fold`: the values become a literal array inside the expression; no join, no shuffle.
`automaton`: the dictionary is cut into parts of at most PART_BYTES by the first characters of its values, and each
text is read once a part by an automaton, whatever the number of values and of their lengths. A dictionary of one part
goes to the tasks as it is and texts stay where they lie; beyond, each part meets the texts in several tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions.sqltext import empty, keep, quote, struct
from cloakframe.operators.automaton import find_by_part, find_with, hits_by_part
from cloakframe.options import PRIORITY
from cloakframe.schemas import CANDIDATES
from cloakframe.sources.profiles import DictionaryValue
from cloakframe.sources.tables import broadcast_if_small, stage

# Bytes of values that one automaton holds at most, and characters of a value that choose its part.
PART_BYTES = 2 << 20
PREFIX = 3
# Bytes of texts of one group that meet its values together; a task reads several such shares.
TEXT_BYTES = 4 << 20


def literal_dictionary(values: list[DictionaryValue]) -> str:
    rows = ", ".join(
        struct(
            priority=str(PRIORITY["exact"]), type_ord=str(v.type_ord), value_ord=str(v.value_ord),
            neg_score="-1.0D", entity_type=quote(v.entity_type), value=quote(v.value), source="'exact'",
        )
        for v in values
    )
    return f"cast(array({rows}) AS {CANDIDATES})"


def dictionary_candidates(text: str, values: list[DictionaryValue]) -> str:
    """SQL: the dictionary values that occur in the text (case-sensitive substring)."""
    if not values:
        return empty(CANDIDATES)
    return keep(literal_dictionary(values), lambda v: f"contains({text}, {v}.value)")


def dictionary_hits_join(leaves: DataFrame, keys: list[str], text: str, dictionary: DataFrame, part_bytes: int | None = None) -> DataFrame:
    """(keys, entity_type, type_ord, value, value_ord): every dictionary value inside every text, for
    dictionaries too large to fold. `dictionary` has entity_type, type_ord, value, value_ord."""
    known = dictionary.where(F.length("value") > 0)
    values = known.select("value").distinct()
    n_bytes = values.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    parts = max(1, -(-n_bytes // (part_bytes or PART_BYTES)))
    texts = leaves.select(*[F.col(k) for k in keys], F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    schema = T.StructType([*(texts.schema[k] for k in keys), T.StructField("value", T.StringType())])
    if parts == 1:
        found = texts.mapInArrow(find_with(sorted(r["value"] for r in values.collect()), keys, "_text"), schema)
    else:
        salts = max(1, -(-leaves.sparkSession.sparkContext.defaultParallelism // parts))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        salt = F.pmod(F.xxhash64(*keys, "_text"), F.lit(salts)).cast("int").alias("_salt")
        asked = texts.select("*", salt, F.lit(None).cast("string").alias("_value")).withColumn("_part", each(parts))
        part = F.pmod(F.xxhash64(F.left("value", F.lit(PREFIX))), F.lit(parts)).cast("int").alias("_part")
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in texts.schema]
        rows = asked.unionByName(values.select(*none, part, F.col("value").alias("_value")).withColumn("_salt", each(salts)))
        rows = rows.repartition(parts * salts, "_part", "_salt").sortWithinPartitions("_part", "_salt", F.col("_value").isNull())
        found = rows.mapInArrow(find_by_part(keys, "_text"), schema)
    return (
        found.join(broadcast_if_small(known, "value"), "value")
        .select(*keys, "entity_type", "type_ord", "value", "value_ord")
        .distinct()
    )


def group_hits_join(
    leaves: DataFrame, keys: list[str], text: str, dictionary: DataFrame, group: str,
    part_bytes: int = PART_BYTES, text_bytes: int = TEXT_BYTES,
) -> DataFrame:
    """As `dictionary_hits_join`, for texts that meet the values of their own group only, a column of both sides and one
    of `keys`. A group's values are cut into parts and its texts into shares by their measured bytes, so that neither
    a hot group nor one with a large dictionary stays in one task."""
    known = dictionary.where(F.length("value") > 0)
    values = known.select(group, "value").distinct()
    pieces = lambda n_bytes, limit: F.ceil(F.sum(F.octet_length(n_bytes)) / limit).cast("int")
    parts = values.groupBy(group).agg(pieces("value", part_bytes).alias("_parts"))
    texts = leaves.select(*keys, F.col(text).alias("_text")).where("_text <> ''")
    shares = texts.groupBy(group).agg(pieces("_text", text_bytes).alias("_shares"))
    sizes = broadcast_if_small(parts.join(shares, group), group)
    schema = T.StructType([*(texts.schema[k] for k in keys), T.StructField("value", T.StringType())])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = (
        texts.join(sizes, group)
        .withColumn("_salt", F.expr(f"cast(pmod(xxhash64({', '.join(keys)}, _text), _shares) AS int)"))
        .select(*keys, "_text", "_salt", F.lit(None).cast("string").alias("_value"), each("_parts").alias("_p"))
    )
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in texts.schema if f.name != group]
    part = F.expr("cast(pmod(xxhash64(value), _parts) AS int)").alias("_p")
    given = values.join(sizes, group).select(group, *none, part, F.col("value").alias("_value"), each("_shares").alias("_salt"))
    rows = asked.unionByName(given).withColumn("_part", F.concat_ws(":", "_p", group)).drop("_p")
    order = ["_part", "_salt", F.col("_value").isNull()]
    found = rows.repartition("_part", "_salt").sortWithinPartitions(*order).mapInArrow(find_by_part(keys, "_text"), schema)
    return found.join(known, [group, "value"]).select(*keys, "entity_type", "type_ord", "value", "value_ord").distinct()


HIT = "ARRAY<STRUCT<entity_type: STRING, type_ord: INT, value: STRING, value_ord: INT>>"
# A share's texts have so many times the bytes of its values at least: each share gets these, so that they stay in proportion.
SHARE_TIMES = 16


def with_group_hits(
    rows: DataFrame, text: str, dictionary: DataFrame, group: str, part_bytes: int = PART_BYTES, text_bytes: int = TEXT_BYTES
) -> DataFrame | None:
    """`rows` with `_hits`, the values of their own group in their texts: the rows meet the values whole, so that texts are
    shuffled once. None where a group's values need several parts or a column can't go through Arrow."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    known = dictionary.where(F.length("value") > 0)
    parts = known.groupBy(group).agg(F.sum(F.octet_length("value")).alias("_bytes"))
    if any("interval" in k or "variant" in k for k in kinds.values()) or not parts.where(F.col("_bytes") > part_bytes).isEmpty():
        return None
    totals = rows.groupBy(group).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("_total"))
    shares = F.expr(f"cast(greatest(ceil(_total / greatest({text_bytes}, {SHARE_TIMES} * _bytes)), 1) AS int)").alias("_shares")
    sizes = broadcast_if_small(stage(parts.join(totals, group).select(group, shares), "shares"), group)
    columns = rows.columns
    hashed = ", ".join(f"`{c}`" for c in columns if "map<" not in kinds[c])
    asked = rows.join(sizes, group).select(
        *columns, F.expr(f"cast(pmod(xxhash64({hashed}), _shares) AS int)").alias("_salt"), F.lit(None).cast(HIT).alias("_values")
    )
    value = F.struct("entity_type", F.col("type_ord").cast("int").alias("type_ord"), "value", F.col("value_ord").cast("int").alias("value_ord"))
    whole = known.groupBy(group).agg(F.sort_array(F.collect_list(value)).cast(HIT).alias("_values"))
    given = whole.join(sizes, group).select(
        *[F.col(group) if c == group else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns],
        F.explode(F.expr("sequence(0, _shares - 1)")).alias("_salt"), "_values",
    )
    met = asked.unionByName(given).withColumn("_part", F.col(group))
    met = met.repartition("_part", "_salt").sortWithinPartitions("_part", "_salt", F.col("_values").isNull())
    hit = pa.struct([("entity_type", pa.string()), ("type_ord", pa.int32()), ("value", pa.string()), ("value_ord", pa.int32())])
    schema = T.StructType([*rows.schema.fields, T.StructField("_hits", T.DataType.fromDDL(HIT))])
    return met.mapInArrow(hits_by_part(columns, text, hit), schema)
