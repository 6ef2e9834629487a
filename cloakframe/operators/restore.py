"""Putting originals back.

Tokens are looked up by an equi-join; only the rows that hold tokens take part, and only the
tokens of a row come back to it. The mappings side of each join is unique per key, so a token
that occurs in a third of all rows is one row there and AQE splits the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.text import substitute_tokens
from cloakframe.options import Options

UUID_PATTERN = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def has_token(text: Column, options: Options = Options()) -> Column:
    return F.coalesce(text.rlike(options.token_pattern), F.lit(False))


def tokens_in(text: Column, options: Options = Options()) -> Column:
    return F.regexp_extract_all(text, F.lit(options.token_pattern), F.lit(0))


def token_type(token: Column) -> Column:
    return F.regexp_extract(token, "^<([A-Z_]+)_[0-9a-f]+>$", 1)


def find_tokens(df: DataFrame, keys: list[str], text: str, options: Options = Options()) -> DataFrame:
    """One row per token occurrence: keys, ord, placeholder, entity_type (V1)."""
    return (
        df.where(has_token(F.col(text), options))
        .select(*keys, F.posexplode(tokens_in(F.col(text), options)).alias("ord", "placeholder"))
        .withColumn("entity_type", token_type(F.col("placeholder")))
    )


def first_created(mappings: DataFrame, by: list[str]) -> DataFrame:
    """The earliest original per key; a map-side combined aggregate, not a window."""
    order = F.struct(*[F.col(c) for c in ("created_at", "mapping_id", "path", "placeholder") if c in mappings.columns])
    return mappings.groupBy(*by).agg(F.min_by("original", order).alias("original"))


def ids_in_text(
    df: DataFrame, keys: list[str], text: str, mappings: DataFrame, pattern: str = UUID_PATTERN
) -> DataFrame:
    """(keys, mapping_id): the earliest known mapping id that stands in the text (V3)."""
    ids = mappings.groupBy("mapping_id").agg(F.min("created_at").alias("created_at"))
    seen = df.where(F.col(text).rlike(pattern)).select(
        *keys, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("mapping_id")
    )
    return (
        seen.join(ids, "mapping_id")
        .groupBy(*keys)
        .agg(F.min_by("mapping_id", F.struct("created_at", "mapping_id")).alias("mapping_id"))
    )


def asked_for(mappings: DataFrame, needed: DataFrame, by: list[str]) -> DataFrame:
    """The mapping rows that some row of `needed` asks for. Spark hands the smaller side's keys to the scan of the other
    one where that pays; what is aggregated and joined afterwards is as large as the question, not as the store."""
    return mappings.join(needed.select(*by).distinct(), by, "left_semi")


def resolve_tokens(
    needed: DataFrame,
    keys: list[str],
    mappings: DataFrame,
    any_mapping: bool = False,
    type_fallback: str = "off",
) -> DataFrame:
    """(keys, mapping_id, placeholder, original): originals for (keys, mapping_id, placeholder) rows.

    Scoped lookup first; `any_mapping` then asks all mappings (V5), `type_fallback="scoped"` last
    takes the first original of the same type of the same mapping (V6). Both are opt-in.
    """
    if type_fallback not in ("off", "scoped"):
        raise ValueError("type_fallback must be 'off' or 'scoped'")
    scoped = first_created(asked_for(mappings, needed, ["mapping_id", "placeholder"]), ["mapping_id", "placeholder"])
    found = needed.join(scoped, ["mapping_id", "placeholder"], "left")
    if any_mapping:
        anywhere = first_created(asked_for(mappings, needed, ["placeholder"]), ["placeholder"]).withColumnRenamed("original", "_any")
        found = found.join(anywhere, "placeholder", "left").withColumn(
            "original", F.coalesce("original", "_any")
        ).drop("_any")
    if type_fallback == "scoped":
        by_type = first_created(asked_for(mappings, needed, ["mapping_id"]), ["mapping_id", "entity_type"]).withColumnRenamed("original", "_type")
        found = (
            found.withColumn("entity_type", token_type(F.col("placeholder")))
            .join(by_type, ["mapping_id", "entity_type"], "left")
            .withColumn("original", F.coalesce("original", "_type"))
            .drop("_type", "entity_type")
        )
    return found.select(*keys, "mapping_id", "placeholder", "original")


def needed_tokens(
    df: DataFrame, keys: list[str], texts: list[Column], mapping_id: Column, options: Options
) -> DataFrame:
    """Distinct tokens per row, over all given text expressions."""
    found = F.array_distinct(F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in texts]))
    return df.select(
        *keys, mapping_id.alias("mapping_id"), F.explode(found).alias("placeholder")
    )


def restore_column(
    df: DataFrame,
    text: str,
    mappings: DataFrame,
    keys: list[str],
    mapping_id: Column | None = None,
    options: Options = Options(),
    any_mapping: bool = False,
    type_fallback: str = "off",
    to: str = "restored",
) -> DataFrame:
    """`df` with the restored text in `to` (V7). `keys` name a row; `mapping_id` is its scope
    (the column of that name by default). Unknown tokens stay in the text."""
    scope = F.coalesce(F.col("mapping_id") if mapping_id is None else mapping_id, F.lit(""))
    found = has_token(F.col(text), options)
    tagged = df.where(found).withColumn("_scope", scope)
    plain = df.where(~found).withColumn(to, F.col(text))
    needed = needed_tokens(tagged, keys, [tokens_in(F.col(text), options)], F.col("_scope"), options)
    known = known_tokens(needed, keys, mappings, any_mapping, type_fallback)
    restored = tagged.join(known, [*keys, "_scope"], "left").withColumn(
        to, F.expr(substitute_tokens(text, options.token_pattern, "_known"))
    )
    return plain.unionByName(restored.drop("_known", "_scope").select(*plain.columns))


def known_tokens(
    needed: DataFrame, keys: list[str], mappings: DataFrame, any_mapping: bool = False, type_fallback: str = "off"
) -> DataFrame:
    """(keys, _scope, _known): per row the originals of its own tokens, as a map. Copies of a row
    share one map: the set is combined map-side and holds no more than the row's tokens."""
    return (
        resolve_tokens(needed, keys, mappings, any_mapping, type_fallback)
        .where(F.col("original").isNotNull())
        .groupBy(*keys, F.col("mapping_id").alias("_scope"))
        .agg(F.map_from_entries(F.collect_set(F.struct("placeholder", "original"))).alias("_known"))
    )


def unresolved_tokens(
    df: DataFrame, keys: list[str], text: str, mappings: DataFrame, options: Options = Options()
) -> DataFrame:
    """(keys, mapping_id, placeholder) that no mapping of the row's scope knows."""
    tokens = find_tokens(df, [*keys, "mapping_id"], text, options).select(*keys, "mapping_id", "placeholder").distinct()
    return tokens.join(mappings.select("mapping_id", "placeholder"), ["mapping_id", "placeholder"], "left_anti").select(
        *keys, "mapping_id", "placeholder"
    )


def round_trip_failures(original: DataFrame, restored: DataFrame, keys: list[str], text: str, to: str) -> DataFrame:
    """Rows whose restored text is not the original (V9); empty when the round trip is exact."""
    left = original.select(*keys, F.col(text).alias("_original"))
    right = restored.select(*keys, F.col(to).alias("_restored"))
    return left.join(right, keys, "full").where(~F.col("_original").eqNullSafe(F.col("_restored"))).select(*keys)
