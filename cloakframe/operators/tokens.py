"""Deterministic placeholders and mapping ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.sqltext import let, quote
from cloakframe.options import Options


def mint_token(options: Options, scope: str, entity_type: str, value: str, again: int = 0) -> str:
    """<TYPE_hex> from a salted hash, so a recomputed task mints the same token."""
    tail = f", '{again}'" if again else ""
    digest = f"sha2(concat_ws('|', {quote(options.secret)}, {scope}, {entity_type}, {value}{tail}), 256)"
    return f"concat('<', {entity_type}, '_', left({digest}, {options.digits(again)}), '>')"


def mapping_id(options: Options, *keys: str) -> str:
    """A UUID-shaped id from a salted hash of the document's key; never uuid(), which is redrawn on retry."""
    cast = ", ".join(f"cast({k} AS string)" for k in keys)
    bounds = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return let(
        f"sha2(concat_ws('|', {quote(options.secret)}, {cast}), 256)",
        lambda h: f"concat_ws('-', {', '.join(f'substr({h}, {a}, {n})' for a, n in bounds)})",
    )


def token_scope(options: Options, doc_mapping_id: str, path: str) -> str:
    """The scope a token is minted in; `path` is a SQL expression."""
    if options.scope == "global":
        return "''"
    if options.scope == "leaf":
        return f"concat_ws('|', {doc_mapping_id}, {path})"
    return doc_mapping_id


def token_collisions(mappings: DataFrame) -> DataFrame:
    """Placeholders that stand for more than one original inside their mapping."""
    return (
        mappings.groupBy("mapping_id", "placeholder")
        .agg(F.min("original").alias("_lo"), F.max("original").alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select("mapping_id", "placeholder")
    )
