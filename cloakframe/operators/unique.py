"""Tokens that stand for one value each in their whole scope.

A token is a short salted hash, so in a large scope two values may share one. Values that lose theirs are minted again
with a counter, round by round, until nobody shares. Each round is an aggregate and two joins; the smallest value of those
that share a token keeps it, so the same rows always get the same tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.sqltext import transform
from cloakframe.functions.text import substitute_tokens
from cloakframe.operators.tokens import mint_token, token_scope
from cloakframe.options import Options
from cloakframe.schemas import ENTITIES
from cloakframe.sources.tables import stage

VALUE = ["_scope", "entity_type", "original"]
TOKEN = ["_scope", "placeholder"]
ROUNDS = 64


def _minted(options: Options, again: int):
    return F.expr(mint_token(options, "_scope", "entity_type", "original", again))


def settle_tokens(values: DataFrame, options: Options, known: DataFrame | None = None) -> DataFrame:
    """(_scope, entity_type, original, placeholder): one token for each distinct value of `values` (VALUE columns), no two
    of a scope alike. Values that `known` (the same four columns) holds keep their token, and nobody else gets it."""
    waiting, held = values.select(*VALUE).distinct(), None
    if known is not None:
        held = stage(known.groupBy(*VALUE).agg(F.min("placeholder").alias("placeholder")), "known-tokens")
        waiting = waiting.join(held, VALUE, "left_anti")
    waiting = stage(waiting, "waiting-values")
    for again in range(ROUNDS):
        tried = waiting.withColumn("placeholder", _minted(options, again))
        if held is not None:
            # few wait after the first round: held tokens are cut to those that are tried before the anti-join
            taken = held.select(*TOKEN).join(tried.select(*TOKEN), TOKEN, "left_semi")
            tried = tried.join(taken, TOKEN, "left_anti")
        first = tried.groupBy(*TOKEN).agg(F.min(F.struct("entity_type", "original")).alias("v"))
        won = stage(first.select("_scope", "v.entity_type", "v.original", "placeholder"), "settled-tokens")
        held = won if held is None else held.unionByName(won)
        waiting = stage(waiting.join(won, VALUE, "left_anti"), "waiting-values")
        if waiting.isEmpty():
            return held
    raise ValueError(f"a scope holds too many values for tokens of {options.token_hex} digits: raise Options.token_hex")


def unique_tokens(redacted: DataFrame, options: Options = Options(), known: DataFrame | None = None) -> DataFrame:
    """A `redact_column` result whose tokens tell all values of a document (or, with global scope, of the whole table)
    apart. With leaf scope they do already.

    `known` are mapping rows of earlier runs, which keep their tokens: pass the store's where a global scope grows by runs.
    Rows, their order of columns and texts without entities stay as they are; null and empty texts have no entities.
    """
    if options.scope == "leaf":
        return redacted
    scope = F.expr(token_scope(options, "mapping_id", "''")).alias("_scope")
    rows = stage(redacted.withColumn("_row", F.monotonically_increasing_id()), "unsettled")
    found = rows.select("_row", scope, F.inline("entities")).select("_row", *VALUE, "placeholder")
    earlier = None if known is None else known.select(scope, "entity_type", "original", "placeholder")
    settled = settle_tokens(found, options, earlier).withColumnRenamed("placeholder", "_new")
    # most entities hold the token of the first attempt, and most values keep it: neither meets the other's table
    usual = found.withColumn("_usual", _minted(options, 0))
    moved_values = settled.where(F.col("_new") != _minted(options, 0))
    moved = usual.where("placeholder = _usual").join(moved_values, VALUE).unionByName(
        usual.where("placeholder <> _usual").join(settled, VALUE).where("placeholder <> _new")
    )
    # a row's own tokens differ already, so its map has one entry for each of them
    maps = moved.groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("placeholder", "_new"))).alias("_moved"))
    text = f"CASE WHEN _moved IS NULL THEN redacted ELSE {substitute_tokens('redacted', options.token_pattern, '_moved')} END"

    def renamed(e: str) -> str:
        rest = ", ".join(f"'{f}', {e}.{f}" for f in ("entity_type", "original", "score", "source"))
        return f"named_struct('placeholder', coalesce(try_element_at(_moved, {e}.placeholder), {e}.placeholder), {rest})"

    entities = f"CASE WHEN _moved IS NULL THEN entities ELSE cast({transform('entities', renamed)} AS {ENTITIES}) END"
    done = rows.join(maps, "_row", "left").withColumns({"redacted": F.expr(text), "entities": F.expr(entities)})
    return done.select(*redacted.columns)
