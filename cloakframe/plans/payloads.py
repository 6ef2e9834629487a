"""Public API over nested payloads: redact_payload, restore_payload (T9, V8) and their JSON twins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.sqltext import fn, keep, let, quote, struct, transform
from cloakframe.functions.text import substitute_tokens
from cloakframe.operators.detect import Detector
from cloakframe.operators.nested import (
    HANDLE,
    KEY_MARK,
    PATH_ENTITIES,
    annotate,
    gather,
    has_strings,
    json_leaf_rows,
    leaf_array,
    rebuild_json,
    rewrite,
    stamp_json,
    stamp_metadata,
    strip_json,
    strip_metadata,
    system_items,
)
from cloakframe.operators.redact import redact_candidates, redact_spans
from cloakframe.operators.restore import known_tokens, needed_tokens, restore_column
from cloakframe.operators.sweep import LEAVES, MANY, sweep_leaves
from cloakframe.operators.tokens import mapping_id, token_scope
from cloakframe.options import Options
from cloakframe.plans.columns import RowProfiles, TableProfiles, candidates_of, redact_column
from cloakframe.sources.payloads import split_quarantine
from cloakframe.sources.profile_tables import ProfileTables
from cloakframe.sources.profiles import ProfileSet
from cloakframe.sources.tables import stage


def redact_payload(
    df: DataFrame,
    keys: list[str],
    columns: list[str] | None = None,
    profiles: ProfileSet | ProfileTables | None = None,
    profile: str | None = None,
    options: Options = Options(),
    detectors: Iterable[Detector] | None = None,
    skip_system: bool = True,
    metadata: str = "metadata",
    profile_column: str | None = None,
    lang: str | None = None,
    extra: str | None = None,
    scope_keys: list[str] | None = None,
    first: str | None = None,
) -> DataFrame:
    """`df` with every string leaf of `columns` redacted in place, metadata stamped with the
    mapping id, and `entities` (ARRAY<path, placeholder, ...>). Narrow: no join, no shuffle.

    `profile_column` picks a profile per row, `lang` is a SQL expression of a row's language, and `extra` a column of
    candidates from gazetteers or models, which are looked for in every leaf of the row. `ProfileTables` are joined to the
    rows by `profile_column`; a profile's dictionary goes along with its rows here, whatever its size.
    Where a long `messages` list is cut into several rows, `scope_keys` name the document, whose rows share one mapping
    id and its tokens, and `first` is the column with the number of a row's first message, for paths.
    """
    profiles = profiles or ProfileSet(default=options.default_profile)
    chosen = None if detectors is None else list(detectors)
    walked = [c for c in (columns or df.columns) if c not in (*keys, profile_column, extra, first) and has_strings(df.schema[c].dataType)]
    scope = token_scope(options, "mapping_id", "{leaf}.path")

    source = df
    if isinstance(profiles, ProfileTables):
        if profile:
            raise ValueError("name the profiles of ProfileTables by profile_column")
        settings, source = TableProfiles(), profiles.attach(df, profile_column, options, fold_all=True)
    else:
        settings = RowProfiles(profile_column, profiles) if profile_column else profiles.resolve(profile)

    def found_in(x: str) -> str:
        found, _ = candidates_of(f"{x}.text", settings, options, chosen, lang, extra)
        return struct(key=f"{x}.key", path=f"{x}.path", text=f"{x}.text", scope=scope.format(leaf=x), found=found)

    spans_only = candidates_of("''", settings, options, chosen, lang, extra)[1]
    located = redact_spans if spans_only else redact_candidates
    swept = "false" if spans_only else "size({x}.found) > " + str(MANY)

    def redacted_leaf(x: str) -> str:
        done = located(options, f"{x}.text", f"{x}.scope", f"{x}.found")
        return let(done, lambda r: struct(key=f"{x}.key", path=f"{x}.path", text=f"{r}.text", entities=f"{r}.entities"))

    leaves = keep(transform(leaf_array(df.schema, walked, skip_system, first), found_in), lambda x: f"size({x}.found) > 0")
    staged = source.select("*", F.expr(mapping_id(options, *(scope_keys or keys))).alias("mapping_id")).withColumn("_leaves", F.expr(leaves))
    few = transform(keep("_leaves", lambda x: f"NOT ({swept.format(x=x)})"), redacted_leaf)
    if spans_only:
        staged = staged.withColumn("_hits", F.expr(few))
    else:
        large = keep("_leaves", lambda x: swept.format(x=x))
        staged = staged.withColumn("_swept", sweep_leaves(options, F.expr(f"CASE WHEN exists(_leaves, {fn(lambda x: swept.format(x=x))}) THEN {large} END")))
        hits = f"CASE WHEN _swept IS NULL THEN {few} ELSE concat({few}, cast(_swept AS {LEAVES})) END"
        staged = staged.withColumn("_hits", F.expr(hits))
    staged = staged.withColumn("_hits", F.expr(keep("_hits", lambda x: f"size({x}.entities) > 0"))).drop("_leaves", "_swept")
    changed = staged.withColumn(
        "_changed", F.expr(f"map_from_entries({transform('_hits', lambda h: struct(k=f'{h}.key', v=f'{h}.text'))})")
    )

    def rewritten(c: str) -> str:
        new = annotate(
            df.schema[c].dataType, f"`{c}`", quote(c),
            lambda text, key, _: f"coalesce(try_element_at(_changed, {key}), {text})",
            name=c, top=True, skip_system=False, mark=KEY_MARK, first=first if c == "messages" else None,
        )
        return f"CASE WHEN size(_hits) = 0 THEN `{c}` ELSE {new} END"

    def with_path(h: str) -> str:
        return transform(
            f"{h}.entities",
            lambda e: struct(
                path=f"{h}.path", placeholder=f"{e}.placeholder", entity_type=f"{e}.entity_type",
                original=f"{e}.original", score=f"{e}.score", source=f"{e}.source",
            ),
        )

    redacted = changed.select(
        *[F.expr(rewritten(c)).alias(c) if c in walked else F.col(c) for c in df.columns],
        "mapping_id",
        F.expr(f"cast(flatten({transform('_hits', with_path)}) AS {PATH_ENTITIES})").alias("entities"),
    )
    return stamp_metadata(redacted, "mapping_id", metadata)


def payload_mapping_rows(
    redacted: DataFrame, profile: str = "default", created_at: str | None = None, options: Options = Options()
) -> DataFrame:
    """Flat mapping rows of a redact_payload result, keyed by path."""
    stamp = F.expr(created_at or "current_timestamp()")
    rows = (
        redacted.select("mapping_id", stamp.alias("created_at"), F.explode_outer("entities").alias("e"))
        .where(F.col("e").isNotNull())
        .select(
            "mapping_id", "e.path", "e.placeholder", "e.entity_type", "e.original", "e.score", "e.source",
            F.lit(profile).alias("profile"), "created_at", F.col("created_at").alias("last_access"),
        )
    )
    return rows if options.keep_mappings else rows.limit(0)


def restore_payload(
    df: DataFrame,
    mappings: DataFrame,
    keys: list[str],
    columns: list[str] | None = None,
    options: Options = Options(),
    any_mapping: bool = False,
    type_fallback: str = "off",
    metadata: str = "metadata",
) -> DataFrame:
    """`df` with the originals back in every string leaf, those of metadata too, and the handle stripped."""
    walked = [
        c for c in {*(columns or df.columns), *({metadata} & {*df.columns})} if c not in keys and has_strings(df.schema[c].dataType)
    ]
    walked.sort(key=df.columns.index)
    pattern = quote(options.token_pattern)
    tokens = [
        F.expr(gather(df.schema[c].dataType, f"`{c}`", lambda x: f"regexp_extract_all({x}, {pattern}, 0)", "array<string>"))
        for c in walked
    ]
    handle = F.coalesce(F.col(f"{metadata}.privacy_mapping_id"), F.lit(""))
    staged = df.withColumn("_tokens", F.array_distinct(F.concat(*tokens))).withColumn("_scope", handle)
    tagged, plain = staged.where(F.size("_tokens") > 0), staged.where(F.size("_tokens") == 0)
    needed = needed_tokens(tagged, keys, [F.col("_tokens")], F.col("_scope"), options)
    joined = tagged.join(known_tokens(needed, keys, mappings, any_mapping, type_fallback), [*keys, "_scope"], "left")
    restored = joined.select(
        *[
            F.expr(
                rewrite(df.schema[c].dataType, f"`{c}`", lambda x: substitute_tokens(x, options.token_pattern, "_known"))
            ).alias(c)
            if c in walked
            else F.col(c)
            for c in df.columns
        ]
    )
    return strip_metadata(plain.drop("_tokens", "_scope").unionByName(restored), metadata)


def redact_json(
    df: DataFrame,
    keys: list[str],
    body: str,
    profiles: ProfileSet | ProfileTables | None = None,
    profile: str | None = None,
    options: Options = Options(),
    detectors: Iterable[Detector] | None = None,
    stamp: bool = False,
    profile_column: str | None = None,
    lang_column: str | None = None,
    extra: str | None = None,
    once: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with `redacted`, mapping entities per leaf, quarantine) for JSON text of any shape and depth.

    Bodies that are no JSON object go to the quarantine with a `reason` and never on; with on_error="raise" they fail
    the job. System items of a top-level `messages` list stay as they are. With `stamp` the mapping id is set in the
    body's own metadata. `profile_column`, `lang_column` and `extra` are columns of `df` with a row's profile, language and
    candidates from elsewhere, which hold for all its leaves. With `once` the changed leaves are written to the
    shared folder, for jobs that use both the documents and the entities. Declare a schema and use redact_payload where the shape is known: that needs no shuffle.
    """
    readable, refused = split_quarantine(df, body, options.on_error)
    along = list(dict.fromkeys(c for c in (profile_column, lang_column, extra) if c and c not in keys))
    leaves = json_leaf_rows(readable.withColumn("_system", F.expr(system_items(body))), [*keys, *along, "_system"], body)
    item = F.regexp_extract("path", r"^messages\[([0-9]+)\]\.", 1)
    scanned = leaves.where(~F.array_contains("_system", F.when(item != "", item.cast("int")).otherwise(F.lit(-1)))).drop("_system")
    done = redact_column(
        scanned, "text", keys, profiles, profile, profile_column, options, detectors, lang_column, extra, path_column="path"
    )
    # explode_outer keeps Spark from computing the redaction a second time in a filter
    one = F.when(~F.col("text").eqNullSafe(F.col("redacted")), F.array(F.struct("redacted", "entities")))
    changed = done.select(*keys, "mapping_id", "path", "address", F.explode_outer(one).alias("_c")).where(F.col("_c").isNotNull())
    changed = changed.select(*keys, "mapping_id", "path", "address", "_c.*")
    if once:
        changed = stage(changed, "json-leaves")
    out = rebuild_json(readable, keys, body, changed.select(*keys, "address", F.col("redacted").alias("text")), "redacted")
    if stamp:
        out = out.withColumn("redacted", stamp_json(F.col("redacted"), F.expr(mapping_id(options, *keys))))
    return out, changed.select(*keys, "mapping_id", "path", "entities"), refused


def restore_json(
    df: DataFrame, keys: list[str], body: str, mappings: DataFrame, options: Options = Options(), **how
) -> DataFrame:
    """`df` plus `restored`: the JSON text with the originals of its tokens back, written as JSON strings are, and
    without the handle in its metadata. Where `df` has no mapping_id, the handle is taken from the body."""
    if "mapping_id" not in df.columns and "mapping_id" not in how:
        how["mapping_id"] = F.get_json_object(body, f"$.metadata.{HANDLE}")
    written = F.to_json(F.struct(F.col("original").alias("o")))
    escaped = F.substring(written, F.lit(7), F.length(written) - 8)  # between {"o":" and "}
    done = restore_column(df, body, mappings.withColumn("original", escaped), keys, options=options, **how)
    to = how.get("to", "restored")
    stamped = F.col(to).contains(HANDLE)
    return done.withColumn(to, F.coalesce(strip_json(F.when(stamped, F.col(to))), F.col(to)))
