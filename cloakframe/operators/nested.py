"""Nested payloads (N1-N10): typed walks generated from the schema, and JSON of unknown shape.

Typed payloads are rewritten in place: the walk becomes one expression, so nothing is exploded,
shuffled or put back together. JSON of unknown shape is exploded level by level as Variant.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions.sqltext import empty, fn, let, quote, struct, transform
from cloakframe.schemas import ENTITIES

PATH_ENTITY = "STRUCT<path: STRING, " + ENTITIES[len("ARRAY<STRUCT<") : -1]
PATH_ENTITIES = f"ARRAY<{PATH_ENTITY}>"
LEAVES = "ARRAY<STRUCT<key: STRING, path: STRING, text: STRING>>"

LeafBody = Callable[[str, str, str], str]  # (text, path, skipped) -> SQL


def _is_messages(path_is_top: bool, name: str, dtype: T.DataType) -> bool:
    """The list whose system-role items are left alone: a top-level `messages` of objects with a role."""
    return (
        path_is_top
        and name == "messages"
        and isinstance(dtype, T.ArrayType)
        and isinstance(dtype.elementType, T.StructType)
        and "role" in dtype.elementType.names
    )


def has_strings(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.StructType):
        return any(has_strings(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return has_strings(dtype.elementType)
    return isinstance(dtype, T.MapType) and has_strings(dtype.valueType)


# Between the keys of a leaf's internal key: unlike a dot, it cannot make a key "a.b" meet a nested a -> b.
KEY_MARK = "\x01"


def annotate(
    dtype: T.DataType, ref: str, path: str, body: LeafBody, skipped: str = "false",
    name: str = "", top: bool = False, skip_system: bool = True, mark: str = ".", first: str | None = None,
) -> str:
    """A value of the same shape in which every string leaf became body(text, path, skipped).
    `mark` stands between the keys of a path; `first` is the number of a list's first item, 0 if not given."""
    if isinstance(dtype, T.StringType):
        return body(ref, path, skipped)
    if not has_strings(dtype):
        return ref
    if isinstance(dtype, T.StructType):
        parts = []
        for f in dtype.fields:
            inner = annotate(
                f.dataType, f"{ref}.`{f.name}`", f"concat({path}, {quote(mark + f.name)})", body, skipped,
                f.name, False, skip_system, mark,
            )
            parts.append(f"{quote(f.name)}, {inner}")
        return f"CASE WHEN {ref} IS NOT NULL THEN named_struct({', '.join(parts)}) END"
    if isinstance(dtype, T.ArrayType):
        system = skip_system and _is_messages(top, name, dtype)

        def item(x: str, i: str) -> str:
            skip = f"({skipped} OR coalesce({x}.role = 'system', false))" if system else skipped
            number = i if first is None else f"{i} + {first}"
            return annotate(
                dtype.elementType, x, f"concat({path}, '[', {number}, ']')", body, skip, "", False, skip_system, mark
            )

        return transform(ref, item, 2)

    def entry(k: str, w: str) -> str:
        return annotate(dtype.valueType, w, f"concat({path}, {quote(mark)}, {k})", body, skipped, "", False, skip_system, mark)

    return f"transform_values({ref}, {fn(entry, 2)})"


def gather(dtype: T.DataType, ref: str, leaf: Callable[[str], str], array_type: str) -> str:
    """Concatenate leaf(ref) arrays over all string leaves, in document order."""
    if isinstance(dtype, T.StringType):
        return f"coalesce({leaf(ref)}, {empty(array_type)})"
    if isinstance(dtype, T.StructType):
        parts = [gather(f.dataType, f"{ref}.`{f.name}`", leaf, array_type) for f in dtype.fields if has_strings(f.dataType)]
        return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]
    if isinstance(dtype, T.ArrayType):
        inner = transform(ref, lambda x: gather(dtype.elementType, x, leaf, array_type))
        return f"coalesce(flatten({inner}), {empty(array_type)})"
    inner = transform(f"map_values({ref})", lambda x: gather(dtype.valueType, x, leaf, array_type))
    return f"coalesce(flatten({inner}), {empty(array_type)})"


def rewrite(dtype: T.DataType, ref: str, leaf: Callable[[str], str]) -> str:
    """A value of the same shape in which every string leaf became leaf(ref)."""
    return annotate(dtype, ref, "''", lambda text, _path, _skip: leaf(text), skip_system=False)


def leaf_array(schema: T.StructType, columns: list[str], skip_system: bool, first: str | None = None) -> str:
    """SQL for LEAVES: key, path and text of every string leaf of the columns (N1, N3, N4); with
    `skip_system` without the system items of a top-level `messages` list (N5)."""
    parts = []
    for c in columns:
        dtype = schema[c].dataType
        if not has_strings(dtype):
            continue

        def mark_leaf(text: str, path: str, skip: str) -> str:
            return struct(key=path, text=text, skipped=skip)

        def leaf(x: str) -> str:
            row = struct(key=f"{x}.key", path=f"replace({x}.key, {quote(KEY_MARK)}, '.')", text=f"{x}.text")
            return f"CASE WHEN NOT {x}.skipped AND {x}.text IS NOT NULL THEN array({row}) END"

        marked = annotate(
            dtype, f"`{c}`", quote(c), mark_leaf, name=c, top=True, skip_system=skip_system, mark=KEY_MARK,
            first=first if c == "messages" else None,
        )
        parts.append(let(marked, lambda m, d=dtype: gather(d, m, leaf, LEAVES)))
    return f"concat({', '.join(parts)})" if parts else empty(LEAVES)


def typed_leaves(
    df: DataFrame, keys: list[str], columns: list[str], skip_system: bool = False, first: str | None = None
) -> DataFrame:
    """(keys, path, text): one row per string leaf of typed columns; `first`: a column with the number of the first
    item of `messages`, where a list is cut into several rows."""
    return (
        df.select(*keys, F.expr(leaf_array(df.schema, columns, skip_system, first)).alias("_leaves"))
        .select(*keys, F.explode_outer("_leaves").alias("_l"))
        .where(F.col("_l").isNotNull())
        .select(*keys, "_l.path", "_l.text")
    )


# Before a list position in a leaf's address; KEY_MARK stands before a key.
ITEM_MARK = "\x02"
# The kind of a node that is nested deeper than the walk goes.
DEEPER = "DEEPER"


def variant_nodes(df: DataFrame, keys: list[str], body: str, max_depth: int = 8, fail_deeper: bool = True) -> DataFrame:
    """(keys, path, address, kind, node): every scalar of a JSON text column of any shape.

    One pass: at each level objects and arrays explode and finished leaves stay. `path` is for reading; `address` tells
    a key "a.b" from a nested a -> b. A document deeper than `max_depth` fails the job, or shows as a DEEPER node.
    """
    spark = df.sparkSession
    level = df.select(*keys, F.lit("").alias("path"), F.lit("").alias("address"), F.try_parse_json(body).alias("node"))
    for depth in range(max_depth + 1):
        kind = F.schema_of_variant("node")
        if depth == max_depth:
            deeper = kind.rlike("^(?:OBJECT<.*[A-Z]|ARRAY<(?!VOID>))")
            if fail_deeper:
                kind = F.when(deeper, F.raise_error(F.lit("JSON deeper than max_depth")).cast("string")).otherwise(kind)
            else:
                kind = F.when(deeper, F.lit(DEEPER)).otherwise(kind)
            break
        inner = F.when(kind.rlike("^(?:OBJECT|ARRAY)<"), F.col("node"))
        step = level.withColumn("_inner", inner).lateralJoin(spark.tvf.variant_explode_outer(F.col("_inner").outer()))
        found, pos = F.col("pos").isNotNull(), F.col("pos").cast("string")
        prefix = F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(F.lit(""))
        child = F.when(F.col("key").isNotNull(), F.concat(prefix, "key")).otherwise(F.concat("path", F.lit("["), pos, F.lit("]")))
        place = F.when(F.col("key").isNotNull(), F.concat("address", F.lit(KEY_MARK), "key")).otherwise(
            F.concat("address", F.lit(ITEM_MARK), pos)
        )
        level = step.select(
            *keys,
            F.when(found, child).otherwise(F.col("path")).alias("path"),
            F.when(found, place).otherwise(F.col("address")).alias("address"),
            F.when(found, F.col("value")).otherwise(F.col("node")).alias("node"),
        )
    return level.select(*keys, "path", "address", kind.alias("kind"), "node")


def variant_leaves(df: DataFrame, keys: list[str], body: str, max_depth: int = 8) -> DataFrame:
    """(keys, path, text): string leaves of JSON of unknown shape."""
    nodes = variant_nodes(df, keys, body, max_depth)
    return nodes.where(F.col("kind") == "STRING").select(
        *keys, "path", F.variant_get("node", "$", "string").alias("text")
    )


def system_items(body: str) -> str:
    """SQL for ARRAY<INT>: positions of system-role items in the top-level `messages` list of a JSON text."""
    items = f"try_variant_get(try_parse_json({body}), '$.messages', 'array<variant>')"
    found = transform(items, lambda m, i: f"CASE WHEN try_variant_get({m}, '$.role', 'string') = 'system' THEN {i} END", 2)
    return f"coalesce(filter({found}, p_ -> p_ IS NOT NULL), {empty('array<int>')})"


_JSON_PART = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],:]|[^\s{}\[\],:"]+|\s+')


def json_parts(body: str) -> Iterator[tuple[str, str | None]]:
    """The parts of a JSON text as they are written, with the address of each string leaf; of any depth."""
    places: list[list] = []  # of each open container: the address before it, the key or position in it
    at, key_next = "", False
    for part in _JSON_PART.findall(body):
        leaf = None
        if part in "{[":
            places.append([at, None if part == "{" else 0])
            key_next = part == "{"
            at = at if part == "{" else f"{at}{ITEM_MARK}0"
        elif part in "}]":
            at = places.pop()[0]
            key_next = False
        elif part == ",":
            place = places[-1]
            if place[1] is None:
                key_next = True
            else:
                place[1] += 1
                at = f"{place[0]}{ITEM_MARK}{place[1]}"
        elif part[0] == '"':
            if key_next:
                at, key_next = f"{places[-1][0]}{KEY_MARK}{json.loads(part)}", False
            else:
                leaf = at
        yield part, leaf


def with_new_leaves(body: str, new: dict[str, str]) -> str:
    """The JSON text with string leaves replaced by address; all else stays as it is written."""
    return "".join(json.dumps(new[at], ensure_ascii=False) if at in new else part for part, at in json_parts(body))


def readable_path(address: str) -> str:
    """`a.b[0]` for an address."""
    return re.sub(f"{ITEM_MARK}([0-9]+)", r"[\1]", address).replace(KEY_MARK, ".").removeprefix(".")


# Characters of JSON text that are worked on at once: a whole Arrow batch would be held many times over.
PIECE = 1 << 22


def in_pieces(columns: tuple[pd.Series, ...], one: Callable) -> Iterator[pd.Series]:
    """`one` of each row of an Arrow batch, in pieces of about PIECE characters of the first column."""
    out, held = [], 0
    for row in zip(*columns, strict=True):
        out.append(one(*row))
        held += len(row[0] or "")
        if held >= PIECE:
            yield pd.Series(out, dtype=object)
            out, held = [], 0
    if out or not len(columns[0]):
        yield pd.Series(out, dtype=object)


_LEAF = T.StructType([T.StructField(n, T.StringType()) for n in ("address", "path", "text")])


@F.pandas_udf(T.ArrayType(_LEAF))
def json_leaves(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Address, path and text of every string leaf of JSON texts, however deep they are nested."""

    def one(text: str | None) -> list[dict] | None:
        if text is None:
            return None
        found = [(at, json.loads(part)) for part, at in json_parts(text) if at is not None]
        whole = lambda t: t.encode("utf-8", "replace").decode() if not t.isascii() else t
        return [{"address": whole(at), "path": whole(readable_path(at)), "text": whole(t)} for at, t in found]

    for body in bodies:
        yield from in_pieces((body,), one)


def json_leaf_rows(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """(keys, path, address, text): string leaves of JSON of any shape and depth, in one pass over each text."""
    rows = df.select(*keys, F.explode_outer(json_leaves(F.col(body))).alias("_l")).where(F.col("_l").isNotNull())
    return rows.select(*keys, "_l.path", "_l.address", "_l.text")


HANDLE = "privacy_mapping_id"


def _split_handle(body: str) -> tuple[list[str], int | None, int | None]:
    """The parts of a JSON object without the handle in its top-level `metadata`, the place behind the brace of that
    object, and the place of the last brace; None where there is none."""
    parts, inside, depth, key_next = [], None, 0, False
    keys: dict[int, str] = {}
    for part in _JSON_PART.findall(body):
        if part in "{[":
            depth += 1
            key_next = part == "{"
            parts.append(part)
            if part == "{" and depth == 2 and keys.get(1) == "metadata":
                inside = len(parts)
            continue
        if part in "}]":
            depth -= 1
            key_next = False
        elif part == ",":
            key_next = True
        elif part[0] == '"' and key_next:
            keys[depth], key_next = json.loads(part), False
        parts.append(part)
    return parts, inside, len(parts) - 1 - next(i for i, p in enumerate(reversed(parts)) if p == "}")


def top_values(body: str) -> list[str]:
    """Addresses of the top-level values of a JSON object that are no objects."""
    depth, out = 0, []
    parts = [p for p in _JSON_PART.findall(body) if p.strip()]
    for i, part in enumerate(parts):
        if depth == 1 and part == ":":
            if parts[i + 1] != "{":
                out.append(f"{KEY_MARK}{json.loads(parts[i - 1])}")
        depth += (part in "{[") - (part in "}]")
    return out


def with_handle(body: str, handle: str) -> str:
    """The JSON object with metadata.privacy_mapping_id set, in its own `metadata` where that is an object."""
    parts, inside, last = _split_handle(without_handle(body))
    pair = f'"{HANDLE}":{json.dumps(handle)}'
    if inside is None and f"{KEY_MARK}metadata" in top_values(body):
        return body  # a metadata that is no object stays as it is
    if inside is not None:
        rest = next(p for p in parts[inside:] if p.strip())
        return "".join([*parts[:inside], pair, *([] if rest == "}" else [","]), *parts[inside:]])
    before = next((p for p in reversed(parts[:last]) if p.strip()), "{")
    return "".join([*parts[:last], *([] if before == "{" else [","]), f'"metadata":{{{pair}}}', *parts[last:]])


def without_handle(body: str) -> str:
    """The JSON object without metadata.privacy_mapping_id; `metadata` itself stays."""
    parts, inside, _ = _split_handle(body)
    if inside is None:
        return body
    depth, key_next, at = 0, True, inside
    while depth >= 0:
        part = parts[at]
        if part in "{[":
            depth += 1
        elif part in "}]":
            depth -= 1
        elif part == "," and depth == 0:
            key_next = True
        elif part[0] == '"' and depth == 0 and key_next:
            key_next = False
            if json.loads(part) == HANDLE:
                end, level = at + 1, 0
                while level or parts[end] not in ",}":
                    level += (parts[end] in "{[") - (parts[end] in "}]")
                    end += 1
                if parts[end] == ",":  # the comma behind goes, or else the one before
                    return "".join(parts[:at] + parts[end + 1 :])
                before = at - 1
                while not parts[before].strip():
                    before -= 1
                return "".join(parts[: before if parts[before] == "," else at] + parts[end:])
        at += 1
    return body


@F.pandas_udf(T.StringType())
def stamp_json(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for batch in batches:
        yield from in_pieces(batch, lambda b, h: None if b is None else with_handle(b, h))


@F.pandas_udf(T.StringType())
def strip_json(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for body in bodies:
        yield from in_pieces((body,), lambda b: None if b is None else without_handle(b))


@F.pandas_udf(T.StringType())
def put_leaves(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Put new texts at their addresses into JSON of any shape; rows without changes come as null."""
    for batch in batches:
        yield from in_pieces(batch, lambda b, a, t: None if b is None else with_new_leaves(b, dict(zip(a, t, strict=True))))


def rebuild_json(df: DataFrame, keys: list[str], body: str, leaves: DataFrame, to: str) -> DataFrame:
    """`df` with `to`: the body with the (keys, address, text) rows of `leaves` put in (N6, any shape).
    `leaves` should hold changed leaves only; a document's own leaves bound each group."""
    grouped = leaves.groupBy(*keys).agg(F.collect_list(F.struct("address", "text")).alias("_put"))
    changed = F.when(F.col("_put").isNotNull(), F.col(body))  # the others go along as null, so that bodies are joined once
    done = df.join(grouped, keys, "left").withColumn("_done", put_leaves(changed, F.col("_put.address"), F.col("_put.text")))
    return done.withColumn(to, F.coalesce("_done", F.col(body))).drop("_put", "_done")


def stamp_metadata(df: DataFrame, mapping_id: str = "mapping_id", metadata: str = "metadata") -> DataFrame:
    """Set metadata.privacy_mapping_id, creating metadata when it is missing."""
    handle = F.col(mapping_id)
    fresh = F.struct(handle.alias("privacy_mapping_id"))
    if metadata not in df.columns:
        return df.withColumn(metadata, fresh)
    fields = [F.col(f"{metadata}.{f}").alias(f) for f in df.schema[metadata].dataType.names if f != "privacy_mapping_id"]
    return df.withColumn(metadata, F.struct(*fields, handle.alias("privacy_mapping_id")))


def strip_metadata(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Remove only the handle; metadata itself stays, empty if need be."""
    if metadata not in df.columns:
        return df
    names = [f for f in df.schema[metadata].dataType.names if f != "privacy_mapping_id"]
    if names:
        return df.withColumn(metadata, F.col(metadata).dropFields("privacy_mapping_id"))
    return df.withColumn(metadata, F.expr("cast(map() AS map<string, string>)"))


def key_differences(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """(keys, missing, extra): top-level keys lost or gained between two JSON texts."""
    had, has = F.json_object_keys(before), F.json_object_keys(after)
    return df.select(
        *keys,
        F.array_sort(F.array_except(had, has)).alias("missing"),
        F.array_sort(F.array_except(has, had)).alias("extra"),
    )


def restore_missing_keys(df: DataFrame, before: list[str], after_prefix: str = "") -> DataFrame:
    """Typed form of N10: top-level columns of `before` absent from the result come back, except metadata."""
    for c in before:
        if c != "metadata" and f"{after_prefix}{c}" not in df.columns:
            df = df.withColumn(f"{after_prefix}{c}", F.col(c))
    return df


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
