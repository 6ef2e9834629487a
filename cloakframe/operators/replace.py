"""Replacement of very many values one by one, each in a text of its own (T2): for each value the text with the value
replaced by its token wherever it stands.

The row expressions `text.occurrences` and `redact.rebuild` count characters from the start of the text for each place,
which is dear where thousands of values meet one text. Here texts are bytes: the places of a value are found from left to
right in one search, and the pieces between them are put together with the token. The result is the same.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 1 << 24


def replaced_each(text: bytes, pairs: list[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, int, bytes]]:
    """(value, places, text with the token at each of them)."""
    for value, token in pairs:
        pieces = text.split(value)
        yield value, len(pieces) - 1, token.join(pieces)


def digests_each(text: bytes, pairs: list[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, int, bytes]]:
    """As replaced_each with the MD5 of each text. Values are taken by their first places, and what lies before a first
    place is hashed once for all values behind it."""
    firsts = sorted((at if (at := text.find(value)) >= 0 else len(text), value, token) for value, token in pairs)
    before, done = hashlib.md5(usedforsecurity=False), 0
    for first, value, token in firsts:
        before.update(text[done:first])
        done = first
        pieces = text[first:].split(value)
        own = before.copy()
        own.update(token.join(pieces))
        yield value, len(pieces) - 1, own.hexdigest().encode()


def replace_each(df: DataFrame, keys: list[str], text: str, pairs: str, digest: bool = False) -> DataFrame:
    """(keys, value, n, replaced) for each pair of `pairs`, an ARRAY<STRUCT<value, token>>; values are not empty. With
    `digest` the MD5 of the text instead of the text."""
    each = digests_each if digest else replaced_each
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("value", T.StringType()), ("n", T.IntegerType()), ("replaced", T.StringType())))])
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(row: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            own = [pa.repeat(row.column(k)[0], len(found)) for k in range(n_keys)]
            value, n, shown = zip(*found, strict=True)
            made = [pa.array(value, pa.binary()).cast(pa.string()), pa.array(n, pa.int32()), pa.array(shown, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays([*own, *made], schema.names)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                whole, values = row.column(n_keys)[0].as_py(), row.column(n_keys + 1).flatten()
                tokens = row.column(n_keys + 2).flatten()
                found, held = [], 0
                for one in each(whole, list(zip(values.to_pylist(), tokens.to_pylist(), strict=True))) if whole is not None else ():
                    found.append(one)
                    held += len(one[0]) + len(one[2])
                    if held >= BATCH_BYTES:
                        yield out(row, found)
                        found, held = [], 0
                if found:
                    yield out(row, found)

    split = [F.expr(f"transform({pairs}, p_ -> cast(p_.{n} AS binary))").alias(f"_{n}") for n in ("value", "token")]
    return df.select(*keys, F.col(text).cast("binary").alias("_text"), *split).mapInArrow(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
