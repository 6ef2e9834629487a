"""Redaction of texts with very many candidates, linear in the text (T4, T5).

The row expressions of `redact` and `overlap` look for each value in the whole text, which is fastest for a few values
and quadratic for thousands. Leaves with more than MANY candidates come here as Arrow batches: an automaton finds all
places in one pass, one sweep over the sorted spans resolves overlaps, and the text is put together once. The result is
the same.
"""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_left
from itertools import count

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cloakframe.operators.automaton import PIECE, Values
from cloakframe.options import Options
from cloakframe.schemas import ENTITIES

MANY = 64
LEAVES = f"ARRAY<STRUCT<key: STRING, path: STRING, text: STRING, entities: {ENTITIES}>>"


def claimed(spans: list[tuple]) -> list[tuple]:
    """Greedy claims by rank; spans are (start, end, rank, ...), the result is in text order."""
    out: list[tuple] = []
    island: list[tuple] = []
    reach = 0

    def settle() -> None:
        if len(island) == 1:
            out.append(island[0])
            return
        starts: list[int] = []
        kept: list[tuple] = []
        for span in sorted(island, key=lambda s: s[2]):
            at = bisect_left(starts, span[0])
            if (at == 0 or kept[at - 1][1] <= span[0]) and (at == len(kept) or span[1] <= kept[at][0]):
                starts.insert(at, span[0])
                kept.insert(at, span)
        out.extend(kept)

    for span in sorted(spans):
        if island and span[0] >= reach:
            settle()
            island.clear()
        reach = max(reach, span[1]) if island else span[1]
        island.append(span)
    if island:
        settle()
    return out


def redacted(text: str, scope: str, candidates: list[dict], secret: str, n_hex: int, again_hex: int | None = None) -> tuple[str, list[dict]]:
    """(text, entities) as `redact.redact_candidates` gives them; tokens minted again have `again_hex` digits."""
    best: dict[str, dict[str, tuple]] = {}
    for c in candidates:
        rank = (c["priority"], c["type_ord"], c["value_ord"], c["neg_score"], c["source"])
        kinds = best.setdefault(c["value"], {})
        if c["entity_type"] not in kinds or rank < kinds[c["entity_type"]]:
            kinds[c["entity_type"]] = rank
    spans = []
    for start, value in Values(best).places(text):
        for kind, (priority, type_ord, value_ord, neg_score, source) in best[value].items():
            end = start + len(value)
            rank = (priority, type_ord, value_ord, neg_score, start, -len(value), end, kind, value, source)
            spans.append((start, end, rank, kind, value, -neg_score, source))
    kept = claimed(spans)

    def mint(kind: str, value: str, again: int) -> str:
        tail = f"|{again}" if again else ""
        digest = hashlib.sha256(f"{secret}|{scope}|{kind}|{value}{tail}".encode("utf-8", "surrogatepass")).hexdigest()
        return f"<{kind}_{digest[: (again_hex or n_hex) if again else n_hex]}>"

    values = {(s[3], s[4]) for s in kept}
    tokens = {v: mint(*v, 0) for v in values}
    if len(set(tokens.values())) != len(values):
        tokens = {v: mint(*v, 1) for v in values}
    if len(set(tokens.values())) != len(values):  # very many values: each takes its first free token, in their order
        tokens, taken = {}, set()
        for v in sorted(values):
            token = next(t for again in count() if (t := mint(*v, again)) not in taken)
            taken.add(token)
            tokens[v] = token
    parts, at, rows = [], 0, {}
    for start, end, _, kind, value, score, source in kept:
        token = tokens[kind, value]
        parts += [text[at:start], token]
        at = end
        row = (token, kind, value, score, source)
        rows[token] = min(rows.get(token, row), row)
    names = ("placeholder", "entity_type", "original", "score", "source")
    return "".join([*parts, text[at:]]), [dict(zip(names, rows[t], strict=True)) for t in sorted(rows)]


def sweep_leaves(options: Options, leaves: Column) -> Column:
    """ARRAY<key, path, text, entities> of ARRAY<key, path, text, scope, found>; null for null, so that rows without
    such leaves cost next to nothing."""
    secret, n_hex, again_hex = options.secret, options.digits(0), options.digits(1)
    kind = to_arrow_type(T.DataType.fromDDL(LEAVES))

    def of(rows: list[dict] | None) -> list[dict] | None:
        if rows is None:
            return None
        out = []
        for r in rows:
            text, entities = redacted(r["text"], r["scope"], r["found"], secret, n_hex, again_hex)
            out.append({"key": r["key"], "path": r["path"], "text": text, "entities": entities})
        return out

    @F.arrow_udf(T.DataType.fromDDL(LEAVES))
    def run(batch: pa.Array) -> pa.Array:
        # the candidates of one row at a time are objects, and results of PIECE rows
        pieces = [pa.array([of(batch[i].as_py()) for i in range(at, min(at + PIECE, len(batch)))], kind) for at in range(0, len(batch), PIECE)]
        return pa.concat_arrays(pieces) if pieces else pa.array([], kind)

    return run.asNondeterministic()(leaves)  # else Spark may move it into expressions that can't hold it


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
