"""Which spans win the text (T4): greedy claims on the original offsets, inside one row."""

from __future__ import annotations

from cloakframe.functions.sqltext import empty, fold, keep, let, struct, transform

TYPES = {
    "start": "INT", "end": "INT", "priority": "INT", "type_ord": "INT", "value_ord": "INT",
    "neg_score": "DOUBLE", "neg_length": "INT", "entity_type": "STRING", "value": "STRING", "source": "STRING",
}
# Text order, and claim order: priority, profile order, score, position, longer span.
BY_POSITION = ("start", "end", "priority", "type_ord", "value_ord", "neg_score", "neg_length",
               "entity_type", "value", "source")
BY_RANK = ("priority", "type_ord", "value_ord", "neg_score", "start", "neg_length", "end",
           "entity_type", "value", "source")


def _array_of(order: tuple[str, ...]) -> str:
    return f"ARRAY<STRUCT<{', '.join(f'{f}: {TYPES[f]}' for f in order)}>>"


POSITIONED = _array_of(BY_POSITION)
RANKED = _array_of(BY_RANK)


def _arranged(s: str, order: tuple[str, ...]) -> str:
    return struct(**{f: f"{s}.{f}" for f in order})


def _claim(group: str) -> str:
    """Greedy by rank among spans that touch each other."""
    return fold(
        f"array_sort({transform(group, lambda s: _arranged(s, BY_RANK))})",
        empty(RANKED),
        lambda kept, s: f"CASE WHEN exists({kept}, k_ -> k_.start < {s}.end AND {s}.start < k_.end) "
        f"THEN {kept} ELSE array_append({kept}, {s}) END",
    )


def resolve_overlaps(spans: str) -> str:
    """Surviving spans in text order, from an array that carries the fields of TYPES.

    Rows without overlap only pay for a sort; otherwise spans are cut into islands of
    touching spans and each island is claimed on its own.
    """

    def by_island(s: str) -> str:
        zero = struct(done=empty(POSITIONED), island=empty(POSITIONED), reach="0")

        def settled(acc: str) -> str:
            claimed = transform(_claim(f"{acc}.island"), lambda x: _arranged(x, BY_POSITION))
            return f"concat({acc}.done, CASE WHEN size({acc}.island) > 1 THEN {claimed} ELSE {acc}.island END)"

        def step(acc: str, x: str) -> str:
            is_new = f"{x}.start >= {acc}.reach"
            return struct(
                done=f"CASE WHEN {is_new} THEN {settled(acc)} ELSE {acc}.done END",
                island=f"CASE WHEN {is_new} THEN array({x}) ELSE array_append({acc}.island, {x}) END",
                reach=f"greatest({acc}.reach, {x}.end)",
            )

        return f"array_sort({fold(s, zero, step, settled)})"

    def chosen(s: str) -> str:
        crossing = keep(s, lambda x, i: f"{i} > 0 AND get({s}, {i} - 1).end > {x}.start", 2)
        return f"CASE WHEN size({crossing}) = 0 THEN {s} ELSE {by_island(s)} END"

    arranged = transform(spans, lambda s: _arranged(s, BY_POSITION))
    return let(f"array_sort(cast({arranged} AS {POSITIONED}))", chosen)


def spans_positioned(spans: str) -> str:
    """Detector spans with the fields used here."""
    return transform(
        spans,
        lambda s: struct(
            start=f"{s}.start", end=f"{s}.end", priority=f"{s}.priority", type_ord=f"{s}.type_ord",
            value_ord=f"{s}.value_ord", neg_score=f"-{s}.score", neg_length=f"{s}.start - {s}.end",
            entity_type=f"{s}.entity_type", value=f"{s}.value", source=f"{s}.source",
        ),
    )
