"""Replacement inside one text (T2-T8): candidates -> occurrences -> claims -> tokens -> text."""

from __future__ import annotations

from cloakframe.functions.sqltext import empty, keep, let, struct, transform
from cloakframe.functions.text import occurrences
from cloakframe.operators.overlap import POSITIONED, resolve_overlaps, spans_positioned
from cloakframe.operators.tokens import mint_token
from cloakframe.options import Options
from cloakframe.schemas import ENTITIES


def spans_to_candidates(spans: str) -> str:
    return transform(
        spans,
        lambda s: struct(
            priority=f"{s}.priority", type_ord=f"{s}.type_ord", value_ord=f"{s}.value_ord",
            neg_score=f"-{s}.score", entity_type=f"{s}.entity_type", value=f"{s}.value", source=f"{s}.source",
        ),
    )


def distinct_candidates(candidates: str) -> str:
    """One candidate per (type, value), the one that ranks first: by sort and neighbour test."""
    keyed = transform(
        candidates,
        lambda c: struct(
            entity_type=f"{c}.entity_type", value=f"{c}.value", priority=f"{c}.priority",
            type_ord=f"{c}.type_ord", value_ord=f"{c}.value_ord", neg_score=f"{c}.neg_score", source=f"{c}.source",
        ),
    )
    return let(
        f"array_sort({keyed})",
        lambda s: keep(
            s,
            lambda c, i: f"{i} = 0 OR get({s}, {i} - 1).value <> {c}.value "
            f"OR get({s}, {i} - 1).entity_type <> {c}.entity_type",
            2,
        ),
    )


def locate(text: str, candidates: str) -> str:
    """Every occurrence of every candidate value, as spans with rank fields."""

    def all_of(c: str) -> str:
        return transform(
            occurrences(text, f"{c}.value"),
            lambda start: struct(
                start=start, end=f"{start} + length({c}.value)", priority=f"{c}.priority",
                type_ord=f"{c}.type_ord", value_ord=f"{c}.value_ord", neg_score=f"{c}.neg_score",
                neg_length=f"-length({c}.value)", entity_type=f"{c}.entity_type", value=f"{c}.value",
                source=f"{c}.source",
            ),
        )

    return f"cast(flatten({transform(candidates, all_of)}) AS {POSITIONED})"


def tokens_for(options: Options, scope: str, spans: str) -> str:
    """One token per span. If two different values of this leaf get the same token, all are minted
    again with a counter, so a leaf's own tokens always tell its values apart."""

    def attempt(again: int) -> str:
        return transform(spans, lambda s: mint_token(options, scope, f"{s}.entity_type", f"{s}.value", again))

    def checked(tokens: str) -> str:
        values = transform(spans, lambda s: f"concat_ws('|', {s}.entity_type, {s}.value)")
        return (
            f"CASE WHEN size(array_distinct({tokens})) = size(array_distinct({values})) "
            f"THEN {tokens} ELSE {attempt(1)} END"
        )

    return let(attempt(0), checked)


def rebuild(text: str, spans: str, tokens: str) -> str:
    """The text with every span replaced; spans are in text order and do not overlap."""

    def piece(s: str, i: str) -> str:
        gap = f"coalesce(get({spans}, {i} - 1).end, 0)"
        return f"concat(substr({text}, {gap} + 1, {s}.start - {gap}), get({tokens}, {i}))"

    tail = f"substr({text}, coalesce(get({spans}, size({spans}) - 1).end, 0) + 1)"
    return f"concat(array_join({transform(spans, piece, 2)}, ''), {tail})"


def entities_of(spans: str, tokens: str) -> str:
    """Distinct placeholder rows of a leaf, by sort and neighbour test."""
    rows = transform(
        spans,
        lambda s, i: struct(
            placeholder=f"get({tokens}, {i})", entity_type=f"{s}.entity_type", original=f"{s}.value",
            score=f"-{s}.neg_score", source=f"{s}.source",
        ),
        2,
    )
    return let(
        f"array_sort({rows})",
        lambda r: keep(r, lambda x, i: f"{i} = 0 OR get({r}, {i} - 1).placeholder <> {x}.placeholder", 2),
    )


def redact_candidates(options: Options, text: str, scope: str, candidates: str) -> str:
    """STRUCT<text, entities> from candidates (all occurrences of each value are redacted)."""
    return _redacted(options, text, scope, candidates, lambda c: locate(text, distinct_candidates(c)))


def redact_spans(options: Options, text: str, scope: str, spans: str) -> str:
    """STRUCT<text, entities> that replaces exactly the given detector spans."""
    return _redacted(options, text, scope, spans, spans_positioned)


def _redacted(options: Options, text: str, scope: str, found: str, to_spans) -> str:
    untouched = struct(text=text, entities=empty(ENTITIES))

    def with_spans(spans: str) -> str:
        return let(
            tokens_for(options, scope, spans),
            lambda tokens: struct(text=rebuild(text, spans, tokens), entities=entities_of(spans, tokens)),
        )

    return let(
        found,
        lambda f: f"CASE WHEN size({f}) > 0 THEN {let(resolve_overlaps(to_spans(f)), with_spans)} "
        f"ELSE {untouched} END",
    )
