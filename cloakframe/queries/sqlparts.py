"""DuckDB SQL building blocks for the reference queries.

They follow another route than the engine: matches are unnested to rows, offsets come from window
sums, thresholds from VALUES, overlaps from list_reduce. Only fixed values (patterns, scores,
salt) are shared with the engine.
"""

from __future__ import annotations

from collections.abc import Iterable

from cloakframe.operators.detect import CONTEXT_BOOST, CONTEXT_WIDTH, WIDE_ENDINGS, Detector
from cloakframe.options import DEFAULT_THRESHOLDS

SALT = "audit-salt"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: Iterable[tuple], columns: str, name: str = "v") -> str:
    def one(v) -> str:
        if isinstance(v, float):
            return f"CAST({v} AS DOUBLE)"
        return "NULL" if v is None else q(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS {name}({columns}))"


def mapping_id(*keys: str) -> str:
    h = f"sha256(concat_ws('|', {q(SALT)}, {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in cuts)


def token(scope: str, entity_type: str, value: str) -> str:
    return (
        f"'<' || {entity_type} || '_' || "
        f"substr(sha256({q(SALT)} || '|' || {scope} || '|' || {entity_type} || '|' || {value}), 1, 8) || '>'"
    )


def _valid(d: Detector, v: str) -> str:
    kind = d.validator.__name__
    if kind == "luhn_valid":
        digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
        return (
            f"list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE "
            f"WHEN (length({digits}) - k) % 2 = 0 THEN CAST(substr({digits}, k, 1) AS INT) "
            f"WHEN CAST(substr({digits}, k, 1) AS INT) > 4 THEN 2 * CAST(substr({digits}, k, 1) AS INT) - 9 "
            f"ELSE 2 * CAST(substr({digits}, k, 1) AS INT) END)) % 10 = 0"
        )
    if kind == "ending_known":
        return f"regexp_matches({v}, {q(rf'[.](?:{WIDE_ENDINGS})$')})"
    if kind == "octets_valid":
        return f"list_max(list_transform(string_split({v}, '.'), lambda o: CAST(o AS INT))) <= 255"
    if kind == "iso_date_valid":
        return f"try_strptime(left({v}, 10), '%Y-%m-%d') IS NOT NULL"
    if kind == "ipv6_valid":
        colons = f"len(string_split({v}, ':'))"
        once = f"(contains({v}, '::') AND len(string_split({v}, '::')) = 2 AND NOT contains({v}, ':::'))"
        return (
            f"({once} OR ({colons} = 8 AND NOT contains({v}, '::'))) "
            f"AND NOT regexp_matches({v}, '^:[^:]|[^:]:$') AND length({v}) > 3"
        )
    if kind == "iban_valid":
        turned = f"(substr({v}, 5) || left({v}, 4))"
        code = f"CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END"
        number = f"array_to_string(list_transform(string_split({turned}, ''), lambda c: CAST({code} AS VARCHAR)), '')"
        return (
            f"list_reduce(list_transform(string_split({number}, ''), lambda x: CAST(x AS INT)), "
            f"lambda a, x: (a * 10 + x) % 97) = 1"
        )
    raise ValueError(kind)


def detector_rows(source: str, keys: list[str], text: str, d: Detector, lang: str | None = None) -> str:
    """SELECT keys, entity_type, span_start, span_end, value, score for one detector."""
    k = ", ".join(keys)
    p = q(d.pattern)
    lead = f", regexp_extract_all(t_, {p}, 2) AS vs" if d.lead else ", m AS vs"
    where = [f"{text} IS NOT NULL"]
    if lang and d.lang != "*":
        where.append(f"{lang} = {q(d.lang)}")
    conditions = ["true"]
    if d.left_not:
        conditions.append(f"NOT regexp_matches(before, {q(d.left_not)})")
    if d.right_not:
        conditions.append(f"NOT regexp_matches(after, {q(f'^(?:{d.right_not})')})")
    if d.validator is not None and d.failed_score is None:
        conditions.append(_valid(d, "value"))
    score = f"CAST({d.score} AS DOUBLE)"
    if d.failed_score is not None:
        score = f"CASE WHEN {_valid(d, 'value')} THEN {score} ELSE CAST({d.failed_score} AS DOUBLE) END"
    if d.context:
        window = f"lower(substr(t_, greatest(span_start - {CONTEXT_WIDTH}, 0) + 1, least(span_start, {CONTEXT_WIDTH})))"
        seen = q(f"(?:^|[^a-z])(?:{'|'.join(d.context)})(?:[^a-z]|$)")
        score = (
            f"CASE WHEN regexp_matches({window}, {seen}) THEN least({score} + CAST({CONTEXT_BOOST} AS DOUBLE), 1.0) "
            f"ELSE {score} END"
        )
    return f"""
SELECT {k}, {q(d.entity_type)} AS entity_type, CAST(span_start AS INT) AS span_start,
       CAST(span_start + length(value) AS INT) AS span_end, value, {score} AS score
FROM (
  SELECT {k}, t_, value, right(gap, 1) AS before, left(nxt, 2) AS after,
         CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY {k} ORDER BY i) AS BIGINT) - length(value) AS span_start
  FROM (
    SELECT {k}, t_, unnest(m) AS whole, unnest(vs) AS value, unnest(g[1:len(m)]) AS gap, unnest(g[2:]) AS nxt,
           unnest(range(len(m))) AS i
    FROM (SELECT *{lead} FROM (
      SELECT {k}, {text} AS t_, regexp_extract_all({text}, {p}) AS m, regexp_split_to_array({text}, {p}) AS g
      FROM {source} WHERE {' AND '.join(where)}))
  )
)
WHERE {' AND '.join(conditions)}"""


def spans(source: str, keys: list[str], text: str, detectors: Iterable[Detector], lang: str | None = None) -> str:
    return "\nUNION ALL\n".join(f"({detector_rows(source, keys, text, d, lang)})" for d in detectors)


def threshold_values(thresholds: dict[str, float] = DEFAULT_THRESHOLDS) -> str:
    return values([(t, v) for t, v in thresholds.items()], "entity_type, threshold")


def over_threshold(span_cte: str, thresholds: dict[str, float] = DEFAULT_THRESHOLDS) -> str:
    return f"""SELECT s.* FROM {span_cte} s LEFT JOIN {threshold_values(thresholds)} t USING (entity_type)
WHERE s.score >= coalesce(t.threshold, {thresholds['DEFAULT']})"""


def claim(rows: str, keys: list[str]) -> str:
    """Greedy claims over located spans (keys, rank columns, span_start, span_end, entity_type, value, score,
    source): SELECT keys, kept (list of structs in text order)."""
    k = ", ".join(keys)
    return f"""
SELECT {k}, list_sort(list_transform(kept, lambda x: {{'s': x.s, 'e': x.e, 'entity_type': x.entity_type,
       'value': x.value, 'score': x.score, 'source': x.source}})) AS kept
FROM (
  SELECT {k}, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, y: CASE
      WHEN len(list_filter(acc, lambda a: a.s < y[1].e AND y[1].s < a.e)) > 0 THEN acc ELSE acc || y END) AS kept
  FROM (
    SELECT {k}, list({{'s': span_start, 'e': span_end, 'entity_type': entity_type, 'value': value,
                'score': score, 'source': source}}
             ORDER BY priority, type_ord, value_ord, -score, span_start, span_start - span_end, entity_type) AS xs
    FROM ({rows}) GROUP BY {k}
  )
)"""


def located(candidates: str, source: str, keys: list[str], text: str) -> str:
    """All occurrences of distinct candidate values."""
    k = ", ".join(keys)
    return f"""
SELECT {k}, priority, type_ord, value_ord, entity_type, value, score, source,
       CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(value) AS INT) AS span_start,
       CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + i * length(value) AS INT) AS span_end
FROM (
  SELECT *, unnest(range(1, len(g))) AS i FROM (
    SELECT c.*, string_split(d.{text}, c.value) AS g
    FROM (SELECT {k}, entity_type, value, min(priority) AS priority, min(type_ord) AS type_ord,
                 min(value_ord) AS value_ord, max(score) AS score, arg_min(source, priority) AS source
          FROM ({candidates}) GROUP BY {k}, entity_type, value) c
    JOIN {source} d USING ({k})
  )
)"""


def rebuilt(text: str, kept: str, shown: str) -> str:
    """The text with kept[i] replaced by `shown`, an expression over kept[i]."""
    gap = f"(CASE WHEN i = 1 THEN 0 ELSE {kept}[i - 1].e END)"
    pieces = (
        f"array_to_string(list_transform(range(1, len({kept}) + 1), lambda i: "
        f"substr({text}, {gap} + 1, {kept}[i].s - {gap}) || {shown}), '')"
    )
    return f"CASE WHEN {kept} IS NULL THEN {text} ELSE {pieces} || substr({text}, {kept}[len({kept})].e + 1) END"


def redaction_ctes(
    source: str, keys: list[str], text: str, detectors: Iterable[Detector],
    dictionary: Iterable[tuple[str, int, str, int]] = (), thresholds: dict[str, float] = DEFAULT_THRESHOLDS,
    skip_terms: Iterable[str] = (), scope: str | None = None, extra: str | None = None,
) -> str:
    """CTEs base, found, kept, red(keys, text, mid, kept, redacted)."""
    k = ", ".join(keys)
    skips = ", ".join(q(t.lower()) for t in skip_terms) or "''"
    mid = mapping_id(*keys)
    parts = [
        f"""SELECT {k}, 2 AS priority, 0 AS type_ord, 0 AS value_ord, entity_type, value, score, 'pattern' AS source
FROM ({over_threshold('found', thresholds)})"""
    ]
    rows = list(dictionary)
    if rows:
        parts.append(
            f"""SELECT {k}, 0, v.type_ord, v.value_ord, v.entity_type, v.value, CAST(1 AS DOUBLE), 'exact'
FROM base JOIN {values(rows, 'entity_type, type_ord, value, value_ord')} v ON contains(base.{text}, v.value)"""
        )
    if extra:
        parts.append(extra)
    scope_sql = "r.mid" if scope is None else scope
    return f"""
base AS (SELECT * FROM {source} WHERE length({text}) >= 5 AND lower({text}) NOT IN ({skips})
         AND NOT (length({text}) = 36 AND length({text}) - length(replace({text}, '-', '')) = 4)),
found AS ({spans('base', keys, text, detectors)}),
candidates AS ({' UNION ALL '.join(parts)}),
located AS ({located('SELECT * FROM candidates', 'base', keys, text)}),
claimed AS ({claim('SELECT * FROM located', keys)}),
joined AS (SELECT s.*, {mid} AS mid, c.kept FROM {source} s LEFT JOIN claimed c USING ({k})),
red AS (SELECT r.*, {rebuilt(f'r.{text}', 'r.kept', token(scope_sql, 'r.kept[i].entity_type', 'r.kept[i].value'))} AS redacted
        FROM joined r),
maps AS (SELECT DISTINCT {k}, mid, x.entity_type AS entity_type, x.value AS original, x.score AS score, x.source AS source,
                {token(scope_sql.replace('r.', ''), 'x.entity_type', 'x.value')} AS placeholder
         FROM (SELECT {k}, mid, unnest(kept) AS x FROM joined WHERE kept IS NOT NULL))"""


def lcs_ctes(pairs: str) -> str:
    """CTEs dp and scored(a, b, ratio) for the distinct pairs of `pairs` (a, b)."""
    cell = (
        "CASE WHEN substr(a, i + 1, 1) = substr(b, j[1], 1) THEN row[j[1]] + 1 "
        "ELSE greatest(acc[len(acc)], row[j[1] + 1]) END"
    )
    return f"""
pairs_ AS (SELECT DISTINCT a, b FROM ({pairs})),
dp AS (
  SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: CAST(0 AS BIGINT)) AS row FROM pairs_
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]),
         lambda acc, j: acc || [{cell}], [CAST(0 AS BIGINT)]) FROM dp WHERE i < length(a)
),
scored AS (SELECT a, b, 200.0::DOUBLE * row[len(row)] / (length(a) + length(b)) AS ratio FROM dp WHERE i = length(a))"""
