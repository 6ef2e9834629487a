"""SQL expressions over one text: guards, phrases, match offsets, occurrences."""

from __future__ import annotations

from cloakframe.functions.sqltext import empty, fold, keep, let, quote, struct, transform

# Fixed value: the whitespace Python's str.split() splits on, as a Java class.
WHITESPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def eligible(text: str, min_length: int = 5) -> str:
    return f"coalesce(length({text}) >= {min_length}, false)"


def is_uuid_shaped(text: str, length: int = 36, dashes: int = 4) -> str:
    return f"(length({text}) = {length} AND length({text}) - length(replace({text}, '-', '')) = {dashes})"


def is_skip_term(text: str, terms: list[str], parity: bool = False) -> str:
    """Whole-text membership. With `parity` the terms keep their case, so mixed-case terms never match."""
    if not terms:
        return "false"
    wanted = sorted(set(terms) if parity else {t.lower() for t in terms})
    return f"coalesce(lower({text}) IN ({', '.join(quote(t) for t in wanted)}), false)"


def words(text: str) -> str:
    return keep(f"split({text}, {quote(WHITESPACE)}, -1)", lambda w: f"{w} <> ''")


def literal_regex(value: str) -> str:
    """A regex that matches `value` itself."""
    return f"concat('\\\\Q', replace({value}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')"


RUN = 256


def starts_of(gaps: str, lengths: str) -> str:
    """0-based start of every match, from the gap before it and its length.

    The sum runs in blocks of RUN matches: appending one by one over the whole text would copy
    the array once per match.
    """

    def blocks(steps: str) -> str:
        def block(k: str) -> str:
            return f"slice({steps}, {k} * {RUN} + 1, {RUN})"

        def within(k: str, first: str) -> str:
            return fold(
                block(k),
                struct(pos=first, out=empty("array<int>")),
                lambda acc, x: struct(pos=f"{acc}.pos + {x}.g + {x}.n", out=f"array_append({acc}.out, {acc}.pos + {x}.g)"),
                lambda acc: f"{acc}.out",
            )

        ids = f"sequence(0, cast(greatest(size({steps}) - 1, 0) / {RUN} AS int))"
        totals = transform(ids, lambda k: fold(block(k), "0", lambda acc, x: f"{acc} + {x}.g + {x}.n"))
        firsts = fold(
            totals,
            struct(pos="0", out=empty("array<int>")),
            lambda acc, t: struct(pos=f"{acc}.pos + {t}", out=f"array_append({acc}.out, {acc}.pos)"),
            lambda acc: f"{acc}.out",
        )
        many = let(firsts, lambda f: f"flatten({transform(f, lambda first, k: within(k, first), 2)})")
        return f"CASE WHEN size({steps}) <= {RUN} THEN {within('0', '0')} ELSE {many} END"

    steps = f"zip_with(slice({gaps}, 1, size({lengths})), {lengths}, (g_, n_) -> named_struct('g', length(g_), 'n', n_))"
    return let(steps, blocks)


# Up to here matches are located one after another; beyond, from the gaps, which is linear in the text.
FEW = 64


def starts_in_turn(text: str, values: str) -> str:
    """0-based starts of values that follow one another in the text.

    A match of a pattern without anchors or lookaround is also the next place its own text occurs,
    so its start is found without running the pattern again.
    """
    return fold(
        values,
        struct(pos="0", out=empty("array<int>")),
        lambda acc, v: let(
            f"locate({v}, {text}, {acc}.pos + 1) - 1",
            lambda at: struct(pos=f"{at} + length({v})", out=f"array_append({acc}.out, {at})"),
        ),
        lambda acc: f"{acc}.out",
    )


def running_starts(gaps: str, matches: str) -> str:
    """0-based start of every match, from the gaps around the matches."""
    return starts_of(gaps, f"transform({matches}, m_ -> length(m_))")


def match_starts(text: str, pattern: str, matches: str) -> str:
    """0-based start of every match of `pattern`, given the matches."""
    dense = let(f"split({text}, {quote(pattern)}, -1)", lambda g: running_starts(g, matches))
    return f"CASE WHEN size({matches}) <= {FEW} THEN {starts_in_turn(text, matches)} ELSE {dense} END"


def occurrences(text: str, value: str) -> str:
    """0-based starts of all non-overlapping occurrences of `value`, left to right."""

    def located(n: str) -> str:
        dense = let(
            f"split({text}, {literal_regex(value)}, -1)",
            lambda g: starts_of(g, f"transform(slice({g}, 2, size({g})), x_ -> length({value}))"),
        )
        return f"CASE WHEN {n} <= {FEW} THEN {starts_in_turn(text, f'array_repeat({value}, {n})')} ELSE {dense} END"

    count = f"cast((length({text}) - length(replace({text}, {value}, ''))) / length({value}) AS int)"
    return let(count, located)


def shifted(array: str, by: int) -> str:
    """The array without its first `by` elements, to be zipped with itself."""
    return f"slice({array}, {by + 1}, greatest(size({array}), 1))" if by else array


def substitute_tokens(text: str, pattern: str, lookup: str) -> str:
    """Replace every match of `pattern` that `lookup` (MAP<STRING,STRING>) knows; leave the rest."""

    def rebuilt(p: str) -> str:
        fills = f"concat({transform(f'{p}.m', lambda t: f'coalesce(try_element_at({lookup}, {t}), {t})')}, array(''))"
        return f"array_join(zip_with({p}.g, {fills}, (g_, f_) -> concat(g_, f_)), '')"

    parts = struct(
        m=f"regexp_extract_all({text}, {quote(pattern)}, 0)", g=f"split({text}, {quote(pattern)}, -1)"
    )
    return f"CASE WHEN rlike({text}, {quote(pattern)}) THEN {let(parts, rebuilt)} ELSE {text} END"
