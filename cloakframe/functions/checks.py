"""Validators for detector matches, as SQL expressions."""

from __future__ import annotations

from cloakframe.functions.sqltext import fold, struct


def luhn_valid(value: str) -> str:
    def add(acc: str, ch: str) -> str:
        doubled = f"CASE WHEN int({ch}) > 4 THEN int({ch}) * 2 - 9 ELSE int({ch}) * 2 END"
        return struct(
            total=f"{acc}.total + CASE WHEN {acc}.odd THEN int({ch}) ELSE {doubled} END", odd=f"NOT {acc}.odd"
        )

    digits = f"reverse(regexp_replace({value}, '[^0-9]', ''))"
    return fold(f"split({digits}, '')", struct(total="0", odd="true"), add, lambda acc: f"{acc}.total % 10 = 0")


def octets_valid(value: str) -> str:
    return f"forall(split({value}, '\\\\.'), o_ -> int(o_) <= 255)"


def ipv6_valid(value: str) -> str:
    """Eight groups, or fewer with one '::'."""
    colons = f"(length({value}) - length(replace({value}, ':', '')))"
    single = f"(rlike({value}, '::') AND NOT rlike({value}, '::.*::|:::'))"
    full = f"({colons} = 7 AND NOT rlike({value}, '::'))"
    ends = f"NOT rlike({value}, '^:[^:]|[^:]:$')"
    return f"(({single} OR {full}) AND {ends} AND length({value}) > 3)"


def iban_valid(value: str) -> str:
    """Country code and check digits moved to the end, letters as 10..35, remainder 1 modulo 97."""

    def add(acc: str, ch: str) -> str:
        return (
            f"CASE WHEN ascii({ch}) >= 65 THEN {acc} * 100 + ascii({ch}) - 55 "
            f"ELSE {acc} * 10 + ascii({ch}) - 48 END % 97"
        )

    return f"({fold(f'split(concat(substr({value}, 5), left({value}, 4)), {chr(39) * 2})', '0', add)} = 1)"


def iso_date_valid(value: str) -> str:
    return f"try_to_timestamp(left({value}, 10), 'yyyy-MM-dd') IS NOT NULL"
