"""String similarity as SQL expressions, and as an Arrow function for columns of pairs."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.sqltext import empty, fold, let, struct, transform


def lcs_length(a: str, b: str) -> str:
    """Length of the longest common subsequence, by the row-wise table held in an array."""

    def table(b_chars: str) -> str:
        def next_row(row: str, ch: str) -> str:
            return fold(
                f"sequence(1, size({row}))",
                struct(left="0", out=empty("array<int>")),
                lambda acc, j: let(
                    f"CASE WHEN {ch} = get({b_chars}, {j} - 1) THEN coalesce(get({row}, {j} - 2), 0) + 1 "
                    f"ELSE greatest({acc}.left, get({row}, {j} - 1)) END",
                    lambda cell: struct(left=cell, out=f"array_append({acc}.out, {cell})"),
                ),
                lambda acc: f"{acc}.out",
            )

        rows = fold(f"split({a}, '')", transform(b_chars, lambda _: "0"), next_row)
        return f"element_at({rows}, -1)"

    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE {let(f'split({b}, ' + chr(39) * 2 + ')', table)} END"


def indel_ratio(a: str, b: str) -> str:
    """200 * LCS / (len(a) + len(b)); two empty strings are equal."""
    total = f"(length({a}) + length({b}))"
    return f"CASE WHEN {total} = 0 THEN 100.0D ELSE 200.0D * ({lcs_length(a, b)}) / {total} END"


def may_reach(a: str, b: str, threshold: str) -> str:
    """Cheap exact bounds: false only where indel_ratio(a, b) < threshold for certain.

    LCS is at most the number of characters of either string that occur in the other, and the
    edit distance is at most the insert/delete distance.
    """
    total = f"(length({a}) + length({b}))"
    most = f"least(length({a}) - length(translate({a}, {b}, '')), length({b}) - length(translate({b}, {a}, '')))"
    budget = f"cast(floor((100.0D - {threshold}) * {total} / 100.0D + 1e-9D) AS int)"
    return f"(levenshtein({a}, {b}, {budget}) >= 0 AND 200.0D * {most} >= {threshold} * {total})"


def shortest_partner(length: str, threshold: str) -> str:
    """Shortest partner length for which the ratio can reach the threshold."""
    return f"cast(ceil({threshold} * {length} / (200.0D - {threshold}) - 1e-9D) AS int)"


def longest_partner(length: str, threshold: str) -> str:
    return f"cast(floor((200.0D - {threshold}) * {length} / {threshold} + 1e-9D) AS int)"


# Strings up to this length are rows of a matrix, whose matches are the bits of one number a row.
BITS = 62


def lcs_of_long(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a number as long as `a`: a zero bit stands for one more character."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        common = row & at.get(ch, 0)
        row = (row + common | row - common) & full
    return len(a) - row.bit_count()


def lcs_of_short(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """As lcs_of_long for many pairs of at most BITS characters at once."""
    one, other = (x.astype(f"U{max(1, n.max())}").view(np.uint32).reshape(len(x), -1).T.copy() for x, n in ((a, a_sizes), (b, b_sizes)))
    full = (np.uint64(1) << a_sizes.astype(np.uint64)) - np.uint64(1)
    row = full.copy()
    for j, ch in enumerate(other):
        common = np.zeros(len(row), np.uint64)
        for i, own in enumerate(one):
            common |= (own == ch).astype(np.uint64) << np.uint64(i)
        # behind its end a string is padded with character 0, which may stand in the other one
        common &= np.where(j < b_sizes, row, np.uint64(0))
        row = (row + common | row - common) & full
    return a_sizes - np.bitwise_count(row)


def lcs_lengths(a: pa.Array, b: pa.Array) -> pa.Array:
    """Lengths of the longest common subsequences of two columns of strings."""
    x, y = (c.to_numpy(zero_copy_only=False) for c in (a, b))
    x_sizes, y_sizes = (pc.fill_null(pc.utf8_length(c), 0).to_numpy().astype(np.int64) for c in (a, b))
    known = pc.and_(pc.is_valid(a), pc.is_valid(b)).to_numpy(zero_copy_only=False)
    longest = np.maximum(x_sizes, y_sizes)
    out = np.zeros(len(x), np.int32)
    kind = np.where(longest <= BITS, longest // 4, -1)
    for k in np.unique(kind[known]):
        at = np.flatnonzero(known & (kind == k))
        if k >= 0:
            out[at] = lcs_of_short(x[at], y[at], x_sizes[at], y_sizes[at])
        else:
            out[at] = [lcs_of_long(*p) for p in zip(x[at], y[at], strict=True)]
    return pa.array(out, mask=~known)


def indel_ratio_column(a: str, b: str) -> Column:
    """As `indel_ratio` for columns of very many pairs, by Arrow batches."""

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return lcs_lengths(x, y)

    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * run(F.col(a), F.col(b)) / total)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
