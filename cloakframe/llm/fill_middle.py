"""Fill-in-middle transformation with an indexable skip list.

A text is cut into units, runs of ASCII letters or single other characters. A skip list stands over the units: lane 0
has a node for each unit, each higher lane about one of FAN nodes of the lane below, and a node knows how many units
and how many code points lie between it and the next one of its lane. Two ranks cut the text; each is reached by
descending from the top lane and adding up widths, so a cut never falls inside a unit.

Ranks and form come from the SHA-256 of a seed and the document's id, so a task that runs again gives the same rows.

Defined results: a null text is empty; an empty text, or one that holds a sentinel, stays plain; a null id counts as an
empty string of digits; equal rows give equal rows; an empty table gives no rows. Only the named columns are read, and
`keep` columns come back inside the struct `doc`, so they may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import freeing, slices

#: Nodes of a lane for each node of the lane above, about.
FAN = 4


@dataclass(frozen=True)
class Plan:
    """What a corpus is turned into: sentinels, and how many of a hundred documents take which form."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain_percent: int = 10
    spm_percent: int = 20  # of those that aren't plain
    seed: str = "1"

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return np.empty(0, np.int64)
    letter = (codes | 32) - np.uint32(97) < 26
    first = ~letter
    first[1:] |= ~letter[:-1]
    first[0] = True
    return np.diff(np.flatnonzero(first), append=len(codes))


def _levels(n: int) -> np.ndarray:
    """Lanes above lane 0 that each of n nodes stands in: geometric, from a hash of its number; the first is in all."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    lowest = (x & (~x + np.uint64(1))).astype(np.float64)
    out = (np.log2(np.maximum(lowest, 1)) / np.log2(FAN)).astype(np.int64)
    out[0] = out.max()
    return out


class SkipList:
    """Units under express lanes; a lane holds the unit and code-point widths of its nodes and their places below."""

    def __init__(self, widths: np.ndarray):
        self.n, self.chars = len(widths), int(widths.sum())
        ends = np.concatenate([[0], np.cumsum(widths)])
        levels = _levels(self.n) if self.n else np.empty(0, np.int64)
        self.lanes: list[tuple[list[int], list[int], list[int]]] = []  # unit widths, code-point widths, place below
        below = np.arange(self.n)
        for lane in range(int(levels.max(initial=-1)) + 1):
            at = np.flatnonzero(levels >= lane)
            units, points = np.diff(at, append=self.n), np.diff(ends[at], append=self.chars)
            self.lanes.append((units.tolist(), points.tolist(), np.searchsorted(below, at).tolist()))
            below = at

    def code_points(self, rank: int) -> int:
        """Code points of the first `rank` units."""
        if rank >= self.n:
            return self.chars
        node, left, out = 0, rank, 0
        for units, points, down in reversed(self.lanes):
            while units[node] <= left:
                left -= units[node]
                out += points[node]
                node += 1
            node = down[node]
        return out


def draws(doc_id: int | None, seed: str = "1") -> tuple[int, ...]:
    """Four numbers of 32 bits from the document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def rearranged(text: str, doc_id: int | None, plan: Plan = Plan()) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of a text."""
    units = SkipList(unit_widths(text))
    h1, h2, h3, h4 = draws(doc_id, plan.seed)
    if not text or any(s in text for s in plan.sentinels) or h3 % 100 >= 100 - plan.plain_percent:
        return units.n, "plain", None, None, text
    one, two = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.code_points(one), units.code_points(two)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < plan.spm_percent:
        return units.n, "spm", a, b - a, plan.suffix + suffix + plan.prefix + prefix + plan.middle + middle
    return units.n, "psm", a, b - a, plan.prefix + prefix + plan.suffix + suffix + plan.middle + middle


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, plan: Plan = Plan()) -> DataFrame:
    """(doc, n, form, prefix_chars, middle_chars, output): each document with its text cut and rearranged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, ids = batch.column("text").to_pylist(), batch.column("id").to_pylist()
            done = list(zip(*(rearranged(t or "", i, plan) for t, i in zip(texts, ids, strict=True)), strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(done, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], ["doc", "n", "form", "prefix_chars", "middle_chars", "output"])

    doc = F.struct(*(F.col(c) for c in ([doc_id] if keep is None else keep)))
    rows = docs.select(doc.alias("doc"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    kinds = rows.select("doc").schema[0].dataType.simpleString()
    return rows.mapInArrow(freeing(run), f"doc {kinds}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that an output was made from. Parts hold no sentinel, so the first of each kind is the one set."""

    def parts(second: str) -> Column:
        behind_first = F.substring(output, F.lit(len(plan.prefix if second == plan.suffix else plan.suffix) + 1), F.char_length(output))
        return F.split(behind_first, f"{re.escape(second)}|{re.escape(plan.middle)}", -1)

    psm, spm = parts(plan.suffix), parts(plan.prefix)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents
), t AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u FROM d
), r AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
         WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(c1, c2)], '') AS a,
    array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS b, array_to_string(u[greatest(c1, c2) + 1:], '') AS c
  FROM r
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
    ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
