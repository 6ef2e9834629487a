"""Many plain values in one pass over a text: an Aho-Corasick automaton inside tasks.

Its cost is the length of the text and the number of hits, whatever the number and the lengths of the values.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle

PIECE = 256  # rows of a batch that are worked on at once


class Values:
    """An automaton of distinct values without the empty one."""

    def __init__(self, values: Iterable[str]):
        self._automaton = ahocorasick.Automaton()
        for value in values:
            if value:
                self._automaton.add_word(value, value)
        self.empty = len(self._automaton) == 0
        if not self.empty:
            self._automaton.make_automaton()

    def in_text(self, text: str) -> set[str]:
        """The values that occur in the text."""
        return set() if self.empty else {value for _, value in self._automaton.iter(text)}

    def places(self, text: str) -> list[tuple[int, str]]:
        """(start, value) of all occurrences; those of one value don't overlap and are taken from the left."""
        reach: dict[str, int] = {}
        out = []
        for end, value in () if self.empty else self._automaton.iter(text):
            start = end + 1 - len(value)
            if start >= reach.get(value, 0):
                reach[value] = end + 1
                out.append((start, value))
        return out


def found_rows(batch: pa.RecordBatch, keys: list[str], text: str, values: Values) -> pa.RecordBatch:
    """The key columns and each value found in the row's text."""
    rows, found = [], []
    for i, t in enumerate(batch.column(text).to_pylist()):
        own = sorted(values.in_text(t)) if t else []
        rows += [i] * len(own)
        found += own
    kept = batch.select(keys).take(pa.array(rows, pa.int64())) if keys else None
    columns = [*(kept.columns if kept is not None else []), pa.array(found, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [*keys, "value"])


def find_with(values: list[str], keys: list[str], text: str):
    """A function over Arrow batches of texts, for values that fit into one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Values(values)
        for batch in batches:
            yield found_rows(batch, keys, text, automaton)

    return run


def find_by_part(keys: list[str], text: str):
    """A function over Arrow batches sorted by part, in which a part's values stand before the texts that meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, automaton = None, [], None
        for batch in batches:
            parts = list(zip(batch.column("_part").to_pylist(), batch.column("_salt").to_pylist(), strict=True))
            values = batch.column("_value").to_pylist()
            start = 0
            while start < len(parts):
                end = start
                if parts[start] != place:
                    place, held, automaton = parts[start], [], None
                while end < len(parts) and parts[end] == place and values[end] is not None:
                    held.append(values[end])
                    end += 1
                first = end
                while end < len(parts) and parts[end] == place and values[end] is None:
                    end += 1
                if end > first:
                    if held or automaton is None:
                        automaton, held = Values(held), []
                    yield found_rows(batch.slice(first, end - first), keys, text, automaton)
                start = end

    return run


def hits_by_part(columns: list[str], text: str, hit: pa.DataType, piece: int = PIECE):
    """As `find_by_part`, for whole rows: the columns of each text's row and the array of its hits. A part's values stand
    in one row before its texts, as the array `_values`. Batches are worked on in pieces of `piece` rows, and hits are taken
    from the array of the part's values, so that no hit is an object of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, known, automaton = None, {}, pa.array([], hit), Values([])
        for whole in batches:
            for at in range(0, len(whole), piece):
                batch = whole.slice(at, piece)
                parts = zip(batch.column("_part").to_pylist(), batch.column("_salt").to_pylist(), strict=True)
                texts, values = batch.column(text), batch.column("_values")
                rows, sizes, found, done = [], [], [], []
                for row, part in enumerate(parts):
                    if part != place:
                        done.append(known.take(pa.array(found, pa.int64())))
                        place, held, known, automaton, found = part, {}, pa.array([], hit), Values([]), []
                    if values[row].is_valid:
                        known = pa.array(values[row].as_py(), hit)
                        for i, value in enumerate(known.field("value").to_pylist()):
                            held.setdefault(value, []).append(i)
                        automaton = Values(held)
                        continue
                    content = texts[row].as_py()
                    before = len(found)
                    for value in sorted(automaton.in_text(content)) if content else ():
                        found += held[value]
                    rows.append(row)
                    sizes.append(len(found) - before)
                done.append(known.take(pa.array(found, pa.int64())))
                hits = pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.concat_arrays(done))
                kept = batch.select(columns).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, hits], [*columns, "_hits"])

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
