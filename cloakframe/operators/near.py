"""Phrases near a few values (Z1-Z3) in Arrow batches: the fuzzy matching of dictionaries that are folded.

Cost a text: a few array operations a word and value; only windows that have enough of a value's characters are scored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions.similarity import BITS, lcs_of_long

NEAR = "ARRAY<STRUCT<v: INT, i: INT, n: INT, phrase: STRING, score: DOUBLE>>"

# Bytes of a batch's texts that are worked on at once.
PIECE_BYTES = 3 << 20


class NearValues:
    """Values with their thresholds, looked for in the windows of many texts at once.

    Lengths and the characters shared with a value are counted once for each distinct word. Their sums by window leave few
    windows; those are scored, each distinct one once.
    """

    def __init__(self, lowered: tuple[str, ...], thresholds: tuple[float, ...], n_words: int, least: int):
        pairs = enumerate(zip(lowered, thresholds, strict=True))
        self.values = [(k, v, float(t)) for k, (v, t) in pairs if v and t is not None and t <= 100]
        self.n_words, self.least = n_words, least
        # lengths a window must have to be near a value, or a wider range
        self.bounds = [
            (int(t * len(v) / (200 - t)) - 1, int((200 - t) * len(v) / t) + 2 if t > 0 else 1 << 40) for _, v, t in self.values
        ]
        self.seen: list[dict[str, float]] = [{} for _ in self.values]

    def ratios(self, at: int, phrases: list[str]) -> np.ndarray:
        _, value, _ = self.values[at]
        seen = self.seen[at]
        if len(seen) > 1 << 17:
            seen.clear()
        for p in {*phrases} - seen.keys():
            seen[p] = 200.0 * lcs_of_long(value, p) / (len(p) + len(value))
        return np.array([seen[p] for p in phrases], np.float64)

    def hits(self, words: pa.Array, counts: np.ndarray) -> list[tuple[int, int, int, int, str, float]]:
        """(row, value, i, n, phrase, score), ordered: for each row and value the first window over the threshold. `words`
        are those of all rows as written, empty ones among them, `counts` their numbers by row."""
        if not len(words) or not self.values:
            return []
        coded = words.dictionary_encode()
        written = coded.dictionary.to_pylist()
        lowered = [w.lower() for w in written]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(counts)), counts)
        if "" in written:
            full = codes != written.index("")
            codes, rows = codes[full], rows[full]
            counts = np.bincount(rows, minlength=len(counts))
        total = len(codes)
        if not total:
            return []
        first = np.repeat(np.cumsum(counts) - counts, counts)
        ends = (first + np.repeat(counts, counts)).astype(np.int64)
        each = [np.array([len(w) for w in known], np.int64) for known in (written, lowered)]
        sizes = [np.concatenate(([0], np.cumsum(e[codes]))) for e in each]
        # the characters of all distinct words, a line feed behind each, which no word holds
        chars = np.frombuffer("".join(w + "\n" for w in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate(([0], np.cumsum(each[1] + 1)[:-1]))
        shortest, longest = min(lo for lo, _ in self.bounds), max(hi for _, hi in self.bounds)
        windows = []
        for n in range(1, min(self.n_words, int(counts.max())) + 1):
            length = sizes[1][n:] - sizes[1][:-n] + (n - 1)
            i = np.flatnonzero((length >= shortest) & (length <= longest))
            i = i[(i + n <= ends[i]) & (sizes[0][i + n] - sizes[0][i] + n - 1 > self.least)]
            windows.append((n, i, length[i]))
        out = []
        for k, ((number, value, threshold), (lo, hi)) in enumerate(zip(self.values, self.bounds, strict=True)):
            # by word: its characters that the value has, and the places of the value whose characters it has
            places = {c: sum(1 << j for j, d in enumerate(value[:BITS]) if d == c) for c in value}
            table, marked = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.uint64)
            for c, mark in places.items():
                if c != "\n":
                    table[ord(c)], marked[ord(c)] = 1, mark
            having, held = np.add.reduceat(table[chars], begins), np.bitwise_or.reduceat(marked[chars], begins)
            upto = np.concatenate(([0], np.cumsum(having[codes], dtype=np.int64)))
            blank = places.get(" ", 0)
            found = []
            for n, i, length in windows:
                band = (length >= lo) & (length <= hi)
                near, need = i[band], threshold * (length[band] + len(value)) - 1e-6
                shared = upto[near + n] - upto[near] + (n - 1 if blank else 0)
                some = 200.0 * shared >= need
                near, need = near[some], need[some]
                marks = np.full(len(near), blank if n > 1 else 0, np.uint64)
                for j in range(n):
                    marks |= held[codes[near + j]]
                near = near[200.0 * (np.bitwise_count(marks) + max(0, len(value) - BITS)) >= need]
                if len(near):
                    phrases = [" ".join(lowered[c] for c in codes[a : a + n].tolist()) for a in near.tolist()]
                    score = self.ratios(k, phrases)
                    over = score >= threshold
                    found += [(a, n, s) for a, s in zip(near[over].tolist(), score[over].tolist(), strict=True)]
            done = -1
            for a, n, score in sorted(found):
                if rows[a] != done:
                    done = rows[a]
                    phrase = " ".join(written[c] for c in codes[a : a + n].tolist())
                    out.append((int(rows[a]), number, int(a - first[a]), n, phrase, score))
        return sorted(out)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about PIECE_BYTES of text."""
    start = held = 0
    for row, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        held += n
        if held >= PIECE_BYTES:
            yield start, row + 1
            start, held = row + 1, 0
    if start < len(texts):
        yield start, len(texts)


def near_phrases(text: Column, values: Column, thresholds: Column, n_words: int, least: int) -> Column:
    """NEAR of a text: for each value in lower case (by its place) the first window of words as written over its threshold,
    in (start, words) order. Values and thresholds are arrays of the row; rows that share them are read together. Texts are
    split here, at the white space of functions.text.WHITESPACE, so that a row's words are not sent one by one."""
    kind = pa.list_(pa.struct([("v", pa.int32()), ("i", pa.int32()), ("n", pa.int32()), ("phrase", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf(T.DataType.fromDDL(NEAR))
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[tuple, NearValues] = {}
        for texts, v, t in batches:
            groups: dict[tuple, list[int]] = {}
            for row, (own, cuts) in enumerate(zip(v.to_pylist(), t.to_pylist(), strict=True)):
                if own:
                    groups.setdefault((tuple(own), tuple(cuts)), []).append(row)
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for key, rows in groups.items():
                if len(known) > 64:
                    known.clear()
                near = known.setdefault(key, NearValues(*key, n_words, least))
                own = texts if len(rows) == len(texts) else texts.take(pa.array(rows))
                for a, b in _pieces(own):
                    words = pc.utf8_split_whitespace(own.slice(a, b - a))
                    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    for row, number, i, n, phrase, score in near.hits(words.flatten(), counts):
                        out[rows[a + row]].append({"v": number, "i": i, "n": n, "phrase": phrase, "score": score})
            yield pa.array(out, kind)

    # else Spark may move it into expressions that can't hold it
    return run.asNondeterministic()(text, values, thresholds)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
