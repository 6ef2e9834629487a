"""Substring dedup: windows of WINDOW words that occur in several documents, found by super-k-mers.

Each window's minimiser is the smallest hash of the SEED-word runs in it. Consecutive windows that share their
minimiser travel as one packed string, a super-k-mer, to the minimiser's bucket, where the bucket's windows are sorted
and counted exactly, word by word. Three steps keep the traffic small and the buckets bounded:

1. The minimisers of all documents, with the number of windows they stand for, are aggregated; those of one document
   only can't have a window in common with another, and their windows stay at home.
2. A document's shared minimisers are joined back to its text, and only their super-k-mers are packed. In a bucket,
   equal strings are one from then on.
3. A bucket of more than BUCKET_WINDOWS windows is not gathered: its distinct strings keep their smallest id by a
   map-side aggregate, their windows become rows that are aggregated in the same way, and the smallest id of each window
   is joined back to the string and then to its places. Both ways give the same rows.

A word is removed if a window over it also starts in a document with a smaller id. Words are compared whole.

Defined results: a null text has no words; a document shorter than the window keeps all words; a null id neither
removes words of others nor loses its own; rows with equal ids don't remove from each other; rows that are equal in id
and text get equal results; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import NULL_ID, freeing, group_starts, row_key, slices, sorted_groups, staged, words

WINDOW = 50
#: Words of a minimiser.
SEED = 16
BUCKET_WINDOWS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEPT_WORDS = 300_000


class WordCodes(dict):
    """64-bit codes of words, kept for the next time they occur."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
        data = word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")
        code = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")
        self[word] = code
        return code

    def of(self, text_words: list[str] | list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text_words), dtype=np.uint64, count=len(text_words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def runs_of(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k codes, by doubling."""
    out, have = codes, 1
    parts: tuple[np.ndarray, int] | None = None  # of the binary places of k so far
    while True:
        if k & have:
            if parts is None:
                parts = (out, have)
            else:
                n = len(codes) - parts[1] - have + 1
                parts = (mixed(parts[0][:n] * _MIX + out[parts[1] : parts[1] + n]), parts[1] + have)
        if have * 2 > k:
            return parts[0]
        out, have = mixed(out[: len(out) - have] * _MIX + out[have:]), have * 2


def window_minimum(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive numbers, by doubling."""
    have = 1
    while have * 2 <= k:
        x, have = np.minimum(x[: len(x) - have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (k - have)], x[k - have :]) if have < k else x


def super_kmers(codes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each run of windows that share their minimiser."""
    if len(codes) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = window_minimum(mixed(runs_of(codes, seed)), window - seed + 1)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[starts].view(np.int64), starts, np.diff(np.append(starts, len(least)))


def _minimisers(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(k1, k2, bucket, windows): the distinct minimisers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches, "text"):
            at, buckets, counts = [], [], []
            for i, text in enumerate(batch.column("text")):
                b, _, n = super_kmers(codes.of(words(text.as_py())), window, seed)
                if len(b):
                    found, of = np.unique(b, return_inverse=True)
                    at.append(np.full(len(found), i))
                    buckets.append(found)
                    counts.append(np.bincount(of, weights=n).astype(np.int64))
            rows = np.concatenate([np.empty(0, np.int64), *at])
            keys = [batch.column(c).take(pa.array(rows)) for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(np.concatenate([np.empty(0, np.int64), *buckets])), pa.array(np.concatenate([np.empty(0, np.int64), *counts]))],
                ["k1", "k2", "bucket", "windows"],
            )

    return docs.select("k1", "k2", "text").mapInArrow(freeing(run), "k1 long, k2 long, bucket long, windows long")


def _packed(shared: DataFrame, window: int, seed: int) -> DataFrame:
    """(k1, k2, bucket, start, packed): the super-k-mers of rows with text and the buckets asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches, "text", 2 << 20):
            keys, buckets, places, strings = [], [], [], []
            for i, (text, asked) in enumerate(zip(batch.column("text"), batch.column("buckets"), strict=True)):
                text_words = words(text.as_py())
                b, starts, counts = super_kmers(codes.of(text_words), window, seed)
                for at in np.flatnonzero(np.isin(b, np.array(asked.as_py(), dtype=np.int64))):
                    start, n = int(starts[at]), int(counts[at])
                    keys.append(i)
                    buckets.append(int(b[at]))
                    places.append(start)
                    strings.append(" ".join(text_words[start : start + n + window - 1]))
            ids = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1").take(ids), batch.column("k2").take(ids), pa.array(buckets, pa.int64()), pa.array(places, pa.int32()), pa.array(strings, pa.string())],
                ["k1", "k2", "bucket", "start", "packed"],
            )

    return shared.mapInArrow(freeing(run), "k1 long, k2 long, bucket long, start int, packed string")


def _cut_windows(text: str, window: int) -> list[str]:
    ends = [at for at, c in enumerate(text) if c == " "]
    starts, ends = [0, *(e + 1 for e in ends)], [*ends, len(text)]
    return [text[starts[j] : ends[j + window - 1]] for j in range(len(starts) - window + 1)]


def _ranges(least: list[int], id_: int, window: int) -> list[tuple[int, int]]:
    """(from, to) of the words under windows whose smallest id is below `id_`, merged."""
    out: list[tuple[int, int]] = []
    for j, other in enumerate(least):
        if other < id_:
            if out and out[-1][1] >= j:
                out[-1] = (out[-1][0], j + window)
            else:
                out.append((j, j + window))
    return out


def repeated_windows(packed: list[str], ids: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each string of a bucket the ranges of its words, (from, to), under windows that a smaller id has too."""
    first: dict[str, int] = {}
    for text, id_ in zip(packed, ids, strict=True):
        first[text] = min(id_, first.get(text, id_))
    if len(first) == 1:
        return [[(0, text.count(" ") + 1)] if first[text] < id_ else [] for text, id_ in zip(packed, ids, strict=True)]
    least: dict[str, list[int]] = {}
    rows = []
    for text, id_ in first.items():
        own = _cut_windows(text, window)
        least[text] = [id_] * len(own)
        rows += [(w, id_, text, j) for j, w in enumerate(own)]
    rows.sort()  # equal windows side by side, the smallest id first
    head, id_ = None, 0
    for own_window, own_id, text, j in rows:
        if own_window != head:
            head, id_ = own_window, own_id
        least[text][j] = id_
    return [_ranges(least[text], id_, window) for text, id_ in zip(packed, ids, strict=True)]


def _removed_in_large_buckets(packed: DataFrame, window: int) -> DataFrame:
    """(k1, k2, from, to) as of `_removed_in_buckets`, by aggregates and joins only."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 1 << 18):
            at, places, own = [], [], []
            for i, text in enumerate(batch.column("packed").to_pylist()):
                found = _cut_windows(text, window)
                at += [i] * len(found)
                places += range(len(found))
                own += found
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("string", "first")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(places, pa.int32()), pa.array(own, pa.string())], ["string", "first", "at", "own"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, froms, tos = [], [], []
            for i, (id_, start, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k1", "start", "least")), strict=True)):
                for f, t in _ranges([x["first"] for x in least], id_, window):
                    at.append(i)
                    froms.append(start + f)
                    tos.append(start + t)
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(froms, pa.int32()), pa.array(tos, pa.int32())], ["k1", "k2", "from", "to"])

    # strings travel once; behind that, a string is its 256-bit hash
    packed = packed.withColumn("string", F.sha2("packed", 256))
    strings = packed.groupBy("string").agg(F.min("k1").alias("first"), F.first("packed").alias("packed"))
    windows = strings.mapInArrow(freeing(cut), "string string, first long, at int, own string")
    windows = windows.select("string", "first", "at", F.sha2("own", 256).alias("own"))
    least = windows.groupBy("own").agg(F.min("first").alias("first"))
    known = windows.select("string", "at", "own").join(least, "own").groupBy("string").agg(F.array_sort(F.collect_list(F.struct("at", "first"))).alias("least"))
    places = packed.select("k1", "k2", "start", "string").join(known, "string").select("k1", "k2", "start", "least")
    return places.mapInArrow(freeing(merge), "k1 long, k2 long, from int, to int")


def _removed_in_buckets(packed: DataFrame, window: int) -> DataFrame:
    """(k1, k2, from, to): word ranges to remove, by buckets that lie together in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["bucket"]):
            texts, ids, starts = rows["packed"].to_pylist(), rows["k1"].to_pylist(), rows["start"].to_pylist()
            at, froms, tos = [], [], []
            cuts = group_starts(rows, ["bucket"]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                for i, ranges in enumerate(repeated_windows(texts[a:b], ids[a:b], window), start=a):
                    for f, t in ranges:
                        at.append(i)
                        froms.append(starts[i] + f)
                        tos.append(starts[i] + t)
            keys = [pa.array(rows[c].to_numpy()[at] if at else [], pa.int64()) for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(froms, pa.int32()), pa.array(tos, pa.int32())], ["k1", "k2", "from", "to"])

    rows = packed.repartition("bucket").sortWithinPartitions("bucket", "k1")
    return rows.mapInArrow(freeing(run), "k1 long, k2 long, from int, to int")


def removed_ranges(rows: DataFrame, window: int = WINDOW, seed: int = SEED, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """(k1, k2, from, to) of rows (k1, k2, text): word ranges that repeat a document with a smaller id."""
    known = rows.where((F.col("k1") != NULL_ID) & F.col("text").isNotNull())
    found = _minimisers(known, window, seed)
    buckets = found.groupBy("bucket").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.sum("windows").alias("n"))
    buckets = buckets.where(F.col("a") < F.col("b")).select("bucket", (F.col("n") > bucket_windows).alias("big"))
    per_doc = found.join(buckets, "bucket").groupBy("k1", "k2").agg(
        F.collect_set(F.when(~F.col("big"), F.col("bucket"))).alias("small"), F.collect_set(F.when(F.col("big"), F.col("bucket"))).alias("big")
    )
    per_doc = staged(per_doc)
    some = known.join(per_doc.where(F.size("small") > 0).select("k1", "k2", F.col("small").alias("buckets")), ["k1", "k2"])
    out = _removed_in_buckets(_packed(some, window, seed), window)
    large = per_doc.where(F.size("big") > 0).select("k1", "k2", F.col("big").alias("buckets"))
    if large.limit(1).count():
        out = out.unionByName(_removed_in_large_buckets(_packed(known.join(large, ["k1", "k2"]), window, seed), window))
    return out


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every document; kept words are joined by one space."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *row_key(F.col(doc_id), F.col(text)), F.col(text).alias("text"))
    ranges = removed_ranges(rows.select("k1", "k2", "text"), window).groupBy("k1", "k2").agg(
        F.collect_list("from").alias("froms"), F.collect_list("to").alias("tos")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text_, froms, tos in zip(*(batch.column(c) for c in ("text", "froms", "tos")), strict=True):
                own = words(text_.as_py())
                n_words.append(len(own))
                if froms.as_py():
                    steps = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(steps, froms.as_py(), 1)
                    np.add.at(steps, tos.as_py(), -1)
                    stays = np.cumsum(steps[:-1]) == 0
                    own = [w for w, s in zip(own, stays.tolist(), strict=True) if s]
                n_removed.append(n_words[-1] - len(own))
                kept.append(" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    joined = rows.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "froms", "tos")
    return joined.mapInArrow(freeing(cut), "doc_id long, n_words long, n_removed long, kept_text string")
