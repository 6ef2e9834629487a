"""Best-fit packing of documents into sequences of a fixed length.

A document's tokens end with an id of its own; only documents longer than a sequence are cut, into whole sequences
with the shorter rest first. Pieces are packed online: a fixed number of bins is open, and a bitset keyed by free
space finds the bin that a piece fills best. If no open bin fits, a new one opens, and if too many are open the fullest
closes first.

Pieces are dealt to packers by hash in the order of a second hash, so that a task that runs again packs alike. Each
packer holds up to OPEN_BINS bins; there is one for each PACKER_PIECES pieces.

Defined results: a null text is empty and has the closing id alone; equal rows are packed one by one; an empty table
gives no pieces. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import freeing, slices, staged

SEQUENCE = 2048
OPEN_BINS = 1024
PACKER_PIECES = 100_000
class _Ranked:
    """Ids of texts by a byte-level vocabulary whose merges stand in the order of their ids: then an id is a rank, and
    merging by rank gives the same ids several times faster, without words kept in memory."""

    def __init__(self, spec: dict):
        import public_tokenizers
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self._encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def fits(spec: dict) -> bool:
        model, cut = spec.get("model", {}), spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel":
            return False
        if cut.get("add_prefix_space") or not cut.get("use_regex", True) or any(not t["special"] for t in spec.get("added_tokens", [])):
            return False
        vocab = model["vocab"]
        return all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(model["merges"])) and len(vocab) == 256 + len(model["merges"])

    def ids(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, disallowed_special=())


class _Whole:
    """Ids of whole texts by any vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")


@functools.cache
def encoder(path: str) -> _Ranked | _Whole:
    """The ids of texts by a vocabulary file; read once a worker process, as that takes longer than many tasks."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return _Ranked(spec) if _Ranked.fits(spec) else _Whole(path)


def cut_points(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens: whole sequences behind a shorter first piece."""
    first = n % sequence or min(n, sequence)
    return [(0, first), *((s, sequence) for s in range(first, n, sequence))]


class OpenBins:
    """Bins that may still take pieces, found by free space through one integer used as a bitset."""

    def __init__(self, sequence: int = SEQUENCE, most: int = OPEN_BINS):
        self.sequence, self.most, self.count, self.opened = sequence, most, 0, 0
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(sequence + 1)]

    def _push(self, free: int, bin_: int) -> None:
        self.by_free[free].append(bin_)
        self.bits |= 1 << free
        self.count += 1

    def _pop(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._pop(free)
        else:
            free, bin_ = self.sequence, self.opened
            self.opened += 1
            if self.count >= self.most:  # the fullest closes
                self._pop((self.bits & -self.bits).bit_length() - 1)
        if free > length:
            self._push(free - length, bin_)
        return bin_, self.sequence - free


def tokenized(
    docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, sequence: int = SEQUENCE, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of each document, unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words = encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, "text", 2 << 20):
            out: list[tuple] = []
            for id_, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = words.ids(text.as_py() or "").astype("<u4", copy=False).tobytes() + end
                for piece, (start, length) in enumerate(cut_points(len(ids) // 4, sequence)):
                    own = ids[4 * start : 4 * (start + length)]
                    out.append((id_, piece, start, length, zlib.crc32(own), own))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds, strict=False)], names[:n])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(freeing(run), schema + ", ids binary" * with_ids)


def pack(pieces: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, packers: int = 1) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, length and ids_crc32; lengths are at most `sequence`."""
    kinds = pieces.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, packer = OpenBins(sequence, open_bins), None
        for batch in batches:
            placed = np.empty((batch.num_rows, 2), dtype=np.int64)
            of = batch.column("packer").to_pylist()
            for i, length in enumerate(batch.column("length").to_pylist()):
                if of[i] != packer:
                    bins, packer = OpenBins(sequence, open_bins), of[i]
                bin_, offset = bins.place(length)
                placed[i] = bin_ * packers + packer, offset
            kept = [batch.column(c) for c in kinds.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(placed[:, 0]), pa.array(placed[:, 1])], [*kinds.names, "sequence_id", "offset"])

    key = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(5))
    rows = pieces.withColumn("packer", F.pmod(key, F.lit(packers)).cast("int")).withColumn("turn", F.xxhash64(key, F.lit(9)))
    rows = rows.repartitionById(packers, "packer").sortWithinPartitions("packer", "turn", "doc_id", "piece", "length", "ids_crc32")
    return rows.mapInArrow(freeing(run), T.StructType(kinds.fields).add("sequence_id", "long").add("offset", "long"))


def pack_documents(
    docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, open_bins: int = OPEN_BINS
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents.

    The number of packers follows the number of documents; each piece of a longer document adds a whole sequence.
    The pieces, which are short, are written before they are packed, so that texts come in small batches.
    """
    packers = max(1, -(-docs.count() // PACKER_PIECES))
    pieces = staged(tokenized(docs, path, doc_id, text, sequence=sequence), small=True)
    return pack(pieces, sequence, open_bins, packers)
