"""Names, places and other entities by a learned sequence tagger (E8, E9): an averaged perceptron with Viterbi decoding.

Words are tagged B-TYPE, I-TYPE or O; a word's features are its own and its neighbours' forms, endings and shapes,
hashed to BUCKETS numbers. Training is parameter mixing: all segments of WINDOW words are dealt by their content to shards
of about SHARD_CHARS characters, SHARDS at least, each task goes through its shards from the common weights, and the mean of
their averaged weights starts the next epoch. What leaves a task are the weights that it changed, in whole numbers, so that
the model depends on the texts alone and not on how they lie.

A shard is written once as numbers: its distinct words' features and, for each word, which one it is. Segments are decoded
together until the first wrong one, which changes the weights, so that every segment meets the weights that it would meet
alone. Applied to whole texts through the model hook.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
WINDOW = 40
SHARDS, EPOCHS = 4, 5
SHARD_CHARS = 4 << 20
BLOCK = 4_096  # segments whose features are held at once
FINE = 1 << 24  # parts of one in which changes of weights are counted
PIECE = 1 << 20  # characters of texts that are tagged at once
_WORD = re.compile(r"\w+|[^\w\s]")


def shape(word: str) -> str:
    """A word's kinds of characters, runs as one: Anna -> Xx, 555 -> 9, @ -> @."""
    out = ""
    for c in word:
        kind = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != kind:
            out += kind
    return out


def _hashed(feature: str, before: int = 0) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass"), before)


def _shifts(most: int) -> np.ndarray:
    """What each byte of a CRC-32 becomes behind 0 to `most` more bytes: (most + 1) tables of 4 by 256."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    now = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]).ravel()
    out = [now]
    for _ in range(most):
        now = (now >> np.uint32(8)) ^ step[now & 255]
        out.append(now)
    return np.concatenate(out)


FAR = 64
_SHIFTS = _shifts(FAR)


def _shifted(c: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    at = np.asarray(n, np.int64) * 1024
    out = _SHIFTS[at + (c & 255)]
    for k in (1, 2, 3):
        out ^= _SHIFTS[at + 256 * k + ((c >> np.uint32(8 * k)) & 255)]
    return out


def crc_behind(before: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of byte strings with others behind them, from the CRC-32 of both and the length of the latter."""
    if (n > FAR).any():
        before, n = before.copy(), n.copy()
        while len(far := np.flatnonzero(n > FAR)):
            before[far] = _shifted(before[far], FAR)
            n[far] -= FAR
    return _shifted(before, n) ^ own


def word_numbers(w: str) -> tuple[int, ...]:
    """Features of a word as such, before and behind another one, and CRC-32s and lengths that hashes with others begin
    with or end in: of itself and of its shape."""
    low, form = w.lower(), shape(w)
    own = (f"w{low}", f"s{form}", f"l{len(low) if len(low) < 12 else 12}{form}", f"p{low[:3]}", f"e{low[-3:]}", f"b{low}", f"a{low}", f"2{low}|", low)
    forms = (form, f"B{form}", f"A{form}", f"3{form}", f"4{form}")
    size = lambda t: len(t.encode("utf-8", "surrogatepass"))
    return (*map(_hashed, own), size(low), *map(_hashed, forms), size(form))


NUMBERS = 16
_NONE = word_numbers("<>")


def coded_rows(table: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashed features, 12 a word: `codes` are the rows of `table` (word_numbers) of all segments' words, `sizes` their
    numbers by segment."""
    table = np.vstack([table.reshape(-1, NUMBERS), np.array([_NONE], np.uint32)])
    here = np.arange(len(codes)) + 4 * np.repeat(np.arange(len(sizes)), sizes) + 2
    padded = np.full(len(codes) + 4 * len(sizes), len(table) - 1, np.int64)
    padded[here] = codes
    of = lambda step, column: table[padded[here + step], column]
    behind = lambda before, step: crc_behind(before, of(step, 10), of(step, 15))
    columns = [
        *(of(0, k) for k in range(5)), of(-1, 5), of(1, 6), behind(of(-1, 11), 0), behind(of(0, 12), 1),
        crc_behind(of(-2, 7), of(-1, 8), of(-1, 9)), behind(behind(of(-2, 13), -1), 0), behind(behind(of(0, 14), 1), 2),
    ]
    return np.stack(columns, 1).astype(np.int64).reshape(len(codes), 12) & (BUCKETS - 1)


class Features:
    """Hashed features of words, one row a word. What depends on one word is hashed once."""

    KEPT = 1 << 18  # words that are kept at most

    def __init__(self) -> None:
        self.words: dict[str, tuple] = {}

    def table(self, words: Iterable[str]) -> np.ndarray:
        if len(self.words) > self.KEPT:
            self.words.clear()
        out = []
        for w in words:
            found = self.words.get(w)
            if found is None:
                found = self.words[w] = word_numbers(w)
            out.append(found)
        return np.array(out, np.uint32).reshape(-1, NUMBERS)

    def rows(self, words: list[str], sizes: list[int] | None = None) -> np.ndarray:
        """Of one text's words, or of many texts' with their numbers."""
        index: dict[str, int] = {}
        codes = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
        return coded_rows(self.table(index), codes, np.array([len(words)] if sizes is None else sizes, np.int64))


def feature_rows(words: list[str]) -> np.ndarray:
    """Hashed features of each word, one row a word."""
    return Features().rows(words)


def viterbi(emit: np.ndarray, trans: np.ndarray, allowed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best tags: emit is words by tags, trans scores a tag behind another one, allowed and first say which may be."""
    if not len(emit):
        return np.empty(0, np.int64)
    step = np.where(allowed, trans, -np.inf)
    score = np.where(first, emit[0], -np.inf)
    back = np.zeros(emit.shape, dtype=np.int64)
    for i in range(1, len(emit)):
        both = score[:, None] + step
        back[i] = both.argmax(axis=0)
        score = both[back[i], np.arange(len(score))] + emit[i]
    tags = np.empty(len(emit), np.int64)
    tags[-1] = score.argmax()
    for i in range(len(emit) - 1, 0, -1):
        tags[i - 1] = back[i, tags[i]]
    return tags


def viterbi_of_many(emits: list[np.ndarray], trans: np.ndarray, allowed: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """`viterbi` of many texts, word by word of all of them at once, in the same operations."""
    sizes = np.array([len(e) for e in emits], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[: np.count_nonzero(sizes)]
    out = [np.empty(0, np.int64)] * len(emits)
    if not len(order):
        return out
    sizes = sizes[order]
    flat, starts = np.concatenate([emits[k] for k in order]), np.cumsum(sizes) - sizes
    step = np.where(allowed, trans, -np.inf)
    score = np.where(first, flat[starts], -np.inf)
    back = np.zeros(flat.shape, np.int8)
    active = len(order) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")  # texts longer than i words
    for i, n in enumerate(active.tolist()):
        if i:
            both = score[:n, :, None] + step
            best = both.argmax(axis=1)
            back[starts[:n] + i] = best
            score[:n] = np.take_along_axis(both, best[:, None, :], axis=1)[:, 0] + flat[starts[:n] + i]
    tags = np.empty(len(flat), np.int64)
    last = score.argmax(axis=1)
    for i in range(len(active) - 1, -1, -1):
        n = active[i]
        at = starts[:n] + i
        ends = sizes[:n] == i + 1
        tags[at[ends]] = last[:n][ends]
        if i:
            tags[at - 1] = back[at, tags[at]]
    for k, start, size in zip(order.tolist(), starts.tolist(), sizes.tolist(), strict=True):
        out[k] = tags[start : start + size]
    return out


def scores(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Words by tags."""
    out = weights[features[:, 0]]
    for k in range(1, features.shape[1]):
        out += weights[features[:, k]]
    return out


def decoded(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, allowed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best tags of many texts' words, one text behind the other. Where O beats any other tag at each word by more than
    what going back to O may gain, O throughout is the best path; only the other texts are searched."""
    out = np.zeros(len(emit), np.int64)
    if not len(emit) or emit.shape[1] == 1:
        return out
    into = np.where(allowed, trans, -np.inf).max(axis=0)
    back = max(0.0, into[0] - trans[0, 0])
    open_ = (emit[:, 1:] + into[1:]).max(axis=1) + back >= emit[:, 0] + trans[0, 0]
    starts = np.cumsum(sizes) - sizes
    begins = starts[sizes > 0]
    open_[begins] = np.where(first[1:], emit[begins, 1:], -np.inf).max(axis=1) + back >= emit[begins, 0]
    for_whole = np.zeros(len(sizes), bool)
    for_whole[np.repeat(np.arange(len(sizes)), sizes)[open_]] = True
    asked = np.flatnonzero(for_whole)
    ranges = [(starts[k], starts[k] + sizes[k]) for k in asked.tolist()]
    for (x, y), path in zip(ranges, viterbi_of_many([emit[x:y] for x, y in ranges], trans, allowed, first), strict=True):
        out[x:y] = path
    return out


def tag_names(types: list[str]) -> list[str]:
    return ["O", *(f"{p}-{t}" for t in types for p in "BI")]


def order_of(tags: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which tag may follow which one, and which may begin: I-TYPE stands behind its own type only."""
    own = [t[2:] for t in tags]
    inside = [t.startswith("I-") for t in tags]
    allowed = np.array([[not inside[b] or (a > 0 and own[a] == own[b]) for b in range(len(tags))] for a in range(len(tags))])
    return allowed, ~np.array(inside)


@dataclass
class Tagger:
    """Learned weights; only those that aren't zero are kept."""

    types: list[str]
    at: np.ndarray  # bucket * tags + tag
    weight: np.ndarray
    trans: np.ndarray

    def load(self):
        """A model for the hook: texts to [(type, start, end, score)]."""
        tags = tag_names(self.types)
        dense = np.zeros(BUCKETS * len(tags))
        dense[self.at] = self.weight
        dense = dense.reshape(BUCKETS, len(tags))
        allowed, first = order_of(tags)

        features = Features()

        def spans(words: list[tuple[int, int]], emit: np.ndarray, path: np.ndarray) -> list[tuple[str, int, int, float]]:
            best = path.tolist()
            if not any(best):
                return []
            rest = emit.copy()
            rest[np.arange(len(best)), best] = -np.inf
            sure = 1 / (1 + np.exp(-np.clip(emit[np.arange(len(best)), best] - rest.max(axis=1), -30, 30)))
            out: list[tuple[str, int, int, float]] = []
            for i in np.flatnonzero(path).tolist():
                tag = best[i]
                if tags[tag].startswith("B-"):
                    out.append((tags[tag][2:], *words[i], float(sure[i])))
                else:
                    kind, start, _, score = out[-1]
                    out[-1] = (kind, start, words[i][1], min(score, float(sure[i])))
            return out

        def many(texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
            words = [[(m.start(), m.end()) for m in _WORD.finditer(t)] for t in texts]
            sizes = [len(own) for own in words]
            emit = scores(dense, features.rows([t[a:b] for t, own in zip(texts, words, strict=True) for a, b in own], sizes))
            path = decoded(emit, np.array(sizes, np.int64), self.trans, allowed, first)
            ends = np.cumsum(sizes)[:-1]
            return [spans(*each) for each in zip(words, np.split(emit, ends), np.split(path, ends), strict=True)] if texts else []

        def run(texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
            """Texts of similar lengths are tagged together, about PIECE characters at once."""
            out: list[list] = [[] for _ in texts]
            held, size = [], 0
            for at in sorted(range(len(texts)), key=lambda k: len(texts[k])):
                held.append(at)
                size += len(texts[at])
                if size >= PIECE:
                    for k, found in zip(held, many([texts[k] for k in held]), strict=True):
                        out[k] = found
                    held, size = [], 0
            for k, found in zip(held, many([texts[k] for k in held]), strict=True):
                out[k] = found
            return out

        return run


def _windows(t: str | None, own: list[dict] | None) -> Iterator[tuple[list[str], list[str] | None]]:
    """Words in windows of WINDOW, with their tags where one isn't O."""
    each = _WORD.findall(t or "")
    names = None
    if own:
        names = ["O"] * len(each)
        found = [(m.start(), m.end()) for m in _WORD.finditer(t or "")]
        at = 0
        for s in sorted(own, key=lambda s: s["start"]):
            while at < len(found) and found[at][0] < s["start"]:
                at += 1
            begin = at
            while at < len(found) and found[at][1] <= s["end"]:
                names[at] = f"{'B' if at == begin else 'I'}-{s['entity_type']}"
                at += 1
    for k in range(0, len(each), WINDOW):
        some = names[k : k + WINDOW] if names else None
        yield each[k : k + WINDOW], some if some and any(n != "O" for n in some) else None


def segments(texts: DataFrame, text: str = "text", spans: str = "spans", mark: bool | None = None) -> DataFrame:
    """(words, tags, labelled): texts with ARRAY<STRUCT<start, end, entity_type>> in windows of WINDOW words; with `mark`
    only those that are labelled, or not."""

    lines = segment_lines(texts, text, spans)
    if mark is not None:
        lines = lines.where(f"tags {'<>' if mark else '='} ''")
    words = F.split("line", " ")
    plain = F.transform(words, lambda w: F.lit("O"))
    return lines.select(words.alias("words"), F.when(F.col("tags") == "", plain).otherwise(F.split("tags", " ")).alias("tags"), (F.col("tags") != "").alias("labelled"))


def segment_lines(texts: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """(line, tags): the windows' words, none of which holds a blank, and their tags with blanks between them; no tags where
    all are O."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, tags, held = [], [], 0
            for i in range(len(batch)):
                t = batch.column("t")[i].as_py()
                for words, names in _windows(t, batch.column("s")[i].as_py()):
                    lines.append(" ".join(words))
                    tags.append(" ".join(names or ()))
                held += len(t or "")
                if held >= PIECE or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(tags, pa.string())], ["line", "tags"])
                    lines, tags, held = [], [], 0

    return texts.select(F.col(text).alias("t"), F.col(spans).alias("s")).mapInArrow(run, "line string, tags string")


PACKED = "shard int, numbers binary, codes binary, sizes binary, names string, gold binary"


def packed(lines: DataFrame, shards: int) -> DataFrame:
    """A row a shard: word_numbers of its distinct words, which one each word is, the words of each segment, the names of
    tags and which one each word has. Shards and their order depend on the segments' content alone."""

    def one(shard: int, lines: list[pa.Array], tags: list[pa.Array]) -> pa.RecordBatch:
        words = pc.split_pattern(pa.concat_arrays(lines), " ")
        sizes = pc.list_value_length(words).to_numpy().astype(np.int32)
        coded = words.flatten().dictionary_encode()
        tags = pa.concat_arrays(tags)
        named = pc.not_equal(tags, "")
        own = pc.split_pattern(tags.filter(named), " ").flatten().dictionary_encode()
        names = ["O", *(n for n in own.dictionary.to_pylist() if n != "O")]
        gold = np.zeros(len(coded), np.int16)
        number = np.array([names.index(n) for n in own.dictionary.to_pylist()], np.int16)
        gold[np.repeat(named.to_numpy(zero_copy_only=False), sizes)] = number[own.indices.to_numpy()]
        numbers = np.array([word_numbers(w) for w in coded.dictionary.to_pylist()], np.uint32)
        codes = coded.indices.to_numpy().astype(np.int32)
        columns = [[shard], [numbers.tobytes()], [codes.tobytes()], [sizes.tobytes()], [" ".join(names)], [gold.tobytes()]]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "numbers", "codes", "sizes", "names", "gold"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lines, tags = None, [], []
        for batch in batches:
            own = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if own[a] != place and lines:
                    yield one(place, lines, tags)
                    lines, tags = [], []
                place = int(own[a])
                lines.append(batch.column("line").slice(a, b - a))
                tags.append(batch.column("tags").slice(a, b - a))
        if lines:
            yield one(place, lines, tags)

    rows = lines.withColumn("turn", F.xxhash64("line", "tags"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("turn", F.lit(1)), F.lit(shards)).cast("int"))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "turn", "line", "tags")
    return rows.select("shard", "line", "tags").mapInArrow(run, PACKED)


def _pass(shard: dict, tags: list[str], weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of the perceptron over a `packed` shard: where the averages over all its steps differ from the weights that
    it began with (those of trans stand behind the others), and by how much, in parts of 1 / FINE."""
    number = {t: i for i, t in enumerate(tags)}
    allowed, first = order_of(tags)
    weights, trans = weights.copy(), trans.copy()
    table = np.frombuffer(shard["numbers"], np.uint32).reshape(-1, NUMBERS)
    codes, sizes = np.frombuffer(shard["codes"], np.int32), np.frombuffer(shard["sizes"], np.int32).astype(np.int64)
    gold = np.array([number[n] for n in shard["names"].split(" ")], np.int64)[np.frombuffer(shard["gold"], np.int16)]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    changes = np.zeros((2, weights.size + trans.size), np.int64)  # by how much, and the same times the step

    def change(at: np.ndarray, by: int, step: int) -> None:
        np.add.at(changes[0], at, by)
        np.add.at(changes[1], at, by * step)

    together = 1
    for block in range(0, len(sizes), BLOCK):
        end = min(block + BLOCK, len(sizes))
        zero = starts[block]
        features = coded_rows(table, codes[zero : starts[end]], sizes[block:end])
        step = block
        while step < end:
            upto = min(step + together, end)
            a, b = starts[step], starts[upto]
            guess = decoded(scores(weights, features[a - zero : b - zero]), sizes[step:upto], trans, allowed, first)
            wrong = np.flatnonzero(guess != gold[a:b])
            if not len(wrong):
                step, together = upto, min(2 * together, BLOCK)
                continue
            right = step
            step = int(np.searchsorted(starts, a + wrong[0], side="right")) - 1
            x, y = starts[step], starts[step + 1]
            own, is_, was = features[x - zero : y - zero], gold[x:y], guess[x - a : y - a]
            for i in np.flatnonzero(was != is_):
                for tag, by in ((is_[i], 1), (was[i], -1)):
                    np.add.at(weights[:, tag], own[i], float(by))
                    change(own[i] * len(tags) + tag, by, step)
            for i in range(1, len(is_)):
                if (is_[i - 1], is_[i]) != (was[i - 1], was[i]):
                    for (p, q), by in (((is_[i - 1], is_[i]), 1), ((was[i - 1], was[i]), -1)):
                        trans[p, q] += by
                        change(np.array([weights.size + p * len(tags) + q]), by, step)
            together = max(4, (together + step - right + 1) // 2)
            step += 1
    at = np.flatnonzero(changes.any(axis=0))
    return at, np.rint((changes[0, at] - changes[1, at] / max(1, len(sizes))) * FINE).astype(np.int64)


def fit(texts: DataFrame, text: str = "text", spans: str = "spans", sample: int | None = None, epochs: int = EPOCHS) -> Tagger:
    """A tagger from texts with the spans that they should get. All their segments are learned from, unless a `sample` is
    asked for: so many with a span and so many without."""
    from cloakframe.sources.tables import small_batches, stage

    lines, shards = segment_lines(texts, text, spans), SHARDS
    if sample is None:
        chars = texts.agg(F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0))).first()[0]
        shards = max(SHARDS, -(-chars // SHARD_CHARS))
    else:
        turn = F.xxhash64("line", "tags")
        picked = [lines.where(f"tags {kind} ''").orderBy(turn, "line", "tags").limit(sample) for kind in ("<>", "=")]
        lines = picked[0].unionByName(picked[1])
    rows = stage(packed(lines, shards), "tagger", small=True)
    names = [r["names"] for r in rows.select("names").collect()]  # a short text for each shard
    types = sorted({n[2:] for own in names for n in own.split(" ") if n != "O"})
    tags = tag_names(types)
    weights, trans = np.zeros(BUCKETS * len(tags)), np.zeros((len(tags), len(tags)))
    for _ in range(epochs if types else 0):
        at = np.flatnonzero(weights)
        now = at, weights[at]

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(BUCKETS * len(tags))
            own[now[0]] = now[1]
            own = own.reshape(BUCKETS, len(tags))
            for batch in batches:
                for i in range(len(batch)):
                    at, by = _pass({c: batch.column(c)[i].as_py() for c in batch.schema.names}, tags, own, trans)
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(by, pa.int64())], ["at", "by"])

        with small_batches(texts.sparkSession):
            changed = rows.mapInArrow(learn, "at long, by long").groupBy("at").agg(F.sum("by").alias("by")).toArrow()  # BUCKETS a tag at most
        at, by = changed["at"].to_numpy(), changed["by"].to_numpy() / FINE / len(names)
        inner = at < len(weights)
        weights[at[inner]] += by[inner]
        trans = trans.copy()
        trans.ravel()[at[~inner] - len(weights)] += by[~inner]
    at = np.flatnonzero(weights)
    return Tagger(types, at, weights[at], trans)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
