"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

A text's code points are lower-cased, everything but letters becomes one space, and n-grams of 1 to 3 go to BUCKETS
hashed features of weight (1 + log tf) * idf, normalised. Document frequencies cover every row that may be learned
from. Weights are trained by follow-the-regularised-leader (per-coordinate rates, elastic-net penalty, so most are 0)
on a sample of about SAMPLE rows per language, in one task; a quarter of the sample sets the temperature by which
scores are divided, so that the probability of the best language can be read as confidence.

Defined results: a text that is null or has no letter is `und` with score 0; without rows to learn from all are `und`;
of languages with equal scores the first in code point order wins; equal texts get equal results; an empty table gives
no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import column, freeing, slices

BUCKETS = 1 << 15
#: Rows per language that the weights are trained on, about.
SAMPLE = 800
EPOCHS = 4
#: Rate, its offset, and the two penalties of the training.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
UNKNOWN = "und"
_SPACE = 32


@cache
def _folded() -> np.ndarray:
    """For each code point its lower case, or a space if it isn't a letter."""
    out = np.full(0x110000, _SPACE, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of a text's n-grams; None if it has no letter."""
    if not text:
        return None
    points = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    padded = np.concatenate([[_SPACE], points, [_SPACE]]).astype(np.uint32)
    x = padded[np.concatenate([[True], (padded[1:] != _SPACE) | (padded[:-1] != _SPACE)])]
    if len(x) <= 1:
        return None
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + x[2:] * np.uint32(0x27D4EB2F)
    one = x * np.uint32(0x165667B1)
    mixed = np.concatenate([one ^ (one >> 15), two ^ (two >> 13), three ^ (three >> 14)]) * np.uint32(0x2C1B3C6D)
    counts = np.bincount(mixed >> np.uint32(32 - 15), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf
    return (v / (np.sqrt((v * v).sum()) or 1)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS by languages
    temperature: float

    def scores(self, text: str | None) -> np.ndarray | None:
        grams = gram_counts(text)
        if grams is None or not self.langs:
            return None
        return _weights(grams[1], self.idf[grams[0]]) @ self.weights[grams[0]]


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """For each bucket the number of rows of (text) that have it; at most BUCKETS rows a task leave the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                if (grams := gram_counts(text.as_py())) is not None:
                    total[grams[0]] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows.select("text").mapInArrow(freeing(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, seed: int = 3) -> np.ndarray:
    """Weights from (buckets, values, language number) by follow-the-regularised-leader."""
    z, n = np.zeros((BUCKETS, n_langs)), np.zeros((BUCKETS, n_langs))

    def weights(z_: np.ndarray, n_: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z_) <= L1, 0.0, (np.sign(z_) * L1 - z_) / ((BETA + np.sqrt(n_)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            at, v, lang = samples[i]
            w = weights(z[at], n[at])
            error = _softmax(v @ w)
            error[lang] -= 1
            g = v[:, None] * error[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(z, n).astype(np.float32)


def temperature(scores: np.ndarray, langs: np.ndarray) -> float:
    """The divisor of scores with the least log loss, by a search over a fine scale."""
    scale = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    if not len(langs):
        return 1.0
    loss = [-np.log(_softmax(scores / t)[np.arange(len(langs)), langs] + 1e-12).mean() for t in scale]
    return float(scale[int(np.argmin(loss))])


def fit(rows: DataFrame, sample: int = SAMPLE, seed: int = 3) -> Model:
    """A model from rows (doc_id, text, lang), lang not null."""
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    n_docs = sum(counts.values())
    idf = np.log((1 + n_docs) / (1 + document_frequencies(rows))) + 1
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), 1.0)
    # about `sample` rows a language, by the hash of their ids
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / counts[lang]))])
    turn = F.xxhash64("doc_id", F.lit(seed))
    picked = rows.withColumn("turn", turn).where((F.shiftrightunsigned("turn", 33) / 2**31) <= F.element_at(share, F.col("lang")))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(t, lang, g) for t, lang, text in zip(*(batch.column(c).to_pylist() for c in ("turn", "lang", "text")), strict=True) if (g := gram_counts(text)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2][0].astype(np.int32) for x in out], pa.list_(pa.int32())), pa.array([x[2][1].astype(np.int32) for x in out], pa.list_(pa.int32()))],
                ["turn", "lang", "buckets", "counts"],
            )

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("turn", "ascending"), ("lang", "ascending")])
        number = {lang: i for i, lang in enumerate(langs)}
        samples = []
        for lang, at, n in zip(*(table[c].to_pylist() for c in ("lang", "buckets", "counts")), strict=True):
            at_ = np.array(at, dtype=np.int64)
            samples.append((at_, _weights(np.array(n), idf[at_]), number[lang]))
        kept, held = [x for i, x in enumerate(samples) if i % 4], samples[::4]
        w = train(kept, len(langs), seed)
        raw = np.array([v @ w[at] for at, v, _ in held]).reshape(-1, len(langs))
        t = temperature(raw, np.array([lang for _, _, lang in held], dtype=np.int64))
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary()), "temperature": pa.array([t])})

    found = picked.select("turn", "lang", "text").mapInArrow(freeing(grams), "turn long, lang string, buckets array<int>, counts array<int>")
    got = found.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(learn, "weights binary, temperature double").collect()
    if not got:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), 1.0)
    return Model(langs, idf, np.frombuffer(got[0]["weights"], np.float32).reshape(BUCKETS, len(langs)), got[0]["temperature"])


def predict(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to rows; `text` names their text, a column that goes or a field of a struct that stays."""
    kinds = [f for f in rows.schema if f.name != text]
    names = [f.name for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            langs, scores = [], []
            for own in column(batch, text):
                raw = model.scores(own.as_py())
                p = None if raw is None else _softmax(raw.astype(np.float64) / model.temperature)
                langs.append(UNKNOWN if p is None else model.langs[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return rows.mapInArrow(freeing(run), T.StructType(kinds).add("lang_pred", "string").add("score", "double"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return fit(rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), sample)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return predict(rows, model)
