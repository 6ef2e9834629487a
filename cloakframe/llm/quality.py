"""Quality classifier: Bradley-Terry pairwise ranking of documents.

Features describe a text's shape: shares of character classes and of their pairs (letters by case, digits, blanks,
line feeds, each ASCII sign), word lengths, repeated words and lines. Preference pairs of a good and a bad labelled
document give feature differences; logistic loss on them fits weights whose product with a text's features is its
score. The threshold is a quantile of the scores of all documents: a given one, or else the share of bad rows among all
labels that may be learned from. Scores are reported as probabilities, moved so that the threshold lies at 0.3.

Pairs come from about SAMPLE labelled rows of each kind, in one task.

Defined results: a null text counts as empty; an empty text has features of its own and a score; without labels of
both kinds all scores are 0.5; several labels of a document count as several rows; equal texts get equal scores; an
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import freeing, slices, staged

#: Labelled rows of each kind that pairs are drawn from, about; pairs per bad row; steps of the fit.
SAMPLE, PAIRS, STEPS = 3_000, 8, 400
THRESHOLD = 0.3
PENALTY = 1e-4
_CLASSES = 40
FEATURES = _CLASSES + _CLASSES * _CLASSES + 9


@cache
def _class_of() -> np.ndarray:
    """For each code point a class: letters by case, digits, blank, line feed, other signs, 33 for ASCII signs."""
    out = np.full(0x110000, 5, dtype=np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = 1 if ch != ch.lower() else 0
        elif ch.isdigit():
            out[c] = 2
        elif ch == "\n":
            out[c] = 4
        elif ch.isspace():
            out[c] = 3
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[signs] = 6 + np.arange(len(signs))
    return out


def features(text: str | None) -> np.ndarray:
    text = text or ""
    out = np.zeros(FEATURES, dtype=np.float32)
    kinds = _class_of()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    n = max(1, len(kinds))
    out[:_CLASSES] = np.sqrt(np.bincount(kinds, minlength=_CLASSES)[:_CLASSES] / n)
    pairs = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES) if len(kinds) > 1 else 0
    out[_CLASSES : _CLASSES + _CLASSES * _CLASSES] = np.sqrt(pairs / n)
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = sum(map(len, words)) / w
    out[-9:] = (
        np.log1p(len(words)) / 10,
        lengths / 10,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)) / 10,
        min(1.0, len(words) / 20),
        float(not words),
    )
    return out


def fit_pairs(good: np.ndarray, bad: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights of the features from preference pairs, by logistic loss with a small penalty (Adam, whole batch)."""
    rng = np.random.default_rng(seed)
    i = np.tile(np.arange(len(bad)), PAIRS)
    diff = good[rng.integers(0, len(good), len(i))] - bad[i]
    w, m, v = np.zeros(diff.shape[1]), np.zeros(diff.shape[1]), np.zeros(diff.shape[1])
    for t in range(1, STEPS + 1):
        rows = diff if len(diff) <= 4096 else diff[rng.integers(0, len(diff), 4096)]
        p = 1 / (1 + np.exp(np.clip(rows @ w, -30, 30)))
        g = -(p @ rows) / len(rows) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit(rows: DataFrame, marks: DataFrame, sample: int = SAMPLE, seed: int = 5) -> tuple[np.ndarray, float] | None:
    """(weights, share of bad rows among all labels) from (doc_id, text) and (doc_id, good), or None without both kinds."""
    counts = {r["good"]: r["n"] for r in marks.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("good"), min(1.0, sample / counts[True])).otherwise(min(1.0, sample / counts[False]))
    turn = F.xxhash64("doc_id", F.lit(seed))
    picked = marks.withColumn("turn", turn).where((F.shiftrightunsigned("turn", 33) / 2**31) <= share)
    picked = rows.join(F.broadcast(picked), "doc_id")  # about twice the sample

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [features(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("good"), pa.array(data, pa.binary())], ["turn", "good", "x"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("turn", "ascending"), ("good", "ascending"), ("x", "ascending")])
        x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
        good = np.array(table["good"].to_pylist())
        if good.all() or not good.any():
            return pa.table({"weights": pa.array([], pa.binary())})
        return pa.table({"weights": pa.array([fit_pairs(x[good], x[~good], seed).tobytes()], pa.binary())})

    found = picked.select("turn", "good", "text").mapInArrow(freeing(describe), "turn long, good boolean, x binary")
    got = found.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(learn, "weights binary").collect()
    return (np.frombuffer(got[0]["weights"], np.float64), counts[False] / sum(counts.values())) if got else None


def raw_scores(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, raw) of rows (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = [float(features(t.as_py()) @ weights) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(raw, pa.float64())], ["doc_id", "held_out", "raw"])

    return rows.mapInArrow(freeing(run), "doc_id long, held_out boolean, raw double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, quantile: float | None = None) -> DataFrame:
    """(doc_id, held_out, raw, score, predicted) of every document.

    The threshold is the `quantile` of all documents' scores, by default at the share of bad rows among the labels that
    may be learned from: as many documents of the corpus fall under it.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(label) == 1).alias("good"))
    marks = marks.where(F.col("good").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    model = fit(rows.select("doc_id", "text"), marks, sample)
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.0).alias("raw"), F.lit(0.5).alias("score"))
    else:
        weights, bad_share = model
        raw = staged(raw_scores(rows, weights))
        part = F.lit(float(bad_share if quantile is None else quantile))
        at = raw.agg(F.percentile_approx("raw", part, F.lit(10_000)).alias("at")).first()["at"]
        above = float(np.log(THRESHOLD / (1 - THRESHOLD))) + F.col("raw") - F.lit(float(at or 0))
        scored = raw.withColumn("score", 1 / (1 + F.exp(-above)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
