"""Ranked lexical search with range-maximum tables, best interval first.

Documents are dealt to shards of about SHARD_DOCS. A shard keeps a posting list for each query term: places of documents
in the shard with the term's integer impact there, and over the lists sparse tables that answer range maxima in two
reads. A query starts with the whole shard as one interval. The sum of its terms' range maxima bounds every score in an
interval; the intervals with the highest bounds are taken first, each is split at the document of its largest impact,
that document is scored exactly, and the two rests get bounds of their own. An interval whose bound is under the k-th
best score is dropped. Documents that share their rarest terms stand side by side, so that bounds fall quickly.

Only query terms have lists. Queries are taken in groups of about GROUP_BYTES of text, whose terms every task may know;
each document is read once a group, goes to one shard, and queries are copied past the shards.

Defined results: null, and texts without a term, have no terms and no rank; a null document id orders before all others;
rows with equal ids are documents of their own; items equal in id and text are one; items of one id with different
texts are ranked each on its own; without documents or items there are no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import NULL_ID, freeing, slices, staged

SHARD_DOCS = 16_384
GROUP_BYTES = 8 << 20
#: Intervals that are split together, at most.
FRONT = 256

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Terms of a text: runs of ASCII letters, digits and all characters beyond ASCII; A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class RangeMaxima:
    """Places of the largest number of any range, from a sparse table of power-of-two ranges."""

    def __init__(self, numbers: np.ndarray, longest: int):
        self.numbers = numbers
        rows = [np.arange(len(numbers), dtype=np.int32)]
        width = 1
        while 2 * width <= longest:
            last, here = rows[-1], rows[-1].copy()
            other = last[width:]
            bigger = numbers[other] > numbers[last[: len(other)]]
            here[: len(other)][bigger] = other[bigger]
            rows.append(here)
            width *= 2
        self.table = np.concatenate(rows)
        self.log = np.zeros(longest + 2, dtype=np.int64)
        for i in range(2, longest + 2):
            self.log[i] = self.log[i >> 1] + 1

    def at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of the largest of numbers[left:right]; ranges are not empty."""
        level = self.log[right - left]
        row = level * len(self.numbers)
        a, b = self.table[row + left], self.table[row + right - (1 << level)]
        return np.where(self.numbers[b] > self.numbers[a], b, a)


class Shard:
    """Posting lists of a shard, one after the other, and their range maxima."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int):
        """counts: postings of each document; term, tf: postings, document by document."""
        doc = np.repeat(np.arange(len(ids)), counts)
        df = np.bincount(term, minlength=1)
        # a document's place follows from its rarest term and the next one
        by_rarity = np.lexsort((term, df[term], doc))
        firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        rare = [np.full(len(ids), -1), np.full(len(ids), -1)]
        for k in range(2):
            has = counts > k
            rare[k][has] = term[by_rarity[firsts[has] + k]]
        place = np.empty(len(ids), np.int64)
        order = np.lexsort((ids, sizes, rare[1], rare[0]))
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        m = 25 + (75 * sizes * n_docs) // max(1, n_terms)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        by_list = np.lexsort((place[doc], term))
        self.doc, self.impact = place[doc][by_list], impact[by_list]
        listed, starts = np.unique(term[by_list], return_index=True)
        ends = np.append(starts[1:], len(by_list))
        self.lists = {int(t): (int(a), int(b)) for t, a, b in zip(listed, starts, ends, strict=True)}
        self.number = {int(t): i for i, t in enumerate(listed)}
        self.key = np.repeat(np.arange(len(listed)), ends - starts) * len(ids) + self.doc
        self.maxima = RangeMaxima(self.impact, int((ends - starts).max(initial=1)))

    def _bounds(self, left: np.ndarray, right: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the range maxima of each row of ranges, and the document of the largest one."""
        some = right > left
        values, docs = np.zeros(left.shape, np.int64), np.zeros(left.shape, np.int64)
        at = self.maxima.at(left[some], right[some])
        values[some], docs[some] = self.impact[at], self.doc[at]
        values *= weights
        return values.sum(axis=1), docs[np.arange(len(docs)), values.argmax(axis=1)]

    def search(self, term: list[int], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents with a score above 0, best first."""
        known = [i for i, t in enumerate(term) if t in self.lists and weights[i] > 0]
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not known:
            return ids, scores
        own = np.array([weights[i] for i in known], dtype=np.int64)
        base = np.array([self.number[term[i]] for i in known], dtype=np.int64) * len(self.ids)
        left, right = (np.array([[self.lists[term[i]][side] for i in known]], dtype=np.int64) for side in (0, 1))
        bound, split = self._bounds(left, right, own)
        front = 8
        while len(bound):
            if len(bound) > front:
                order = np.argpartition(-bound, front - 1)
                now, later = order[:front], order[front:]
            else:
                now, later = np.arange(len(bound)), np.empty(0, np.int64)
            low, high, doc = left[now], right[now], split[now]
            at = np.clip(np.searchsorted(self.key, base + doc[:, None]), low, high)
            hit = (at < high) & (self.doc[np.minimum(at, len(self.doc) - 1)] == doc[:, None])
            found = (np.where(hit, self.impact[np.minimum(at, len(self.doc) - 1)], 0) * own).sum(axis=1)
            ids, scores = np.concatenate([ids, self.ids[doc]]), np.concatenate([scores, found])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
            floor = int(scores[-1]) if len(scores) == k else 1
            new_left, new_right = np.concatenate([low, at + hit]), np.concatenate([at, high])
            more, where = self._bounds(new_left, new_right, own)
            keep, stay = more >= floor, later[bound[later] >= floor]
            left, right = np.concatenate([left[stay], new_left[keep]]), np.concatenate([right[stay], new_right[keep]])
            bound, split = np.concatenate([bound[stay], more[keep]]), np.concatenate([split[stay], where[keep]])
            front = min(FRONT, 2 * front)
        return ids, scores


def described(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(id, n, terms, tfs): number of all terms of each document, and its query terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in slices(batches, "text"):
            sizes, own, often = [], [], []
            for t in batch.column("text"):
                all_ = terms(t.as_py())
                counted = Counter(all_)
                found = sorted((number(w), c) for w, c in counted.items() if w in vocabulary)
                sizes.append(len(all_))
                own.append([x[0] for x in found])
                often.append([x[1] for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))],
                ["id", "n", "terms", "tfs"],
            )

    id_ = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    rows = docs.select(id_.alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(freeing(run), "id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of rows (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [(i, t, n) for i, text in zip(*(batch.column(c).to_pylist() for c in ("item", "text")), strict=True) for t, n in Counter(terms(text)).items()]
            kinds = [pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], k) for c, k in enumerate(kinds)], ["item", "term", "times"])

    return items.mapInArrow(freeing(run), "item long, term binary, times long")


def _ranked(docs: DataFrame, asked: DataFrame, k: int, doc_id: str, text: str, shard_docs: int) -> DataFrame:
    """(item, doc, score): the k best documents of each shard for each item of rows (item, term, times)."""
    spark = docs.sparkSession
    vocabulary = {bytes(r["term"]): i for i, r in enumerate(asked.select("term").distinct().orderBy("term").collect())}
    numbers = spark.createDataFrame([(bytearray(t), i) for t, i in vocabulary.items()], "term binary, number int")
    index = staged(described(docs, vocabulary, doc_id, text))
    about = index.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = about["n"], about["terms"] or 0
    df = index.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    ratio = (F.lit(2.0 * n_docs + 2.0)) / (F.lit(2) * F.col("df") + 1)
    weighed = asked.join(F.broadcast(numbers), "term").join(df, "number")
    weighed = weighed.withColumn("weight", F.floor(F.lit(1000.0) * F.log(ratio)) * F.col("times"))
    queries = weighed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("number", "weight"))).alias("own"))
    shards = max(1, -(-n_docs // shard_docs))
    cells = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    rows = index.where(F.size("terms") > 0).select(
        F.pmod(F.xxhash64("id", "n", "terms"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "n",
        "terms", F.col("tfs").cast("array<long>").alias("nums"),
    ).unionByName(
        queries.select(cells.alias("shard"), F.lit(1).alias("kind"), F.col("item").alias("id"), F.lit(0).cast("long").alias("n"),
            F.col("own.number").alias("terms"), F.col("own.weight").alias("nums"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, place = None, None

        def built() -> Shard | None:
            if not held:
                return None
            table = pa.Table.from_batches(held).combine_chunks()
            own, tf = (table[c].chunk(0) for c in ("terms", "nums"))
            return Shard(table["id"].to_numpy(), table["n"].to_numpy(), np.diff(own.offsets.to_numpy()), own.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy(), n_docs, n_terms)

        for batch in batches:
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            at = np.stack([batch.column(c).to_numpy() for c in ("shard", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if place != at[a, 0]:
                    place, held, shard = at[a, 0], [], None
                if at[a, 1] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    shard, held = built(), []
                for item, term, nums in zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in ("id", "terms", "nums")), strict=True):
                    if shard is not None:
                        out.append((item, *shard.search(term, nums, k)))
            found = [np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found + [np.full(len(s), i) for i, _, s in out])), pa.array(np.concatenate(found + [d for _, d, _ in out])), pa.array(np.concatenate(found + [s for _, _, s in out]))],
                ["item", "doc", "score"],
            )

    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id")
    return rows.mapInArrow(freeing(run), "item long, doc long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each item."""
    own = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    own = staged(own)
    groups = max(1, -(-int(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES))
    own = staged(own.withColumn("item", F.monotonically_increasing_id()).withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups))))
    asked = staged(item_terms(own.select("item", "text")).join(own.select("item", "group"), "item"))
    found = None
    for group in range(groups):
        some = _ranked(docs, asked.where(F.col("group") == group).drop("group"), k, doc_id, text, shard_docs)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    doc = F.when(F.col("doc") != NULL_ID, F.col("doc"))
    return best.join(own.select("item", "item_id"), "item").select("item_id", "rank", doc.alias("doc_id"), "score")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), z AS (
  SELECT doc_id, w, len(w) AS n FROM d WHERE len(w) > 0
), g AS (
  SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM z
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM z)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g
), s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * nd) // l))))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term), g GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
