"""Exact top-k search by inner product: columnar branch and bound.

Vectors turn into integers and lie in vertical layout, one row of numbers per dimension. A query's scores grow block
of dimensions by block; after each block the mass that remains in query and candidate bounds what a candidate can
still gain (Cauchy-Schwarz), and candidates that can't reach the query's floor are dropped from the columns. The floor is
the k-th best score so far, or the k-th best lower bound.

Candidates are dealt once, by hash into groups of about GROUP_ROWS, of which a task holds one in vertical layout. Queries
are copied to the groups and stream past, so what is shuffled grows with the queries times the groups; candidates are
copied only for each QUERY_ROWS queries, which bounds the time of a task. A first search over one in SAMPLE candidates
gives each query a floor that holds in all groups: a group then returns only what reaches it, about k * SAMPLE rows a query
in all instead of k a group. The sample bounds and decides nothing: every candidate is searched.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id;
vectors of unequal length are compared over the shared leading components; an empty vector scores 0; of equal scores the
smaller id wins. Rows with equal ids are each other's own row and never meet; as candidates each counts, as a query the
smallest of their vectors does. An empty table gives no rows. Sums beyond 64 bits wrap around. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import freeing, group_starts

GROUP_ROWS = 100_000
QUERY_ROWS = 1_000_000
#: One in so many candidates is searched first, for the floors.
SAMPLE = 64
#: Candidates that are scored together, dimensions of a block, and queries that share the first block's products.
CHUNK, BLOCK, QUERY_BATCH = 8_192, 16, 64
#: Candidates are compacted when at most this part of them is left.
DENSE = 0.7
#: Up to here sums of products of integers are exact in doubles.
EXACT = 2.0**52


def scaled(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): usable vectors with components floor(scale * x)."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & usable)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _columns(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vertical layout: dimensions by rows, shorter vectors filled with 0."""
    flat = vectors.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], vectors.type)
    lengths = np.diff(flat.offsets.to_numpy())
    numbers = flat.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((int(lengths.max(initial=0)), len(lengths)), dtype=np.int64)
    if len(lengths):
        rows = np.repeat(np.arange(len(lengths)), lengths)
        out[np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths), rows] = numbers
    return out


def _rest(columns: np.ndarray, block: int) -> list[np.ndarray]:
    """Length of what remains of each vector behind each block of dimensions."""
    squares = columns.astype(np.float64) ** 2
    return [np.sqrt(squares[d + block :].sum(axis=0)) for d in range(0, len(columns), block)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Group:
    """Candidates in vertical layout."""

    def __init__(self, vectors: pa.ChunkedArray, ids: np.ndarray):
        self.ids, self.columns = ids, _columns(vectors)
        self.rest = _rest(self.columns, BLOCK)
        self.longest = float(np.sqrt((self.columns.astype(np.float64) ** 2).sum(axis=0)).max(initial=0.0))
        self.doubles: np.ndarray | None = None

    def numbers(self, asked: np.ndarray) -> np.ndarray:
        """The columns as doubles where all sums stay exact, as they have a fast product, else as they are."""
        longest = float(np.sqrt((asked.astype(np.float64) ** 2).sum(axis=0)).max(initial=0.0))
        if longest * self.longest >= EXACT:
            return self.columns
        if self.doubles is None:
            self.doubles = self.columns.astype(np.float64)
        return self.doubles

    def search(self, asked: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best candidates that reach the floor, best first, of each query, a column of `asked`.
        A floor of NaN is none."""
        numbers = self.numbers(asked)
        dims = min(len(asked), len(numbers))
        own = np.ascontiguousarray(asked[:dims].T, dtype=numbers.dtype)
        squares = own.astype(np.float64) ** 2
        own_rest = [np.sqrt(squares[:, d + BLOCK :].sum(axis=1)) for d in range(0, max(dims, 1), BLOCK)]
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in query_ids]
        for start in range(0, len(self.ids), CHUNK):
            stop = min(start + CHUNK, len(self.ids))
            first = own[:, :BLOCK] @ numbers[: min(BLOCK, dims), start:stop]
            for i, query_id in enumerate(query_ids):
                floor = floors[i]
                if len(best[i][1]) == k:
                    floor = np.fmax(floor, best[i][1][-1])
                alive, scores = self._grown(own[i], [r[i] for r in own_rest], first[i], numbers[:dims, start:stop], start, floor, query_id, k)
                ids = np.concatenate([best[i][0], self.ids[start:stop][alive]])
                scores = np.concatenate([best[i][1], scores.astype(np.int64)])
                top = _best(scores, ids, k)
                best[i] = ids[top], scores[top]
        return best

    def _grown(
        self, own: np.ndarray, own_rest: list[float], partial: np.ndarray, columns: np.ndarray, start: int, floor: float, query_id: int, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) in a chunk of candidates that reach the floor, whose first block is summed in `partial`."""
        stop = start + len(partial)
        alive = None  # all
        for b, d in enumerate(range(0, max(len(columns), 1), BLOCK)):
            if b:
                part = columns[d : d + BLOCK]
                partial = partial + own[d : d + BLOCK] @ (part if alive is None else part[:, alive])
            rest = self.rest[b][start:stop] if b < len(self.rest) else np.zeros(stop - start)
            more = own_rest[b] * (rest if alive is None else rest[alive]) * (1 + 1e-9) + 1
            if floor != floor and len(partial) > k + 1:  # no floor yet: the k-th best lower bound, one more for the query's own row
                low = partial - more
                bound = np.partition(low, len(low) - k - 1)[len(low) - k - 1]
            else:
                bound = floor
            if bound == bound:
                keep = partial + more >= bound
                left = np.count_nonzero(keep)
                if left <= DENSE * len(keep):
                    kept = np.flatnonzero(keep)
                    alive, partial = kept if alive is None else alive[kept], partial[kept]
        if alive is None:
            alive = np.arange(len(partial))
        last = self.ids[start:stop][alive] != query_id
        if floor == floor:
            last &= partial >= floor
        return alive[last], partial[last]


def _past_groups(k: int):
    """A function over Arrow batches sorted by cell, in which a cell's candidates stand before the queries that meet them."""

    def found(group: Group, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, asked.num_rows, QUERY_BATCH):
            part = asked.slice(at, QUERY_BATCH)
            ids = part.column("vec_id").to_numpy()
            floors = part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
            hits = group.search(_columns(pa.chunked_array([part.column("v")])), ids, floors, k)
            yield pa.RecordBatch.from_pydict({
                "query_id": np.repeat(ids, [len(i) for i, _ in hits]),
                "vec_id": np.concatenate([np.empty(0, np.int64), *(i for i, _ in hits)]),
                "score": np.concatenate([np.empty(0, np.int64), *(s for _, s in hits)]),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, group = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = group_starts(batch, ["cell", "asks"])
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                rows = batch.slice(int(start), int(end - start))
                if rows.column("cell")[0].as_py() != cell:
                    cell, held, group = rows.column("cell")[0].as_py(), [], None
                if not rows.column("asks")[0].as_py():
                    held.append(rows.select(["vec_id", "v"]))
                    continue
                if held:
                    table = pa.Table.from_batches(held)
                    group, held = Group(table["v"], table["vec_id"].to_numpy()), []
                if group is not None:
                    yield from found(group, rows)

    return freeing(run)


def _met(vectors: DataFrame, asked: DataFrame, n_vectors: int, n_asked: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each cell the k best candidates of its queries that reach their floors."""
    n_groups = max(1, -(-n_vectors // GROUP_ROWS))
    n_slices = max(1, -(-n_asked // QUERY_ROWS), -(-8 // n_groups))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group, part = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_groups)), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n_slices))
    cell = (F.col("g") * n_slices + F.col("h")).cast("int").alias("cell")
    left = vectors.select("vec_id", "v", F.lit(None).cast("long").alias("floor"), group.alias("g"), each(n_slices).alias("h"))
    right = asked.select("vec_id", "v", "floor", each(n_groups).alias("g"), part.alias("h"))
    rows = left.select(cell, F.lit(False).alias("asks"), "vec_id", "v", "floor").unionByName(
        right.select(cell, F.lit(True).alias("asks"), "vec_id", "v", "floor")
    )
    dealt = rows.repartitionById(n_groups * n_slices, "cell").sortWithinPartitions("cell", "asks")
    return dealt.mapInArrow(_past_groups(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of `vectors` for each row of `queries`; both have vec_id, v."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n_vectors, n_asked = vectors.count(), queries.count()
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(SAMPLE)) == 0)
    none = asked.withColumn("floor", F.lit(None).cast("long"))
    floors = best(_met(sample, none, n_vectors // SAMPLE, n_asked, k)).where(F.col("rank") == k)
    bounded = asked.join(floors.select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")), "vec_id", "left")
    return best(_met(vectors, bounded, n_vectors, n_asked, k)).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
