"""Near-equal embeddings by int8 tile products with rigorous error bounds.

Vectors are scaled to length 1 and rounded to int8 with a step of their own. What rounding left over is known for each
vector, so a product of two int8 vectors says between which two numbers the cosine lies. Tiles of such products, exact
integers, sort pairs into surely linked, surely not, and open; only open pairs are computed again in double precision.

Which tiles meet. Up to PIVOTS vectors, a sample, are pivots, and each vector belongs to the cell of its nearest pivot.
A cell is cut into blocks of about TILE rows, which stay in a task while visitors stream past: the rows of its own cell
in lower blocks, and rows of lower cells whose angle to the cell's pivot is at most the cell's radius and the
threshold's angle. By the triangle inequality no other row can be linked, so the sample decides about speed only: every
link is found. A task sends on how many links each row has and a spanning forest of them, never all pairs of a group;
equal vectors are one row with a count.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of
unequal length; a null id has no component (null) and is kept; rows with equal ids are vectors of their own, all kept if
theirs is the smallest id; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import freeing, staged
from cloakframe.llm.components import components

LEAST = 0.95
PIVOTS, PIVOT_ROWS = 1_024, 4_096
TILE, VISITORS = 4_096, 1_024
#: Groups of residents of similar steps in a tile.
BANDS = 4
#: What rounding of doubles can add to a bound.
SLACK = 1e-9


def numbers(vectors: DataFrame, vector: str) -> Column:
    """The vector as floats, or else as doubles."""
    kind = vectors.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(vector) if single else F.transform(F.col(vector), lambda c: c.cast("double"))


def usable(v: Column) -> Column:
    """Whether a vector can be linked."""
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda c: c != 0), F.lit(False))


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) for each length that vectors have."""
    ends = vectors.offsets.to_numpy()
    lengths, flat = np.diff(ends), vectors.flatten().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, (flat if len(at) == len(lengths) else flat[(ends[at] - ends[0])[:, None] + np.arange(n)]).reshape(-1, n)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by the largest component first, so that no square overflows."""
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantised:
    """Unit vectors with their int8 form: x = step * q + rest, |step * q| and |rest| known."""

    def __init__(self, x: np.ndarray):
        self.x = x
        step = np.abs(x).max(axis=1, keepdims=True) / 127
        self.q = np.rint(x / step).astype(np.int8)
        near = step * self.q
        self.step, self.near = step[:, 0], np.sqrt((near * near).sum(axis=1))
        self.rest = np.sqrt(((x - near) ** 2).sum(axis=1))

    def products(self, other: Quantised, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Integer products of all vectors with those of `other`; a sum of 1,024 of them is exact as a float."""
        out = None
        for d in range(0, self.q.shape[1], 1024):
            part = self.q[:, d : d + 1024].astype(np.float32) @ other.q[rows, d : d + 1024].astype(np.float32).T
            out = part if out is None else out.astype(np.float64) + part
        return out


class Tile(Quantised):
    """Residents in BANDS groups by step, so that one number bounds the step of a group well."""

    def __init__(self, x: np.ndarray):
        super().__init__(x)
        self.bands = [b for b in np.array_split(np.argsort(self.step, kind="stable"), BANDS) if len(b)]

    def linked(self, other: Quantised, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, int]:
        """(i, j): pairs of a row i of `other` and a resident j with a cosine of at least `least`, and how many were
        computed in full precision.

        x.y = (x' + r).(y' + s) = x'.y' + x'.s + r.y with |y| = 1, so x'.y' is off by |x'||s| + |r| at most. A first
        look takes the largest step and error of a band, so that a tile is compared with one number a row.
        """
        rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        computed = 0
        for band in self.bands:
            product = other.products(self, band)
            most = other.near * self.rest[band].max() + other.rest + SLACK
            floor = (least - most) / (other.step * self.step[band].max())
            i, j = np.nonzero(product >= (floor * (1 - 1e-6) - 1e-3).astype(product.dtype)[:, None])
            near, j = product[i, j] * (other.step[i] * self.step[band[j]]), band[j]
            error = other.near[i] * self.rest[j] + other.rest[i] + SLACK
            sure, open_ = near - error >= least, near + error >= least
            computed += int((open_ & ~sure).sum())
            for at in np.array_split(np.flatnonzero(open_ & ~sure), max(1, int((open_ & ~sure).sum()) // 16_384)):
                sure[at] = np.einsum("nd,nd->n", other.x[i[at]], self.x[j[at]]) >= least
            rows.append(i[sure])
            columns.append(j[sure])
        return np.concatenate(rows), np.concatenate(columns), computed


class Forest:
    """Which residents of a task are connected; visitors hang on for one batch."""

    def __init__(self, n: int):
        self.n, self.parent = n, list(range(n))

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, rows: np.ndarray, columns: np.ndarray, visitors: int | None = None) -> list[tuple[int, int]]:
        """Of the links (row, resident), some that connect all that was not connected; rows are residents, or among
        `visitors` rows that stay for this call."""
        shift = 0 if visitors is None else self.n
        self.parent += range(self.n, self.n + (visitors or 0))
        out = []
        while len(rows):
            # the first link of each row and of each column, then those that still join two trees
            first = np.unique(np.concatenate([np.unique(rows, return_index=True)[1], np.unique(columns, return_index=True)[1]]))
            for i, j in zip(rows[first].tolist(), columns[first].tolist(), strict=True):
                a, b = self._root(i + shift), self._root(j)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    out.append((i, j))
            label = np.array([self._root(i) for i in range(len(self.parent))])
            open_ = label[rows + shift] != label[columns]
            rows, columns = rows[open_], columns[open_]
        if visitors is not None:
            del self.parent[self.n :]
        return out


def pivots_of(classes: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of up to PIVOTS rows, far from one another, of the most frequent length among 8 * PIVOTS sampled."""
    wanted = min(PIVOTS, max(1, n // PIVOT_ROWS))
    rows = classes.orderBy(F.xxhash64("cls", F.lit(11)), "cls").limit(8 * wanted).select("v").collect()
    if not rows:
        return np.empty((0, 0))
    lengths = [len(r["v"]) for r in rows]
    usual = max(set(lengths), key=lambda x: (lengths.count(x), x))
    x = unit(np.array([r["v"] for r in rows if len(r["v"]) == usual]))
    picked, near = [0], x @ x[0]
    while len(picked) < min(wanted, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    return x[picked]


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def in_cells(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell and angle to rows (cls, n, v); rows that are not as long as the pivots are in cell -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, math.pi)
            for at, x in matrices(batch.column("v")):
                if x.shape[1] == pivots.shape[1]:
                    all_ = _angles(unit(x), pivots)
                    cell[at] = all_.argmin(axis=1)
                    angle[at] = all_.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    kinds = [*classes.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    return classes.mapInArrow(freeing(run), T.StructType(kinds))


def dealt(placed: DataFrame, pivots: np.ndarray, least: float, tile: int) -> DataFrame:
    """(place, visits, cls, n, v): each row in its own block, and as a visitor in the blocks it has to meet."""
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    blocks = {c: -(-r["n"] // tile) for c, r in cells.items()}
    theta = math.acos(max(-1.0, min(1.0, least))) + 1e-6
    radius = np.array([cells[c]["radius"] if c in cells else -9.0 for c in range(len(pivots))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cell").to_numpy()
            # a place is cell * 2 ** 32 + block
            block = np.array([h % blocks[int(c)] for h, c in zip(batch.column("h").to_pylist(), own, strict=True)], dtype=np.int64)
            to = [[(int(c) << 32) + b for b in range(int(at) + 1, blocks[int(c)])] for c, at in zip(own, block, strict=True)]
            for at, x in matrices(batch.column("v")):
                if x.shape[1] != pivots.shape[1]:
                    continue
                near = _angles(unit(x), pivots) <= radius + theta
                near &= np.arange(len(pivots)) > own[at][:, None]
                for i, j in zip(*np.nonzero(near), strict=True):
                    to[at[i]] += [(int(j) << 32) + b for b in range(blocks[int(j)])]
            place = pa.array((own.astype(np.int64) << 32) + block)
            kept = [batch.column(c) for c in ("cls", "n", "v")]
            yield pa.RecordBatch.from_arrays([place, *kept, pa.array(to, pa.list_(pa.int64()))], ["place", "cls", "n", "v", "to"])

    hashed = placed.select("cls", "n", "v", "cell", F.pmod(F.xxhash64("cls", F.lit(13)), F.lit(1 << 40)).alias("h"))
    kinds = [T.StructField("place", T.LongType()), *(placed.schema[c] for c in ("cls", "n", "v")), T.StructField("to", T.ArrayType(T.LongType()))]
    rows = staged(hashed.mapInArrow(freeing(run), T.StructType(kinds)))
    stay = rows.select("place", F.lit(0).alias("visits"), "cls", "n", "v")
    return stay.unionByName(rows.select(F.explode("to").alias("place"), F.lit(1).alias("visits"), "cls", "n", "v"))


class Block:
    """The residents of a place, and what has been found about them."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.cls, self.n, self.rows = rows.column("cls").to_numpy(), rows.column("n").to_numpy().astype(np.float64), rows
        self.links = np.zeros(len(self.cls))
        self.forest = Forest(len(self.cls))
        self.parts = [(at, Tile(unit(x))) for at, x in matrices(rows.column("v"))]

    def meet(self, batch: pa.RecordBatch, own: int | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(ids, links, edges): how many links the rows of a batch have here, and links that connect; own: where the
        batch begins among the residents, which meet all residents."""
        cls, n = batch.column("cls").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
        rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, x in matrices(batch.column("v")):
            other = Quantised(unit(x))
            for where, part in self.parts:
                if part.x.shape[1] == x.shape[1]:
                    i, j, _ = part.linked(other, self.least)
                    rows.append(at[i])
                    columns.append(where[j])
        i, j = np.concatenate(rows), np.concatenate(columns)
        if own is not None:
            i, j = i[i + own != j], j[i + own != j]
            edges = self.forest.join(i + own, j)
            edges = [(int(self.cls[a]), int(self.cls[b])) for a, b in edges]
        else:
            edges = [(int(cls[a]), int(self.cls[b])) for a, b in self.forest.join(i, j, len(cls))]
            self.links += np.bincount(j, n[i], len(self.cls))
        return cls, np.bincount(i, self.n[j], len(cls)).astype(np.int64), edges

    least = LEAST


def tile_links(rows: DataFrame, least: float) -> DataFrame:
    """(cls, links, other) of rows (place, visits, cls, n, v): parts of each row's number of links, and the links of a
    spanning forest of each task (links null)."""

    def found(cls: np.ndarray, links: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
        some = links > 0
        cls, links = cls[some].tolist() + [u for u, _ in edges], links[some].tolist() + [None] * len(edges)
        other = [None] * int(some.sum()) + [v for _, v in edges]
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], ["cls", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, block = None, [], None

        def settle() -> Iterator[pa.RecordBatch]:
            """Residents are complete: they meet one another."""
            nonlocal block, held
            block, held = Block(held), []
            block.least = least
            for s in range(0, block.rows.num_rows, VISITORS):
                yield found(*block.meet(block.rows.slice(s, VISITORS), s))

        def leave() -> Iterator[pa.RecordBatch]:
            if held:
                yield from settle()
            if block is not None:
                yield found(block.cls, block.links.astype(np.int64), [])

        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("place", "visits")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if place != at[a, 0]:
                    yield from leave()
                    place, held, block = at[a, 0], [], None
                if at[a, 1] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    yield from settle()
                for s in range(a, b, VISITORS):
                    if block is not None:
                        yield found(*block.meet(batch.slice(s, min(b, s + VISITORS) - s)))
        yield from leave()

    dealt_rows = rows.repartition("place").sortWithinPartitions("place", "visits", "cls")
    return dealt_rows.mapInArrow(freeing(run), "cls long, links long, other long")


def dedup_embeddings(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = LEAST, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; `least` must be positive."""
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    every = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), numbers(vectors, vector).alias("v"))
    can = F.col("vec_id").isNotNull() & usable(F.col("v"))
    rows = every.where(can)
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = staged(classes)
    classes = staged(classes.withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    pivots = pivots_of(classes, n)
    placed = staged(in_cells(classes.select("cls", "n", "v"), pivots))
    found = staged(tile_links(dealt(placed, pivots, least, tile), least))
    links = found.where("links is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    trees = components(found.where("other is not null").select(F.col("cls").alias("u"), F.col("other").alias("v")))
    tree = classes.select("cls", "id", "n", "v").join(trees.withColumnRenamed("id", "cls"), "cls", "left")
    tree = tree.withColumn("component", F.coalesce("component", "cls")).join(links, "cls", "left")
    least_id = tree.groupBy("component").agg(F.min("id").alias("component_id"))
    done = tree.join(least_id, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked_rows = rows.join(done, "v").select("vec_id", "n_links", "component_id")
    alone = every.where(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked_rows.unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE x AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM x a JOIN x b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), r AS (
  SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u
), n AS (
  SELECT u, count(*) AS n FROM l GROUP BY u
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT u AS vec_id, min(w) AS component_id FROM r GROUP BY u) USING (vec_id) LEFT JOIN n ON n.u = vec_id
"""
