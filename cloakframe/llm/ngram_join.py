"""N-gram Jaccard join: near-equal documents by a count-vector R-tree.

A document's set holds its distinct word n-grams, hashed to 64 bits. Sets that are equal are one class, and only one
document of each class takes part in the search.

Candidates. Sets that are similar enough share a member among their first ones in any common order, the first
n - ceil(percent * n / 100) + 1 of n. The order puts rare members first, by a sketch of document frequencies (SKETCH
counters, filled by all documents), so that these keys are rare. Documents with a key in common meet as points: members
are hashed into GROUPS groups, and a set's group counts are a point of an R-tree. The sum of the smaller coordinates
bounds the overlap from above, for a point by its counts and for a node by its largest ones; pairs that pass are
verified with whole sets.

Groups of copies. First each document is verified with one partner only: of the smallest ids of its keys whose points
allow a link, the one that it shares most keys with. Components of these links leave few keys with documents of more than one component; only those go through
the R-tree, in blocks of at most BLOCK documents, and pairs inside a component are left out. No link between different
components is lost, and no group gives all its pairs.

Defined results: a null or empty text has an empty set and is linked with nothing; fewer words than n make one n-gram;
a row with a null id has no component (null); rows with equal ids are searched for each on its own and count as linked,
so they have one component with the links of all; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import freeing, group_starts, if_small, slices, small_batches, sorted_groups, staged
from cloakframe.llm.components import components
from cloakframe.llm.substring_dedup import WordCodes, mixed, runs_of

#: Least similarity in hundredths, and words of an n-gram.
PERCENT, NGRAM = 90, 3
GROUPS, BLOCK, FANOUT = 128, 512, 16
#: Counters of document frequencies.
SKETCH = 1 << 16
#: Members of one task's share of a partner's documents.
SHARE = 5_000


def shingle_set(text: str | None, codes: WordCodes, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams; ASCII letters count in lower case."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes know the six ASCII blanks only
    if not own:
        return np.empty(0, np.uint64)
    k = min(n, len(own))
    return np.unique(mixed(runs_of(codes.of(own), k) + np.uint64(k)))


def _counter(members: np.ndarray) -> np.ndarray:
    return ((members >> np.uint64(7)) & np.uint64(SKETCH - 1)).astype(np.int64)


def frequency_sketch(rows: DataFrame, n: int) -> np.ndarray:
    """Documents of rows (text) by counter of their members; at most SKETCH rows a task leave the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = WordCodes(), np.zeros(SKETCH, dtype=np.int64)
        for batch in slices(batches, "text", 2 << 20):
            at = np.concatenate([np.empty(0, np.int64), *(_counter(shingle_set(t.as_py(), codes, n)) for t in batch.column("text"))])
            total += np.bincount(at, minlength=SKETCH)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["counter", "n"])

    out = np.zeros(SKETCH, dtype=np.int64)
    counted = rows.select("text").mapInArrow(freeing(run), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    with small_batches(rows.sparkSession):
        for r in counted.collect():
            out[r["counter"]] = r["n"]
    return out


def keys_of(members: np.ndarray, sketch: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys of a set, its rarest members; similar sets share one."""
    n = len(members)
    first = n + percent * -n // 100 + 1 if n else 0
    return members[np.argsort(sketch[_counter(members)], kind="stable")[:first]].view(np.int64)


def counts_of(members: np.ndarray) -> bytes:
    """A set's point, in as few bytes a coordinate as hold its largest one."""
    counts = np.bincount((members & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def points_of(data: list[bytes]) -> np.ndarray:
    if all(len(d) == GROUPS for d in data):
        return np.frombuffer(b"".join(data), np.uint8).reshape(-1, GROUPS).astype(np.int64)
    return np.array([np.frombuffer(d, f"u{len(d) // GROUPS}") for d in data], dtype=np.int64).reshape(-1, GROUPS)


class CountTree:
    """An R-tree of count vectors, packed in the order of size and coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*(points[:, g] for g in range(min(3, points.shape[1]))), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # largest coordinates, least and largest size
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > 1:
            cuts = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def near(self, point: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """Numbers of the points whose overlap may be large enough."""
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for top, low, high in reversed(self.levels):
            enough = (100 + percent) * np.minimum(top[nodes], point).sum(axis=1) >= percent * (size + low[nodes])
            nodes = nodes[enough & (100 * low[nodes] * percent <= 100 * 100 * size) & (100 * high[nodes] >= percent * size)]
            below = len(self.points) if top is self.levels[0][0] else len(self.levels[[x[0] is top for x in self.levels].index(True) - 1][0])
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = nodes[nodes < below]
        enough = (100 + percent) * np.minimum(self.points[nodes], point).sum(axis=1) >= percent * (size + self.sizes[nodes])
        return self.order[nodes[enough]]


def described(rows: DataFrame, sketch: np.ndarray, n: int, percent: int) -> DataFrame:
    """(id, n, c1, c2, counts, keys) of rows (id, text): set size, two sums that tell sets apart, point and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches, "text"):
            sets = [shingle_set(t.as_py(), codes, n) for t in batch.column("text")]
            sums = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
            more = [int(mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums, pa.int64()), pa.array(more, pa.int64()), pa.array([counts_of(s) for s in sets], pa.binary()), pa.array([keys_of(s, sketch, percent) for s in sets], pa.list_(pa.int64()))],
                ["id", "n", "c1", "c2", "counts", "keys"],
            )

    return rows.mapInArrow(freeing(run), "id long, n long, c1 long, c2 long, counts binary, keys array<long>")


def verified(rows: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (id, partner) that are linked, by whole sets made from rows (id, text).

    A partner's set goes to each share of its documents, so that a partner of very many has many tasks.
    """
    shares = pairs.groupBy("partner").agg((F.floor(F.count("*") / SHARE) + 1).alias("shares"))
    own = pairs.join(shares, "partner").select("id", "partner", F.pmod(F.xxhash64("id"), F.col("shares")).alias("share"))
    heads = shares.select(F.col("partner").alias("id"), "partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    asked = own.withColumn("head", F.lit(0)).unionByName(heads.withColumn("head", F.lit(1))).groupBy("id").agg(F.collect_list(F.struct("partner", "share", "head")).alias("asked"))
    texts = rows.join(if_small(staged(asked)), "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for id_, text, asked_ in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "asked")), strict=True):
                data = shingle_set(text, codes, n).tobytes()
                out += [(a["partner"], a["share"], a["head"], id_, data) for a in asked_]
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["partner", "share", "head", "id", "members"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple[int, int] | None = None
        heads_: list[np.ndarray] = []
        for batch in batches:
            linked: list[tuple[int, int]] = []
            for partner, share, head, id_, data in zip(*(batch.column(c).to_pylist() for c in ("partner", "share", "head", "id", "members")), strict=True):
                members = np.frombuffer(data, np.uint64)
                if place != (partner, share):
                    place, heads_ = (partner, share), []
                if head:
                    heads_.append(members)
                    continue
                for other in heads_:
                    both = len(members) + len(other) - len(np.unique(np.concatenate([members, other])))
                    if 100 * both >= percent * (len(members) + len(other) - both):
                        linked.append((id_, partner))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in linked], pa.int64()), pa.array([x[1] for x in linked], pa.int64())], ["u", "v"])

    found = texts.mapInArrow(freeing(sets), "partner long, share long, head int, id long, members binary")
    found = found.repartition("partner", "share").sortWithinPartitions("partner", "share", F.desc("head"))
    return found.mapInArrow(freeing(check), "u long, v long")


def allowed(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The rows of `pairs` (id, partner, times) whose points (id, n, counts) allow a link."""
    own = points.select("id", "n", "counts").dropDuplicates(["id"])
    other = own.select(F.col("id").alias("partner"), F.col("n").alias("n2"), F.col("counts").alias("counts2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (points_of(batch.column(c).to_pylist()) for c in ("counts", "counts2"))
            sizes = batch.column("n").to_numpy() + batch.column("n2").to_numpy()
            fits = (100 + percent) * np.minimum(a, b).sum(axis=1) >= percent * sizes
            yield batch.select(["id", "partner", "times"]).filter(pa.array(fits))

    sized = pairs.join(own, "id").join(other, "partner").where(F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
    return sized.mapInArrow(freeing(run), "id long, partner long, times long")


def tree_pairs(members: DataFrame, points: DataFrame, percent: int, best: bool = False) -> DataFrame:
    """Distinct pairs (id, partner) of rows (key, id, component) whose points (id, n, counts) allow a link.

    Members of a key come in blocks of about BLOCK, and each two blocks meet once. A key of few members is a tree of one
    leaf; these are scanned together. With `best` only keys of more than FANOUT members count, and each document gets
    one partner, the one whose point is nearest.
    """
    blocks = members.groupBy("key").agg((F.floor(F.count("*") / BLOCK) + 1).alias("blocks"), F.count("*").alias("all"))
    if best:
        blocks = blocks.where(F.col("all") > FANOUT)
    blocks = blocks.select("key", "blocks")
    dealt = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
    place = ["key", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, place):
            cuts = group_starts(table, place)
            ids, comps, sizes, block, b1, b2 = (table[c].to_numpy() for c in ("id", "component", "n", "block", "b1", "b2"))
            counts = points_of(table["counts"].to_pylist())
            group, few = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), np.diff(cuts) <= FANOUT
            few &= (b1[cuts[:-1]] == b2[cuts[:-1]]) & (not best)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for step in range(1, FANOUT):
                i = np.flatnonzero((group[step:] == group[: len(group) - step]) & few[group[step:]])
                if not len(i):
                    break
                i = i[comps[i] != comps[i + step]]
                left.append(i)
                right.append(i + step)
            i, j = np.concatenate(left), np.concatenate(right)
            fits = 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])
            i, j = i[fits], j[fits]
            pairs = np.stack([np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])], axis=1)
            pairs, once = np.unique(pairs, axis=0, return_index=True)
            i, j = i[once], j[once]
            allowed_ = [np.empty(0, bool)]
            for at in range(0, len(i), 20_000):
                x, y = i[at : at + 20_000], j[at : at + 20_000]
                allowed_.append((100 + percent) * np.minimum(counts[x], counts[y]).sum(axis=1) >= percent * (sizes[x] + sizes[y]))
            out, shared = [pairs[np.concatenate(allowed_)]], [np.empty(0, np.int64)]
            for g in np.flatnonzero(~few).tolist():
                here = np.arange(cuts[g], cuts[g + 1])
                a, b = here[block[here] == b1[here]], here[block[here] == b2[here]]
                if not len(a) or not len(b):
                    continue
                tree = CountTree(counts[a], sizes[a])
                for k in b:
                    near = a[tree.near(counts[k], int(sizes[k]), percent)]
                    near = near[comps[near] != comps[k]]
                    if best and len(near):
                        overlap = 1_000_000 * np.minimum(counts[near], counts[k]).sum(axis=1) // (sizes[near] + sizes[k])
                        near = near[[int(overlap.argmax())]]
                        out.append(np.stack([ids[[k]], ids[near]], axis=1))
                        shared.append(overlap.max(keepdims=True))
                        continue
                    out.append(np.stack([np.maximum(ids[near], ids[k]), np.minimum(ids[near], ids[k])], axis=1))
            found = np.concatenate(out)
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.concatenate(shared))], ["id", "partner", "shared"])
                continue
            found = np.unique(found, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["id", "partner"])

    rows = dealt.select(*place, "block", "id", "component").join(points, "id")
    rows = rows.select(*place, "block", "id", "component", "n", "counts").repartition(*place).sortWithinPartitions(*place, "id")
    if best:
        found = rows.mapInArrow(freeing(run), "id long, partner long, shared long").where(F.col("id") != F.col("partner"))
        nearest = found.groupBy("id").agg(F.max_by("partner", F.struct("shared", "partner")).alias("partner"))
        return nearest.select(F.greatest("id", "partner").alias("id"), F.least("id", "partner").alias("partner")).distinct()
    return rows.mapInArrow(freeing(run), "id long, partner long").where(F.col("id") != F.col("partner")).distinct()


def open_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, component) of the keys whose documents are in more than one component."""
    labelled = members.select("key", "id").distinct().join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed_keys = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where(F.col("a") < F.col("b"))
    return staged(labelled.join(mixed_keys.select("key"), "key").select("key", "id", "component"))


def _repeats(docs: DataFrame, doc_id: str) -> bool:
    known = docs.where(F.col(doc_id).isNotNull())
    return known.groupBy(doc_id).count().where("count > 1").limit(1).count() > 0


def join_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, percent: int = PERCENT, unique: bool | None = None, rounds: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    unique: whether ids are known not to repeat. rounds: how often documents of large keys look for their nearest
    partner before all open pairs meet; the result is the same, and large groups near the threshold make fewer pairs.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    if unique or (unique is None and not _repeats(docs, doc_id)):
        about, links = linked_documents(rows, n, percent, rounds)
        component = staged(components(links))
        done = about.select("id", "n").join(component, "id", "left")
        return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    # each row is searched for on its own, and the rows of an id are linked
    numbered = staged(rows.select(F.col("id").alias("own"), "text").withColumn("id", F.monotonically_increasing_id()))
    ids = numbered.where(F.col("own").isNotNull()).select("id", "own")
    about, links = linked_documents(numbered.where(F.col("own").isNotNull()).select("id", "text"), n, percent, rounds)
    first = ids.groupBy("own").agg(F.min("id").alias("v"), F.count("*").alias("times")).where("times > 1")
    same = ids.join(first, "own").where(F.col("id") != F.col("v")).select(F.col("id").alias("u"), "v")
    component = staged(components(links.unionByName(same)))
    placed = ids.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("own").alias("component_id"))
    done = about.select("id", "n").join(placed, "id").join(least, "component").select(F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    nameless = described(rows.where(F.col("id").isNull()), np.zeros(SKETCH, dtype=np.int64), n, percent)
    return done.unionByName(nameless.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def linked_documents(rows: DataFrame, n: int, percent: int, rounds: int = 0) -> tuple[DataFrame, DataFrame]:
    """What is known of each of rows (id, text), and links (u, v) between ids that connect all that are near; ids that
    aren't null are unique."""
    about = staged(described(rows, frequency_sketch(rows, n), n, percent), small=True)
    known = about.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = known.groupBy("n", "c1", "c2").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    equal = known.select("id", "n", "c1", "c2").join(
        classes.where(F.col("copies") > 1).withColumnRenamed("id", "first"), ["n", "c1", "c2"]
    ).where(F.col("id") != F.col("first")).select(F.col("id").alias("u"), F.col("first").alias("v"))
    equal = staged(equal)
    # a class is searched for by its first document
    firsts = known.join(equal.select(F.col("u").alias("id")), "id", "left_anti")
    keyed = firsts.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where(F.col("least") < F.col("most"))
    members = staged(keyed.join(shared.select("key", "least"), "key"))

    often = members.where(F.col("id") != F.col("least")).groupBy("id", F.col("least").alias("partner")).agg(F.count("*").alias("times"))
    best = Window.partitionBy("id").orderBy(F.desc("times"), "partner")
    often = allowed(often, firsts, percent)
    pairs = staged(often.withColumn("turn", F.row_number().over(best)).where("turn = 1").select("id", "partner"))
    texts = rows.where(F.col("id").isNotNull())
    links = staged(verified(texts, pairs, n, percent), small=True)
    found = staged(components(links))

    known_points = firsts.select("id", "n", "counts").dropDuplicates(["id"])
    open_ = open_members(members, found)
    for _ in range(rounds):
        # in large keys first the nearest partner of each, so that a group of near copies becomes one component
        nearest = staged(tree_pairs(open_, known_points, percent, best=True).join(pairs, ["id", "partner"], "left_anti"))
        new = staged(verified(texts, nearest, n, percent), small=True)
        pairs = pairs.unionByName(nearest)
        if not new.limit(1).count():
            break
        links = staged(links.unionByName(new))
        open_ = open_members(members, staged(components(links)))
    more = staged(tree_pairs(open_, known_points, percent).join(pairs, ["id", "partner"], "left_anti"))
    if more.limit(1).count():
        links = links.unionByName(staged(verified(texts, more, n, percent), small=True))
    return about, links.unionByName(equal)
