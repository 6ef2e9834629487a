"""Mixing sources to target weights.

Each row gets a hash-random key. Rows are range-sorted by key within their source, a prefix sum of their sizes runs
over ranges and then inside each range, and every source is cut at its exact budget, after as many whole epochs as
the budget holds.

Defined results: a null text has size 0; null is a source of its own, ordered last; a source of size 0 has target 0;
rows that are equal in every used column may swap places, which changes no total; an empty table gives an empty mix.
Columns of the input that share a name with a result are not part of `source_targets`, and `mix_documents` keeps the
input apart in the struct `doc`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import NULL_ID, n_words

#: Rows that one range of a source holds at most, about.
RANGE_ROWS = 2_000


def source_targets(totals: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most_epochs: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, weigh `weights`, repeating. A target stops at `most_epochs` times its
    source's size; what is over goes to the others by weight. One row per source passes through one task.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    capped = totals.select("source", "source_size", weigh.alias("weight"), (F.col("source_size") * most_epochs).cast("double").alias("most"))
    capped = capped.withColumn("full_at", F.col("most") / F.col("weight"))
    before = Window.partitionBy().orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # the level if all sources that fill up earlier are full; it is highest where the last of them fills up
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = capped.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.when(F.col("full_at") <= F.col("level"), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return levelled.select("source", "source_size", target.alias("target"))


def mix_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    share: float = 1.0,
    most_epochs: int = 3,
    seed: int = 17,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Each row as struct `doc` (its columns `keep`, or all), with size, source_size, target and taken.

    taken counts the words that the mix takes of a row: size for every whole epoch, and in the last epoch size, a part
    of it at the cut, or nothing.
    """
    n_ranges = max(1, -(-docs.count() // RANGE_ROWS))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"),
        F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("-")).alias("site"),  # never null
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"),
        n_words(F.col(text)).alias("size"),
    ).withColumn("key", F.xxhash64(F.lit(seed), "id", "size"))
    # the key's place among all 64-bit numbers, as a range number
    at = (F.shiftrightunsigned("key", 33) * n_ranges).cast("double") / F.lit(float(2**31))
    sized = sized.withColumn("range", F.floor(at))
    ranges = sized.groupBy("site", "range").agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    totals = ranges.groupBy("site").agg(F.sum("range_size").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, most_epochs)
    targets = targets.withColumn("site", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))).drop("source")
    earlier = Window.partitionBy("site").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("site", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"))
    starts = starts.join(targets, "site")
    within = Window.partitionBy("site", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["site", "range"])
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * most_epochs)
    cut = placed.withColumn("before", F.col("before") + F.col("range_start")).withColumn("budget", budget)
    cut = cut.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return cut.select("doc", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of a mix: each document once per epoch, its text cut after the last word taken at the budget's end.

    A document without words is taken once.
    """
    doc, size, taken = F.col("doc"), F.col("size"), F.col("taken")
    times = F.when(size == 0, 1).otherwise(F.ceil(taken / size)).cast("int")
    rows = mixed.where(times > 0).select("doc", "size", "taken", F.explode(F.sequence(F.lit(1), times)).alias("epoch"))
    left = F.least(size, taken - (F.col("epoch") - 1) * size)
    # words and the blanks between them alternate, so the cut keeps the text's own blanks
    parts = F.regexp_extract_all(doc[text], F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    cut = F.when(left < size, F.concat_ws("", F.slice(parts, 1, left.cast("int")))).otherwise(doc[text])
    return rows.select(doc.withField(text, cut).alias("doc")).select("doc.*")
