"""Document fingerprints by I-Match with randomised lexicons.

Terms (lower-cased runs of letters and digits) whose document frequency lies in a band form the lexicon. A text's
distinct lexicon terms, thinned at random to about one per subset, are dealt to PARTS disjoint random subsets of the
lexicon; the sorted terms of each subset are hashed. Texts that share most terms share most subset hashes.

How far terms are thinned is the fingerprint's level: 2 ** level of them leave one. A fingerprint holds the hashes of
its own level and of the next, so texts of up to twice the terms can still be compared.

The lexicon travels as a bit set of LEXICON_BITS bits keyed by term hash, a fixed size at any scale. Its band has at
most (mean distinct terms of a text) / LEAST_SHARE terms; a term that shares a bit with one of them counts as a
member in every text alike, so fingerprints stay comparable.

Defined results: null is an empty text; a text without terms in the band is printed by all its terms; one without
terms has a fingerprint of empty parts, like only its equal; a null id orders first; rows with equal ids follow in
text order; the only document is its own next; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import NULL_ID

PARTS = 32
LEXICON_BITS = 1 << 20
#: Document frequency of lexicon terms, as shares of all documents, and at least LEAST_DOCS.
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 0.0005, 0.1, 2
#: Documents that one range of ids holds, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 2_000, 65_536
_TERMS_PER_PART = 0.7
_HEX = 6
_EMPTY = "-" * _HEX


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(found, lambda t: F.xxhash64(t)))


def _literal(numbers: list[int]) -> Column:
    """An array literal; the cast of a constant is folded when the query is planned."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _bit(h: Column) -> Column:
    return F.shiftrightunsigned(h, 40).bitwiseAND(LEXICON_BITS - 1)


def lexicon_bits(docs: DataFrame, text: str = "text") -> list[int]:
    """The lexicon of a corpus as LEXICON_BITS / 64 longs, of all its documents."""
    n = docs.count()
    least, most = max(LEAST_DOCS, LEAST_SHARE * n), max(LEAST_DOCS, MOST_SHARE * n)
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").count()
    bits = counts.where(F.col("count").between(least, most)).select(_bit(F.col("term")).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    out = [0] * (LEXICON_BITS // 64)
    for row in words.collect():  # at most LEXICON_BITS / 64 rows
        out[row["at"]] = row["word"]
    return out


def with_prints(df: DataFrame, text: str, out: str, lexicon: list[int]) -> DataFrame:
    """Adds struct(level, own, next): PARTS subset hashes at the level and at the next; null for a subset without terms.

    One step a projection, so that no step is computed twice for a row.
    """
    table = _literal(lexicon)
    step = lambda name: f"{out}_{name}"

    def member(h: Column) -> Column:
        word = F.element_at(table, (F.shiftright(_bit(h), 6) + 1).cast("int"))
        return F.bit_get(word, _bit(h).bitwiseAND(63).cast("int")) == 1

    def hashed(kept: str) -> Column:
        part = lambda c: F.filter(kept, lambda h: F.shiftright(h, 16).bitwiseAND(PARTS - 1) == c)
        hash_of = lambda p: F.when(F.size(p) > 0, F.xxhash64(p))
        full = F.transform(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), part), hash_of)
        return F.when(F.size(kept) > 0, full).otherwise(F.array_repeat(F.lit(None).cast("long"), PARTS))

    df = df.withColumn(step("terms"), terms(F.col(text)))
    df = df.withColumn(step("member"), F.filter(step("terms"), member))
    band = F.sort_array(F.when(F.size(step("member")) > 0, F.col(step("member"))).otherwise(F.col(step("terms"))))
    df = df.withColumn(step("band"), band)
    level = F.floor(F.log2(F.size(step("band")) / (PARTS * _TERMS_PER_PART)))
    df = df.withColumn(step("level"), F.greatest(F.lit(0), F.coalesce(level, F.lit(0))).cast("int"))
    for name, more in (("own", 0), ("next", 1)):
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(step("level")) + more) - 1
        df = df.withColumn(step("mask"), mask)
        df = df.withColumn(step("thin"), F.filter(step("band"), lambda h: h.bitwiseAND(F.col(step("mask"))) == 0))
        df = df.withColumn(step(name), hashed(step("thin")))
    df = df.withColumn(out, F.struct(*[F.col(step(x)).alias(x) for x in ("level", "own", "next")]))
    return df.drop(*[step(x) for x in ("terms", "member", "band", "level", "mask", "thin", "own", "next")])


def as_string(fp: Column) -> Column:
    """Level and the hex digits of each subset hash."""

    def digits(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p: F.coalesce(F.right(F.hex(p), F.lit(_HEX)), F.lit(_EMPTY))), "")

    return F.concat_ws(".", fp["level"].cast("string"), digits(fp["own"]), digits(fp["next"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets, filled in either, with equal hashes, at a level that both have; 0 where there is none."""

    def share(x: Column, y: Column) -> Column:
        both = F.zip_with(x, y, lambda p, q: F.when(p.isNull() & q.isNull(), None).otherwise(F.coalesce(p == q, F.lit(False)).cast("int")))
        seen = F.filter(both, lambda v: v.isNotNull())
        return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda s, v: s + v) / F.size(seen))

    same = F.coalesce(share(a["own"], b["own"]), F.lit(1.0))
    step = b["level"] - a["level"]
    return (
        F.when(step == 0, same)
        .when(step == 1, F.coalesce(share(a["next"], b["own"]), F.lit(0.0)))
        .when(step == -1, F.coalesce(share(a["own"], b["next"]), F.lit(0.0)))
        .otherwise(0.0)
    )


def range_starts(docs: DataFrame, doc_id: str) -> list[int]:
    """First ids of up to MOST_RANGES ranges of about equal counts, ascending."""
    n = min(MOST_RANGES, max(1, -(-docs.count() // RANGE_ROWS)))
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id")).repartitionByRange(n, "id")
    return sorted(r["id"] for r in ids.groupBy(F.spark_partition_id()).agg(F.min("id").alias("id")).collect())


def _range_of(id_: Column, starts: list[int]) -> Column:
    """Number of the last start that is not above the id, by binary search."""
    table = _literal(starts)
    steps = max(1, len(starts)).bit_length()
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])

    def step(at: Column, jump: Column) -> Column:
        fits = (at + jump <= len(starts)) & (F.element_at(table, F.greatest(F.lit(1), F.least(F.lit(len(starts)), at + jump))) <= id_)
        return F.when(fits, at + jump).otherwise(at)

    return F.aggregate(jumps, F.lit(0), step)


def fingerprint_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, edited, fp, edited_fp, near_edited, near_next): each document, its edited text and their prints.

    The edited text has the last quarter of its code points replaced by the first as many of the next document. Next
    documents come from a window over each range of ids; only the first document of each range crosses over.
    """
    lexicon = lexicon_bits(docs, text)
    starts = range_starts(docs, doc_id)
    n = max(1, len(starts))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = with_prints(rows.withColumn("range", _range_of(F.col("id"), starts)), "text", "fp", lexicon)
    # starts are ids of documents, one per range; of rows with equal id the first in text order counts
    first = rows.where(F.element_at(_literal(starts or [0]), F.greatest(F.lit(1), F.least(F.lit(n), F.col("range")))) == F.col("id"))
    first = first.groupBy("range").agg(F.min(F.struct("id", "text", "fp")).alias("border"))
    first = first.select(F.when(F.col("range") > 1, F.col("range") - 1).otherwise(n).alias("range"), "border")
    order = Window.partitionBy("range").orderBy("id", "text")
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"after_{c}") for c in ("text", "fp")]).join(first, "range", "left")
    length = F.char_length("text")
    cut = F.floor(length / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - cut), F.substring(F.coalesce("after_text", "border.text"), F.lit(1), cut))
    rows = rows.select("doc_id", "text", "fp", F.coalesce("after_fp", "border.fp").alias("next_fp"), edited.alias("edited"))
    rows = with_prints(rows, "edited", "edited_fp", lexicon)
    return rows.select(
        "doc_id",
        "text",
        "edited",
        "fp",
        "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
