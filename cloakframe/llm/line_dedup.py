"""Line dedup by distinct-site spread.

A line's key is the line without blanks around it. Its spread is the number of distinct sites (sources) that have it:
HyperLogLog sketches of sites per line hash, merged by aggregation, decide lines far from the threshold, and lines
near it get an exact distinct count. Lines that spread over the threshold are boilerplate and leave every document but
the one with the smallest id that has them, so that a text copied across sites is not lost as a whole.

Defined results: null text has no lines, an empty text one empty line; lines of blanks only are never removed; a null
site counts as a site of its own; a null id orders before all others; rows with equal id and text are treated alike;
an empty table gives no rows. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import row_key

#: Sites that a line must have to count as boilerplate.
MIN_SITES = 10
#: Bits of a sketch's register index; relative error 1.04 / sqrt(2 ** bits).
SKETCH_BITS = 12


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    """64-bit hash of a line's key; null for a line of blanks."""
    key = F.btrim(line, F.lit(" \t\r"))
    return F.when(key != "", F.xxhash64(key))


def line_sites(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """(k1, k2, site, line): the distinct lines of each document."""
    hashes = F.array_distinct(F.filter(F.transform(lines_of(F.col(text)), line_hash), lambda h: h.isNotNull()))
    site_key = F.coalesce(F.concat(F.lit("s"), F.col(site)), F.lit("-"))
    return docs.select(*row_key(F.col(doc_id), F.col(text)), site_key.alias("site"), F.explode(hashes).alias("line"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, first): lines of at least min_sites sites and the smallest id that has them.

    A line in fewer documents than min_sites can't have as many sites, so only the others get sketches.
    """
    often = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("k1").alias("first")).where(F.col("n") >= min_sites)
    of_often = lines.join(often, "line")
    sketched = of_often.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"), F.first("first").alias("first")
    )
    margin = 1 + 4 * 1.04 / 2 ** (SKETCH_BITS / 2) * min_sites
    far = sketched.where(F.col("sites") >= min_sites + margin).select("line", "first")
    near = sketched.where(F.abs(F.col("sites") - min_sites) < margin).select("line", "first")
    exact = lines.join(near, "line").groupBy("line").agg(F.countDistinct("site").alias("sites"), F.first("first").alias("first"))
    return far.unionByName(exact.where(F.col("sites") >= min_sites).select("line", "first"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Each row as struct `doc`, with n_lines, n_removed and kept_text (null for null)."""
    lines = line_sites(docs, doc_id, text, site)
    gone = lines.join(spread_lines(lines, min_sites), "line").where(F.col("k1") > F.col("first"))
    gone = gone.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"))
    rows = docs.select(F.struct("*").alias("doc"), *row_key(F.col(doc_id), F.col(text))).join(gone, ["k1", "k2"], "left")
    every = lines_of(F.col("doc")[text])
    kept = F.when(
        F.col("gone").isNotNull(), F.filter(every, lambda x: ~F.coalesce(F.array_contains("gone", line_hash(x)), F.lit(False)))
    ).otherwise(every)
    n_lines = F.coalesce(F.size(every), F.lit(0))
    counted = rows.withColumn("kept", kept).withColumn("n_lines", F.greatest(n_lines, F.lit(0)).cast("long"))
    return counted.select(
        "doc",
        "n_lines",
        (F.col("n_lines") - F.greatest(F.coalesce(F.size("kept"), F.lit(0)), F.lit(0))).alias("n_removed"),
        F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).alias("kept_text"),
    )


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents
), k AS (
  SELECT trim(line, ' ' || chr(9) || chr(13)) AS key, min(doc_id) AS first_id FROM l
  GROUP BY 1 HAVING count(DISTINCT coalesce('s' || source, '-')) >= {MIN_SITES}
), d AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), p AS (
  SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), m AS (
  SELECT p.*, k.key IS NOT NULL AND k.key <> '' AND p.doc_id > k.first_id AS gone
  FROM p LEFT JOIN k ON k.key = trim(p.line, ' ' || chr(9) || chr(13))
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
