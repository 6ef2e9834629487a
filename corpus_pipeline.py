"""A training corpus from raw documents: each stage takes all that the one before it kept.

1. language_id: documents without an identified language go (no letter, or a confidence under LEAST_SCORE).
2. line_dedup: boilerplate lines leave their documents; documents that lose all their words go.
3. ngram_join: of near-equal documents, five-word n-grams at a similarity of 0.8, the smallest id stays. Rows of one id
   with different texts are documents of their own, rows equal in id and text are one. Rows with null ids come after
   all others, so one of them stays only where no near-equal document has an id; without words, all stay.
4. source_mix: sources are mixed to target weights; documents repeat once per epoch, and the last one of a source is cut
   at its budget.
5. best_fit_packing: token pieces of the documents, packed into sequences.

Stages 1 to 4 return the columns of their input, whatever they are; the last returns pieces. Rows with null ids pass
the other stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import language_id, line_dedup, ngram_join, packing, source_mix
from cloakframe.llm.common import NULL_ID, WORD, if_small, staged, staging_folder, table

LEAST_SCORE = 0.5
NGRAM, PERCENT, ROUNDS = 5, 80, 2


def _with_text(doc, text, columns: list[str]) -> list:
    """The columns of a document with another text, and its length where the document has one."""
    own = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return [own[c].alias(c) if c in own else doc[c].alias(c) for c in columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit_documents(docs)
    kept = language_id.predict(docs.select(F.struct("*").alias("doc")), model, "doc.text")
    return kept.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("kept_text").rlike(WORD)
    kept = done.where(~F.coalesce(emptied, F.lit(False)))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("doc.text"))
    return kept.select(*_with_text(F.col("doc"), text, docs.columns))


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc) with rows of equal id and text as one, numbered in the order of id and text, rows without id last."""
    text, known = F.col("doc.text"), F.col("doc.doc_id").isNotNull()
    rows = docs.select(F.struct("*").alias("doc")).select(
        "doc", (~known).alias("k0"), F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(NULL_ID)).alias("k1"),
        F.coalesce(F.sha2(text, 256), F.lit("")).alias("k2"),
    )
    place = ["k0", "k1", "k2"]
    keys = rows.groupBy(*place).agg(F.count("*").alias("times")).orderBy(*place)
    keys = staged(keys.withColumn("row", F.monotonically_increasing_id()))
    own = rows.join(keys, place)
    others = F.to_json(F.struct(*(F.col("doc")[c].alias(c) for c in docs.columns if c != "text")))
    again = own.where("times > 1").groupBy("row").agg(F.min_by("doc", others).alias("doc"))
    return staged(own.where("times = 1").select("row", "doc").unionByName(again))


def _drop_near_rows(docs: DataFrame) -> DataFrame:
    """As drop_near_copies, for tables whose ids repeat or are null: each id and text is a row of its own."""
    nameless = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = _numbered(docs.where(~nameless))
    near = ngram_join.join_near(rows.select("row", "doc.text"), "row", n=NGRAM, percent=PERCENT, unique=True, rounds=ROUNDS)
    copies = staged(near.where("doc_id <> component_id").select(F.col("doc_id").alias("row")))
    return rows.join(if_small(copies), "row", "left_anti").select("doc.*").unionByName(docs.where(nameless))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return _drop_near_rows(docs)
    near = ngram_join.join_near(docs, n=NGRAM, percent=PERCENT, unique=True, rounds=ROUNDS)
    copies = staged(near.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct())
    return docs.join(if_small(copies), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = source_mix.mixed_rows(source_mix.mix_documents(docs)).select(F.struct("*").alias("doc"))
    return rows.select(*_with_text(F.col("doc"), F.col("doc.text"), docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack),
]

#: The language model and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    folder = f"{staging_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
