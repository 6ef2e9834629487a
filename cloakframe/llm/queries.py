"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import (
    embedding_dedup,
    fill_middle,
    html_text,
    imatch,
    language_id,
    lexical_search,
    line_dedup,
    ngram_join,
    packing,
    quality,
    source_mix,
    substring_dedup,
    topk_search,
)
from cloakframe.llm.common import table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.scaled(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit_documents(docs))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_near(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = imatch.fingerprint_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        imatch.as_string(F.col("fp")).alias("fingerprint"),
        imatch.as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    done = line_dedup.dedup_lines(docs)
    return done.select("doc.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_text.extract_pages(table(spark, sf_dir, "pages"))
    return done.select("page_id", F.char_length("text").cast("long").alias("n_chars"), "text")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    back = fill_middle.restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return done.select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_source_mix": op5_source_mix,
    "op6_quality": op6_quality,
    "op7_imatch": op7_imatch,
    "op8_line_dedup": op8_line_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_html_text": op10_html_text,
    "op11_lexical_search": op11_lexical_search,
    "op12_fill_middle": op12_fill_middle,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLE: dict[str, str] = {
    "op1_topk_search": topk_search.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
    "op13_embedding_dedup": embedding_dedup.ORACLE,
}
