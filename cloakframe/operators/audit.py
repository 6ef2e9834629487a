"""Audit aggregates over spans and mappings (A1-A7). Counts and types only, never values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cloakframe.functions.sqltext import let, quote
from cloakframe.sources.profiles import ProfileSet, type_cut


def mappings_per_document(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("mapping_id").agg(F.countDistinct("path").alias("n_paths"), F.count("*").alias("n_mappings"))


def entities_per_leaf(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("mapping_id", "path").agg(F.count("*").alias("n_entities"))


def detections_by_type(spans: DataFrame) -> DataFrame:
    return spans.groupBy("entity_type").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.countDistinct("value").alias("n_values")
    )


def detections_rollup(spans: DataFrame, *levels: str) -> DataFrame:
    return spans.rollup(*levels).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def store_growth(access: DataFrame, time: str, mapping_id: str, width: str) -> DataFrame:
    """Distinct mapping ids per time window (A5)."""
    return access.groupBy(F.window(time, width).alias("_w")).agg(F.countDistinct(mapping_id).alias("n_ids")).select(
        F.col("_w.start").alias("window_start"), "n_ids"
    )


def compare_profiles(spans: DataFrame, profiles: ProfileSet, names: list[str]) -> DataFrame:
    """Spans each profile would redact, per type, one column per profile (A7). One pass: a span adds
    to a profile's count when it reaches that profile's threshold."""
    reached = [
        F.count_if(F.expr(f"score >= {type_cut(profiles.cuts_sql(quote(n)), 'entity_type')}")).alias(n) for n in names
    ]
    return spans.groupBy("entity_type").agg(*reached)


def apply_thresholds(spans: DataFrame, profiles: ProfileSet, keep_all: bool = False) -> DataFrame:
    """Spans that reach the threshold of their type in their row's `profile`, else the profile's DEFAULT
    (P7, R2, J2). The few profiles are looked up in a literal map, so spans are never shuffled on
    the handful of types, where a third of them may be one type."""
    cut = F.expr(let(profiles.cuts_sql("profile"), lambda cuts: type_cut(cuts, "entity_type")))
    joined = spans.withColumn("threshold", cut)
    return joined if keep_all else joined.where(F.col("score") >= F.col("threshold"))


def observed(redacted: DataFrame, name: str = "redaction") -> tuple[DataFrame, Observation]:
    """Row and entity counts gathered while the job runs."""
    watch = Observation(name)
    return (
        redacted.observe(
            watch, F.count("*").alias("rows"), F.sum(F.size("entities")).alias("entities"),
            F.count_if(F.size("entities") > 0).alias("rows_with_entities"),
        ),
        watch,
    )
