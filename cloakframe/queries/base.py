"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators.detect import BUILT_IN
from cloakframe.options import Options
from cloakframe.plans.columns import mapping_rows, redact_column
from cloakframe.queries.sqlparts import SALT
from cloakframe.sources.payloads import payloads_from_turns
from cloakframe.sources.profiles import STARTER_PROFILES, ProfileSet
from cloakframe.sources.tables import load_table, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

OPTIONS = Options(salt=SALT)
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"

# Words that occur in the test texts, as custom dictionaries.
PROFILES = ProfileSet(
    {
        **STARTER_PROFILES,
        "words": {
            "thresholds": {"DEFAULT": 0.2},
            "custom_entities": {
                "PERSON": ["orantion", "thanedble", "Erinst"],
                "ORGANIZATION": ["pathetic", "worthless", "the and"],
                "LOCATION": ["disgusting"],
            },
            "skip_terms": ["TestCompany", "user", "assistant", "system"],
        },
        "typos": {
            "custom_entities": {
                "PERSON": ["pathetik", "worthles", "disgustin"],
                "ORGANIZATION": ["orantionn", "thanedbles"],
            },
            "fuzzy_match": {"enabled": True, "thresholds": {"PERSON": 85, "DEFAULT": 90}},
        },
        "strict": {"thresholds": {"EMAIL_ADDRESS": 1.0, "IP_ADDRESS": 0.99, "DEFAULT": 0.99}},
        "loose": {"thresholds": {"CREDIT_CARD": 0.3, "DOMAIN_NAME": 0.5, "DEFAULT": 0.3}},
    }
)

# A profile per document source; sources that are not listed take the default.
PROFILE_BY_SOURCE = {"src0": "high_security", "src1": "strict", "src2": "loose", "src3": "unlisted"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "documents", "doc_id")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "conversations")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    return payloads_from_turns(turns(spark, folder), "conv_id", "turn", "role", "text")


def redacted_documents(spark: SparkSession, folder: str, options: Options = OPTIONS, **how) -> DataFrame:
    return redact_column(documents(spark, folder), "text", ["doc_id"], PROFILES, how.pop("profile", "bare"), options=options, **how)


def staged_documents(spark: SparkSession, folder: str, options: Options = OPTIONS) -> DataFrame:
    """Redacted documents as restoration finds them: written by an earlier job."""
    done = redacted_documents(spark, folder, options)
    return stage(done.select("doc_id", "mapping_id", "redacted", "entities"), "redacted")


def document_mappings(redacted: DataFrame, options: Options = OPTIONS) -> DataFrame:
    return mapping_rows(redacted, "text", created_at=EPOCH, options=options)


def profile_of_source():
    pairs = " ".join(f"WHEN '{s}' THEN '{p}'" for s, p in PROFILE_BY_SOURCE.items())
    return F.expr(f"CASE source {pairs} END")


ALL = list(BUILT_IN)
