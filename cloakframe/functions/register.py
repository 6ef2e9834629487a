"""The engine's scalar expressions as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cloakframe.functions.checks import luhn_valid
from cloakframe.functions.similarity import indel_ratio
from cloakframe.functions.text import is_uuid_shaped
from cloakframe.operators.detect import BUILT_IN, detect
from cloakframe.operators.tokens import mint_token
from cloakframe.options import Options
from cloakframe.plans.columns import redaction
from cloakframe.schemas import ENTITIES, SPANS
from cloakframe.sources.profiles import ProfileSet


def register_functions(
    spark: SparkSession, options: Options = Options(), profiles: ProfileSet | None = None, profile: str | None = None
) -> list[str]:
    """Create the functions in the session and return their names."""
    resolved = (profiles or ProfileSet(default=options.default_profile)).resolve(profile)
    bodies = {
        "is_uuid_shaped(t STRING) RETURNS BOOLEAN": is_uuid_shaped("t", options.uuid_length, options.uuid_dashes),
        "luhn_valid(t STRING) RETURNS BOOLEAN": luhn_valid("t"),
        "indel_ratio(a STRING, b STRING) RETURNS DOUBLE": indel_ratio("a", "b"),
        "mint_token(scope STRING, entity_type STRING, value STRING) RETURNS STRING": mint_token(
            options, "scope", "entity_type", "value"
        ),
        f"detect_spans(t STRING) RETURNS {SPANS}": detect("t", BUILT_IN, resolved.thresholds),
        f"anonymize_text(t STRING, scope STRING) RETURNS STRUCT<text: STRING, entities: {ENTITIES}>": redaction(
            "t", resolved, "scope", options
        ),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in bodies]
