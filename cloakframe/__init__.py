"""cloakframe: find, tokenize, restore and audit sensitive text in Spark tables, payloads and streams."""

from cloakframe.operators.detect import Detector, DetectorRegistry, detect
from cloakframe.operators.restore import restore_column, unresolved_tokens
from cloakframe.options import Options
from cloakframe.plans.columns import mapping_rows, redact_column
from cloakframe.plans.payloads import payload_mapping_rows, redact_json, redact_payload, restore_json, restore_payload
from cloakframe.sources.profile_tables import ProfileTables
from cloakframe.sources.profiles import ProfileSet, load_profiles, write_profile_template

__all__ = [
    "Detector", "DetectorRegistry", "Options", "ProfileSet", "ProfileTables", "detect", "load_profiles", "mapping_rows",
    "payload_mapping_rows", "redact_column", "redact_json", "redact_payload", "restore_column", "restore_json",
    "restore_payload", "unresolved_tokens", "write_profile_template",
]
