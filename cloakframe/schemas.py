"""Schemas of the engine's tables, as DDL."""

SPAN = (
    "STRUCT<entity_type: STRING, start: INT, end: INT, value: STRING, score: DOUBLE, "
    "source: STRING, priority: INT, type_ord: INT, value_ord: INT>"
)
SPANS = f"ARRAY<{SPAN}>"

# What a detector, dictionary or join proposes for a leaf before it is located in the text.
CANDIDATE = (
    "STRUCT<priority: INT, type_ord: INT, value_ord: INT, neg_score: DOUBLE, "
    "entity_type: STRING, value: STRING, source: STRING>"
)
CANDIDATES = f"ARRAY<{CANDIDATE}>"

# A dictionary value that is matched fuzzily, with the lengths its partners can have.
FUZZY_VALUES = (
    "ARRAY<STRUCT<entity_type: STRING, type_ord: INT, value: STRING, value_ord: INT, lowered: STRING, "
    "threshold: DOUBLE, lo: INT, hi: INT>>"
)

ENTITY = "STRUCT<placeholder: STRING, entity_type: STRING, original: STRING, score: DOUBLE, source: STRING>"
ENTITIES = f"ARRAY<{ENTITY}>"

MAPPINGS = (
    "mapping_id STRING, path STRING, placeholder STRING, entity_type STRING, original STRING, "
    "score DOUBLE, source STRING, profile STRING, created_at TIMESTAMP, last_access TIMESTAMP"
)

PROFILE_THRESHOLD = "profile STRING, entity_type STRING, threshold DOUBLE"
PROFILE_ENTITY = "profile STRING, entity_type STRING, type_ord INT, value STRING, value_ord INT"
PROFILE_FUZZY = "profile STRING, enabled BOOLEAN, entity_type STRING, threshold INT"
PROFILE_SKIP = "profile STRING, term STRING"
