"""Queries over nested payloads (JSON documents built from the given tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators import nested
from cloakframe.operators.tokens import mapping_id
from cloakframe.plans.columns import mapping_rows
from cloakframe.plans.payloads import payload_mapping_rows, redact_json, redact_payload, restore_json, restore_payload
from cloakframe.queries.base import ALL, EPOCH, OPTIONS, documents, payloads, query
from cloakframe.queries.sqlparts import mapping_id as mid_sql
from cloakframe.queries.sqlparts import redaction_ctes
from cloakframe.sources.payloads import MAX_TURNS, PAYLOAD, parse_payloads, split_quarantine
from cloakframe.sources.tables import load_table, stage

CHUNK = ["conv_id", "chunk"]
_CHUNKS = f"""t AS (SELECT conv_id, CAST(turn // {MAX_TURNS} AS BIGINT) AS chunk, turn, role, text,
row_number() OVER (PARTITION BY conv_id, turn // {MAX_TURNS} ORDER BY turn) - 1 AS i FROM conversations)"""
_TURNS = """t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"""
_LEAVES = """SELECT conv_id, 'messages[' || i || '].role' AS path, role AS text FROM t{0}
UNION ALL SELECT conv_id, 'messages[' || i || '].content', text FROM t{0}"""


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads as JSON text; a long conversation has several."""
    return payloads(spark, folder).select(*CHUNK, "first", F.to_json(F.struct("messages")).alias("body"))


@query(
    "src_payload_json",
    f"WITH {_CHUNKS} SELECT conv_id, chunk, CAST(count(*) AS INT) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM t GROUP BY 1, 2",
)
def src_payload_json(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_payloads(bodies(spark, folder), "body", PAYLOAD)
    # as sum() does, messages without content are left out
    n_chars = "aggregate(payload.messages, cast(NULL AS bigint), (a, m) -> coalesce(a + length(m.content), a, cast(length(m.content) AS bigint)))"
    return parsed.select(*CHUNK, F.size("payload.messages").alias("n_messages"), F.expr(n_chars).alias("n_chars"))


@query("leaves_messages", f"WITH {_TURNS} {_LEAVES.format('')}")
def leaves_messages(spark: SparkSession, folder: str) -> DataFrame:
    return nested.typed_leaves(payloads(spark, folder), ["conv_id"], ["messages"], first="first")


@query("leaves_variant", f"WITH {_TURNS} {_LEAVES.format('')}")
def leaves_variant(spark: SparkSession, folder: str) -> DataFrame:
    leaves = nested.variant_leaves(bodies(spark, folder), ["conv_id", "first"], "body", max_depth=3)
    number = F.regexp_extract("path", r"^messages\[([0-9]+)", 1).cast("long") + F.col("first")
    rest = F.regexp_extract("path", r"^messages\[[0-9]+(.*)$", 1)
    return leaves.select("conv_id", F.concat(F.lit("messages["), number, rest).alias("path"), "text")


@query("exclude_system", "WITH " + _TURNS + " " + _LEAVES.format(" WHERE role <> 'system'"))
def exclude_system(spark: SparkSession, folder: str) -> DataFrame:
    return nested.typed_leaves(payloads(spark, folder), ["conv_id"], ["messages"], skip_system=True, first="first")


@query(
    "leaf_type_counts",
    """SELECT 'k' AS path, 'BIGINT' AS kind, count(*) AS n FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')
UNION ALL SELECT 'messages[].role', 'STRING', count(*) FROM conversations
UNION ALL SELECT 'messages[].content', 'STRING', count(*) FROM conversations""",
)
def leaf_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    props = load_table(spark, folder, "events").select(F.col("props").alias("body"))
    both = nested.variant_nodes(props, [], "body", 1).unionByName(
        nested.variant_nodes(bodies(spark, folder).select("body"), [], "body", 3)
    )
    shape = F.regexp_replace("path", r"\[[0-9]+\]", "[]")
    return both.groupBy(shape.alias("path"), "kind").agg(F.count("*").alias("n"))


@query(
    "rebuild_messages",
    "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1",
)
def rebuild_messages(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    parts = payloads(spark, folder).select(*CHUNK, F.array_join(lines, "\n").alias("part"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    return whole.select("conv_id", F.array_join("parts.part", "\n").alias("transcript"))


def document_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a payload: a system message that must stay, a user message, a nested attachment."""
    docs = documents(spark, folder)

    def message(role: str):
        return F.struct(F.lit(role).alias("role"), F.col("text").alias("content"))

    return docs.select(
        "doc_id",
        F.array(message("system"), message("user")).alias("messages"),
        F.struct(
            F.struct(F.struct(F.col("source").alias("name")).alias("origin"), F.col("n_chars").alias("size")).alias("info")
        ).alias("attachment"),
        F.struct(F.col("lang").alias("lang")).alias("metadata"),
    )


_RED = redaction_ctes("documents", ["doc_id"], "text", ALL)


@query(
    "anonymize_payload",
    f"""WITH {_RED} SELECT doc_id, text AS system_text, redacted AS user_text, source AS origin, lang, mid AS privacy_mapping_id FROM red""",
)
def anonymize_payload(spark: SparkSession, folder: str) -> DataFrame:
    done = redact_payload(document_payloads(spark, folder), ["doc_id"], options=OPTIONS)
    return done.select(
        "doc_id",
        F.col("messages")[0]["content"].alias("system_text"),
        F.col("messages")[1]["content"].alias("user_text"),
        F.col("attachment.info.origin.name").alias("origin"),
        "metadata.lang",
        "metadata.privacy_mapping_id",
    )


@query(
    "mapping_by_path",
    f"""WITH {_RED} SELECT mid AS mapping_id, 'messages[1].content' AS path, count(*) AS n_entities,
string_agg(placeholder, ',' ORDER BY placeholder) AS placeholders FROM maps GROUP BY 1""",
)
def mapping_by_path(spark: SparkSession, folder: str) -> DataFrame:
    done = redact_payload(document_payloads(spark, folder), ["doc_id"], options=OPTIONS)
    rows = payload_mapping_rows(done, created_at=EPOCH, options=OPTIONS)
    return rows.groupBy("mapping_id", "path").agg(
        F.count("*").alias("n_entities"),
        F.array_join(F.array_sort(F.collect_list("placeholder")), ",").alias("placeholders"),
    )


@query("restore_payload", "SELECT doc_id, text AS system_text, text AS user_text, source AS origin, lang FROM documents")
def restored_payload(spark: SparkSession, folder: str) -> DataFrame:
    done = stage(redact_payload(document_payloads(spark, folder), ["doc_id"], options=OPTIONS), "payloads")
    known = payload_mapping_rows(done, created_at=EPOCH, options=OPTIONS)
    back = restore_payload(done.drop("entities", "mapping_id"), known, ["doc_id"], options=OPTIONS)
    return back.select(
        "doc_id",
        F.col("messages")[0]["content"].alias("system_text"),
        F.col("messages")[1]["content"].alias("user_text"),
        F.col("attachment.info.origin.name").alias("origin"),
        "metadata.lang",
    )


@query(
    "stamp_metadata",
    f"SELECT DISTINCT conv_id, {mid_sql('conv_id')} AS privacy_mapping_id FROM conversations",
)
def stamp(spark: SparkSession, folder: str) -> DataFrame:
    named = payloads(spark, folder).withColumn("mapping_id", F.expr(mapping_id(OPTIONS, "conv_id")))
    return nested.stamp_metadata(named).select("conv_id", "metadata.privacy_mapping_id").distinct()


@query(
    "strip_metadata",
    f"""WITH {_CHUNKS} SELECT conv_id, chunk, '{{"turns":' || count(*) || '}}' AS kept, '{{}}' AS emptied FROM t GROUP BY 1, 2""",
)
def strip(spark: SparkSession, folder: str) -> DataFrame:
    named = payloads(spark, folder).withColumn("mapping_id", F.expr(mapping_id(OPTIONS, *CHUNK)))
    bare = nested.strip_metadata(nested.stamp_metadata(named)).withColumn("emptied", F.to_json("metadata"))
    full = bare.withColumn("metadata", F.struct(F.size("messages").alias("turns")))
    return nested.strip_metadata(nested.stamp_metadata(full)).select(*CHUNK, F.to_json("metadata").alias("kept"), "emptied")


NESTED = 11  # objects around the text in a document's JSON


def document_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as JSON text: a system message that must stay, a user message, and the text deep inside."""
    text = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")  # as a JSON string
    deep = F.concat(F.lit('{"a":' * NESTED), text, F.lit("}" * NESTED))
    body = F.concat(
        F.lit('{"messages": [{"role": "system", "content": '), text, F.lit('}, {"role": "user", "content": '), text,
        F.lit('}], "n": 1.50, "deep": '), deep, F.lit("}"),
    )
    return documents(spark, folder).select("doc_id", F.when(F.col("text").isNotNull(), body).alias("body"))


def shown_body(df: DataFrame, body: str) -> DataFrame:
    at = lambda path: F.get_json_object(body, f"$.{path}")
    return df.select(
        "doc_id", at("messages[0].content").alias("system_text"), at("messages[1].content").alias("user_text"),
        at("deep" + ".a" * NESTED).alias("deep_text"), at("metadata.privacy_mapping_id").alias("privacy_mapping_id"),
    )


@query(
    "anonymize_json",
    f"WITH {_RED} SELECT doc_id, text AS system_text, redacted AS user_text, redacted AS deep_text, mid AS privacy_mapping_id FROM red",
)
def anonymize_json(spark: SparkSession, folder: str) -> DataFrame:
    return shown_body(redact_json(document_bodies(spark, folder), ["doc_id"], "body", options=OPTIONS, stamp=True)[0], "redacted")


@query(
    "restore_json",
    "SELECT doc_id, text AS system_text, text AS user_text, text AS deep_text, CAST(NULL AS VARCHAR) AS privacy_mapping_id FROM documents",
)
def restored_json(spark: SparkSession, folder: str) -> DataFrame:
    given = stage(document_bodies(spark, folder), "json-given")
    done, found, _ = redact_json(given, ["doc_id"], "body", options=OPTIONS, stamp=True, once=True)
    known = mapping_rows(stage(found, "json-mappings"), F.col("path"), created_at=EPOCH, options=OPTIONS)
    back = restore_json(stage(done.select("doc_id", "redacted"), "json-bodies"), ["doc_id"], "redacted", known, OPTIONS)
    return shown_body(back, "restored")


_AFTER = """CASE event_type WHEN 'view' THEN '{"metadata": {"id": "x"}, "k": 1}' WHEN 'error' THEN '{}'
WHEN 'click' THEN '{"z": null, "a": [1]}' ELSE props END"""


@query(
    "key_diff",
    f"""SELECT event_id,
 array_to_string(list_sort(list_filter(json_keys(props), lambda x: NOT list_contains(json_keys(a), x))), ',') AS missing,
 array_to_string(list_sort(list_filter(json_keys(a), lambda x: NOT list_contains(json_keys(props), x))), ',') AS extra
FROM (SELECT event_id, props, {_AFTER} AS a FROM events)""",
)
def key_diff(spark: SparkSession, folder: str) -> DataFrame:
    events = load_table(spark, folder, "events").select("event_id", "props", F.expr(_AFTER).alias("after"))
    found = nested.key_differences(events, ["event_id"], "props", "after")
    return found.select("event_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


_BODY = """CASE event_type WHEN 'error' THEN left(props, length(props) - 1) WHEN 'signup' THEN '[' || props || ']'
WHEN 'view' THEN NULL ELSE props END"""


@query(
    "quarantine_rows",
    f"""SELECT event_id, CASE WHEN b IS NULL THEN 'missing' WHEN NOT json_valid(b) THEN 'invalid_json' ELSE 'not_an_object' END AS reason
FROM (SELECT event_id, {_BODY} AS b FROM events) WHERE b IS NULL OR NOT json_valid(b) OR json_type(b) <> 'OBJECT'""",
)
def quarantine_rows(spark: SparkSession, folder: str) -> DataFrame:
    events = load_table(spark, folder, "events").select("event_id", F.expr(_BODY).alias("body"))
    return split_quarantine(events, "body")[1].select("event_id", "reason")
