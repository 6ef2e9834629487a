"""Nested payloads, unknown JSON, quarantine."""

import json
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import nested
from cloakframe.options import Options
from cloakframe.plans.payloads import payload_mapping_rows, redact_json, redact_payload, restore_json, restore_payload
from cloakframe.sources.payloads import parse_payloads, payloads_from_turns, read_payload_json, split_quarantine

STAMP = "TIMESTAMP '2024-01-01 00:00:00'"
SCHEMA = (
    "messages ARRAY<STRUCT<role: STRING, content: STRING>>, note STRING, n INT, "
    "a STRUCT<messages: ARRAY<STRUCT<role: STRING, content: STRING>>, `b.c`: STRING, b: STRUCT<c: STRING>>, "
    "deep ARRAY<ARRAY<STRING>>, tags MAP<STRING, STRING>, metadata STRUCT<client: STRING>"
)
SALTED = Options(salt="test")
BODY = {
    "messages": [
        {"role": "system", "content": "write to root@example.com"},
        {"role": "user", "content": "My name is John Smith, john@example.com"},
        {"role": "assistant", "content": None},
    ],
    "note": "call 555-123-4567",
    "n": 7,
    "a": {"messages": [{"role": "system", "content": "inner@example.com"}], "b.c": "one@example.com", "b": {"c": "two@example.com"}},
    "deep": [["x@example.com"], [], ["plain", None]],
    "tags": {"k": "tag@example.com"},
    "metadata": {"client": "chat"},
}


@pytest.fixture
def payload(spark):
    df = spark.createDataFrame([(1, json.dumps(BODY)), (2, json.dumps({"messages": [], "n": 1}))], "id long, body string")
    return parse_payloads(df, "body", f"STRUCT<{SCHEMA}>").select("id", "payload.*")


def test_redact_and_restore_payload(payload):
    done = redact_payload(payload, ["id"], options=SALTED).cache()
    row = done.where("id = 1").first()
    assert row["messages"][0]["content"] == "write to root@example.com"
    assert re.fullmatch(r"My name is <PERSON_\w{8}>, <EMAIL_ADDRESS_\w{8}>", row["messages"][1]["content"])
    assert row["messages"][2]["content"] is None and row["n"] == 7
    assert row["a"]["messages"][0]["content"].startswith("<EMAIL_ADDRESS_")
    assert row["a"]["b.c"] != row["a"]["b"]["c"] and row["a"]["b.c"].startswith("<EMAIL")
    assert row["deep"][0][0].startswith("<EMAIL") and row["deep"][2] == ["plain", None]
    assert row["tags"]["k"].startswith("<EMAIL")
    assert row["metadata"]["client"] == "chat" and row["metadata"]["privacy_mapping_id"] == row["mapping_id"]
    paths = {e["path"] for e in row["entities"]}
    assert paths == {"messages[1].content", "note", "a.messages[0].content", "a.b.c", "deep[0][0]", "tags.k"}

    known = payload_mapping_rows(done, created_at=STAMP)
    back = restore_payload(done.drop("entities", "mapping_id"), known, ["id"])
    assert back.schema["metadata"].dataType.names == ["client"]
    want = {r["id"]: r.asDict(True) for r in payload.collect()}
    got = {r["id"]: r.asDict(True) for r in back.collect()}
    assert got[1] == want[1]
    assert {k: v for k, v in got[2].items() if k != "metadata"} == {k: v for k, v in want[2].items() if k != "metadata"}


def test_no_shuffle_and_metadata_created(payload):
    done = redact_payload(payload.drop("metadata"), ["id"], options=SALTED)
    assert done.schema["metadata"].dataType.names == ["privacy_mapping_id"]
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    emptied = nested.strip_metadata(done.select("id", "metadata"))
    assert [r["metadata"] for r in emptied.collect()] == [{}, {}]


def test_typed_leaves(payload):
    got = {(r["path"], r["text"]) for r in nested.typed_leaves(payload, ["id"], payload.columns[1:], True).where("id = 1").collect()}
    assert ("messages[1].role", "user") in got and ("a.messages[0].role", "system") in got
    assert not any(p.startswith("messages[0]") for p, _ in got)
    assert ("deep[2][0]", "plain") in got and ("tags.k", "tag@example.com") in got


def test_variant_leaves_equal_a_walk(spark):
    def walk(v, path=""):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, f"{path}.{k}" if path else k)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{path}[{i}]")
        elif isinstance(v, str):
            yield path, v

    df = spark.createDataFrame([(1, json.dumps(BODY)), (2, "{}"), (3, "not json"), (4, '"text"')], "id long, body string")
    got = nested.variant_leaves(df, ["id"], "body").collect()
    assert sorted((r["path"], r["text"]) for r in got if r["id"] == 1) == sorted(walk(BODY))
    assert [(r["path"], r["text"]) for r in got if r["id"] == 4] == [("", "text")]
    assert not [r for r in got if r["id"] in (2, 3)]
    with pytest.raises(Exception, match="deeper"):
        nested.variant_nodes(df, ["id"], "body", 2).collect()


def test_redact_json_of_any_shape(spark):
    df = spark.createDataFrame([(1, json.dumps(BODY)), (2, '{"x": 1}')], "id long, body string")
    out, changed, refused = redact_json(df, ["id"], "body", options=SALTED)
    assert refused.count() == 0
    rows = {r["id"]: r["redacted"] for r in out.collect()}
    body = json.loads(rows[1])
    assert body["messages"][0]["content"] == "write to root@example.com"
    assert "example.com" not in json.dumps({**body, "messages": body["messages"][1:]})
    assert list(body) == list(BODY) and body["n"] == 7 and body["deep"][2] == ["plain", None]
    assert rows[2] == '{"x": 1}'
    assert {r["path"] for r in changed.collect()} >= {"note", "deep[0][0]", "tags.k"}


def test_json_keeps_what_is_not_a_leaf(spark):
    bodies = {
        1: '{"a.b":"mail x@y.co","a":{"b":"plain words"}}',
        2: '{ "n": 1.10, "s":"at x@y.co \\"q\\" é\\n", "l":["keep this", "or x@y.co"], "e": [], "o": {} }',
        3: '{"note":"a@b.co"',
        4: '{"d":' * 11 + '{"d":"deep a@b.co"}' + "}" * 11,
        5: '{"a[0]":"first x@y.co","a":["second words"]}',
    }
    df = spark.createDataFrame(list(bodies.items()), "id long, body string")
    out, entities, refused = redact_json(df, ["id"], "body", options=SALTED)
    out, entities = out.cache(), entities.cache()
    got = {r["id"]: r["redacted"] for r in out.collect()}
    token = r"<EMAIL_ADDRESS_[0-9a-f]{8}>"
    assert re.fullmatch(r'\{"a\.b":"mail ' + token + r'","a":\{"b":"plain words"\}\}', got[1])
    assert re.fullmatch(
        r'\{ "n": 1\.10, "s":"at ' + token + r' \\"q\\" é\\n", "l":\["keep this", "or ' + token + r'"\], "e": \[\], "o": \{\} \}', got[2]
    )
    assert re.fullmatch(r'\{"a\[0\]":"first ' + token + r'","a":\["second words"\]\}', got[5])
    assert {r["id"]: r["reason"] for r in refused.collect()} == {3: "invalid_json"}
    assert "a@b.co" not in got[4] and got[4].startswith('{"d":' * 12)
    mappings = entities.select("id", "mapping_id", F.explode("entities").alias("e")).select(
        "mapping_id", "e.placeholder", "e.entity_type", "e.original", F.lit("2024-01-01").cast("timestamp").alias("created_at")
    )
    handles = entities.select("id", "mapping_id").distinct()
    back = restore_json(out.join(handles, "id").select("id", "mapping_id", "redacted"), ["id"], "redacted", mappings)
    assert {r["id"]: r["restored"] for r in back.collect()} == {i: bodies[i] for i in (1, 2, 4, 5)}


def test_json_of_depth_200_with_a_handle(spark):
    bodies = {
        1: '{"a":' * 200 + '["x", "mail x@y.co"]' + "}" * 200,
        2: '{"metadata": {"k": [1, {"b": 2}], "privacy_mapping_id": "old"}, "t": "plain words"}',
        3: "{}",
        4: '{"metadata":{"privacy_mapping_id":"old","z":null},"t":"mail x@y.co"}',
        5: '{"metadata": "a text", "t": "words"}',
        6: '{"t": {"metadata": {"z": 1}}, "metadata": { } }',
    }
    df = spark.createDataFrame(list(bodies.items()), "id long, body string")
    out, found, refused = redact_json(df, ["id"], "body", options=SALTED, stamp=True)
    out, found = out.cache(), found.cache()
    got = {r["id"]: r["redacted"] for r in out.collect()}
    assert refused.count() == 0 and "x@y.co" not in got[1] + got[4]
    handles = {i: json.loads(b).get("metadata") for i, b in got.items()}
    assert all(len(handles[i]["privacy_mapping_id"]) == 36 for i in (1, 2, 3, 4, 6))
    assert handles[2]["k"] == [1, {"b": 2}] and handles[4]["z"] is None and "old" not in got[2] + got[4]
    rows = found.select("mapping_id", F.explode("entities").alias("e")).select(
        "mapping_id", "e.placeholder", "e.entity_type", "e.original", F.lit("2024-01-01").cast("timestamp").alias("created_at")
    )
    back = {r["id"]: r["restored"] for r in restore_json(out.select("id", "redacted"), ["id"], "redacted", rows).collect()}
    assert json.loads(back[1]) == json.loads(bodies[1]) | {"metadata": {}}
    assert json.loads(back[2])["metadata"] == {"k": [1, {"b": 2}]} and json.loads(back[6])["metadata"] == {}
    assert json.loads(back[4]) == {"metadata": {"z": None}, "t": "mail x@y.co"}


def test_metadata_is_restored(spark):
    df = spark.sql("SELECT 1L AS id, 'plain words' AS t, named_struct('author', 'bob@example.com') AS metadata")
    done = redact_payload(df, ["id"], options=SALTED)
    assert "bob" not in done.first()["metadata"]["author"]
    known = payload_mapping_rows(done, created_at="TIMESTAMP '2024-01-01 00:00:00'", options=SALTED)
    back = restore_payload(done.drop("entities", "mapping_id"), known, ["id"], options=SALTED).first()
    assert back["metadata"].asDict() == {"author": "bob@example.com"}


def test_a_long_conversation_keeps_one_token_a_person(spark):
    turns = spark.createDataFrame([(1, t, "user", f"turn {t} of x@y.co") for t in range(200)], "conv long, turn long, role string, text string")
    rows = payloads_from_turns(turns, "conv", "turn", "role", "text")
    assert rows.count() > 1
    done = redact_payload(rows, ["conv", "chunk"], ["messages"], options=SALTED, scope_keys=["conv"], first="first")
    found = payload_mapping_rows(done, options=SALTED).collect()
    assert len({r["placeholder"] for r in found}) == 1 == len({r["mapping_id"] for r in found})
    assert {r["path"] for r in found} == {f"messages[{t}].content" for t in range(200)}
    shown = [m["content"] for r in done.orderBy("chunk").collect() for m in r["messages"]]
    assert not any("x@y.co" in c for c in shown) and shown[150].startswith("turn 150 of <EMAIL")


def test_payloads_with_a_profile_per_row_and_candidates(spark):
    from cloakframe.sources.profiles import ProfileSet

    profiles = ProfileSet({"default": {}, "names": {"custom_entities": {"PERSON": ["Zorro"]}}})
    df = spark.sql("SELECT * FROM VALUES (1, 'names', 'ask Zorro or Bernardo', 'Bernardo'), (2, 'default', 'ask Zorro or Bernardo', 'nobody') AS v(id, p, t, w)")
    df = df.selectExpr(
        "id", "p", "named_struct('text', t) AS doc",
        "array(named_struct('priority', 3, 'type_ord', 0, 'value_ord', 0, 'neg_score', -0.9D, 'entity_type', 'PERSON', 'value', w, 'source', 'gazetteer')) AS c",
    )
    done = redact_payload(df, ["id"], ["doc"], profiles, profile_column="p", extra="c", options=SALTED).orderBy("id").collect()
    assert [len(r["entities"]) for r in done] == [2, 0] and done[1]["doc"]["text"] == "ask Zorro or Bernardo"


def test_payload_leaves_with_many_values_are_swept(spark):
    text = " ".join(f"u{i}@example.com" for i in range(300))
    df = spark.createDataFrame([(1, [text, "few@example.com", text[:100]])], "id long, parts array<string>")
    done = redact_payload(df, ["id"], options=SALTED)
    row = done.first()
    assert "@example.com" not in "".join(row["parts"]) and len(row["entities"]) == 300 + 1 + text[:100].count("@example.com")
    known = payload_mapping_rows(done, created_at="TIMESTAMP '2024-01-01 00:00:00'", options=SALTED)
    assert restore_payload(done.drop("entities", "mapping_id"), known, ["id"], options=SALTED).first()["parts"][0] == text


def test_maps_of_maps(spark):
    df = spark.createDataFrame([(1, {"o": {"i": "write to x@y.co now", "k": "plain words"}})], "id long, m map<string, map<string, string>>")
    row = redact_payload(df, ["id"], options=SALTED).first()
    assert row["m"]["o"]["k"] == "plain words" and "x@y.co" not in row["m"]["o"]["i"]
    assert [e["path"] for e in row["entities"]] == ["m.o.i"]


def test_key_differences_and_missing_columns(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":2}', '{"b":3,"c":4}')], "id long, before string, after string")
    row = nested.key_differences(df, ["id"], "before", "after").first()
    assert (row["missing"], row["extra"]) == (["a"], ["c"])
    lost = spark.createDataFrame([(1, "x", "m")], "id long, a string, metadata string").select("id", "a", "metadata")
    assert nested.restore_missing_keys(lost, ["a", "metadata"], "out_").columns == ["id", "a", "metadata", "out_a"]


def test_quarantine(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":'), (3, "[1]"), (4, None), (5, '"s"')], "id long, body string")
    good, bad = split_quarantine(df, "body")
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {2: "invalid_json", 3: "not_an_object", 4: "missing", 5: "not_an_object"}
    with pytest.raises(Exception, match="not a JSON object"):
        split_quarantine(df, "body", "raise")[0].collect()


def test_payloads_from_turns_are_bounded(spark):
    turns = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(10)], "conv long, turn long, role string, text string")
    rows = payloads_from_turns(turns, "conv", "turn", "role", "text", max_turns=4).orderBy("chunk").collect()
    assert [[m["content"] for m in r["messages"]] for r in rows] == [["t0", "t1", "t2", "t3"], ["t4", "t5", "t6", "t7"], ["t8", "t9"]]


def test_read_payload_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(BODY) + "\n")
    row = read_payload_json(spark, str(tmp_path), SCHEMA).first()
    assert row["messages"][1]["role"] == "user"
