"""Profiles as tables: the same result as profiles in a dict, at any number of profiles and sizes of dictionaries."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.dictionary import group_hits_join, with_group_hits
from cloakframe.options import Options
from cloakframe.plans.columns import redact_column
from cloakframe.plans.payloads import redact_json, redact_payload
from cloakframe.schemas import PROFILE_ENTITY, PROFILE_FUZZY, PROFILE_SKIP, PROFILE_THRESHOLD
from cloakframe.sources.profile_tables import ProfileTables
from cloakframe.sources.profiles import ProfileSet

SALTED = Options(salt="test")
PROFILES = ProfileSet(
    {
        "default": {"custom_entities": {"PERSON": ["Ann Lee"]}},
        "strict": {"thresholds": {"IP_ADDRESS": 1.1, "DEFAULT": 0.2}, "skip_terms": ["Ann Lee and Bob"]},
        "names": {
            "custom_entities": {"PERSON": ["Bob", "Jonathan Smithers", "Ann Lee", "x"], "ORGANIZATION": ["Ann", "Acme Corporation"]},
            "fuzzy_match": {"enabled": True, "thresholds": {"PERSON": 80, "DEFAULT": 90}},
        },
        "loose": {"custom_entities": {"PERSON": ["Jonathan"]}, "fuzzy_match": {"enabled": True, "thresholds": {"DEFAULT": 50}}},
        "off": {"custom_entities": {"PERSON": ["Jonathan Smithers"]}, "fuzzy_match": {"enabled": False}},
        "empty": {},
    }
)
TEXTS = [
    "Ann Lee and Bob", "ann lee and bob", "Jonathon Smithers of Acme Corporatoin at 10.0.0.1", "write to bob@example.com, Bob!",
    "Jonathan Smithers, Jonathan Smitters", "", None, "Bob", "4111 1111 1111 1111 and shop.photography",
]


def rows(spark):
    names = [*PROFILES.names, "unknown", None]
    data = [(i * 100 + j, n, t) for i, n in enumerate(names) for j, t in enumerate(TEXTS)]
    return spark.createDataFrame(data + data[:3], "id long, profile string, text string").repartition(4)


def sorted_rows(df):
    return sorted(map(str, df.select("id", "profile", "text", "mapping_id", "redacted", "entities").collect()))


@pytest.mark.parametrize("fold_limit", [256, 1, 0])
def test_tables_equal_the_dict_form(spark, fold_limit):
    options = replace(SALTED, fold_limit=fold_limit)
    got = redact_column(rows(spark), "text", ["id"], ProfileTables.of(spark, PROFILES), profile_column="profile", options=options)
    want = redact_column(rows(spark), "text", ["id"], PROFILES, profile_column="profile", options=SALTED)
    assert got.columns == want.columns
    assert sorted_rows(got) == sorted_rows(want)


def test_candidates_from_elsewhere_stay(spark):
    found = (
        "array(named_struct('priority', 3, 'type_ord', 0, 'value_ord', 0, 'neg_score', -1.0D, 'entity_type', 'LOCATION', "
        "'value', 'write', 'source', 'gazetteer'))"
    )
    df = rows(spark).withColumn("found", F.expr(found))
    tables = ProfileTables.of(spark, PROFILES)
    for limit in (256, 0):
        done = redact_column(df, "text", ["id"], tables, profile_column="profile", options=replace(SALTED, fold_limit=limit), extra="found")
        assert done.where("redacted LIKE '<LOCATION_%'").count() == len(PROFILES.names) + 2
        assert "found" not in done.columns


def test_a_hundred_thousand_tenants(spark):
    n = 100_000
    tenant = spark.range(n).select(F.concat(F.lit("t"), "id").alias("profile"), "id")
    entities = tenant.selectExpr("profile", "'PERSON' AS entity_type", "0 AS type_ord", "concat('Name', id, 'x') AS value", "0 AS value_ord")
    thresholds = tenant.selectExpr("profile", "'IP_ADDRESS' AS entity_type", "if(id % 2 = 0, 0.5D, 1.5D) AS threshold")
    none = lambda ddl: spark.createDataFrame([], ddl)
    tables = ProfileTables(thresholds, entities, none(PROFILE_FUZZY), none(PROFILE_SKIP))
    # every third row has the first tenant
    df = tenant.selectExpr(
        "id", "if(id % 3 = 0, 't0', profile) AS profile",
        "concat('Name', if(id % 3 = 0, 0, id), 'x met Name', id + 1, 'x, 10.0.0.1') AS text",
    )
    done = redact_column(df, "text", ["id"], tables, profile_column="profile", options=SALTED)
    address = "CASE WHEN profile = 't0' OR id % 2 = 0 THEN '<IP_ADDRESS_[0-9a-f]{8}>' ELSE '10.0.0.1' END"
    want = f"concat('^<PERSON_[0-9a-f]{{8}}> met Name', id + 1, 'x, ', {address}, '$')"
    assert done.count() == n
    assert done.where(f"NOT redacted RLIKE {want}").count() == 0


def test_a_hot_group_and_a_large_one_are_cut(spark):
    values = [("a", "PERSON", 0, f"v{i}w", i) for i in range(300)] + [("b", "PERSON", 0, "v1w", 0), ("c", "PERSON", 0, "v2w", 0)]
    texts = [(i, "a" if i % 3 else "b", f"v{i}w and v{i + 1}w v1w") for i in range(400)] + [(1000, "d", "v1w"), (1001, "a", None)]
    dictionary = spark.createDataFrame(values, "g string, entity_type string, type_ord int, value string, value_ord int")
    leaves = spark.createDataFrame(texts, "id long, g string, text string")
    want = sorted((i, g, v[3]) for i, g, t in texts for v in values if t and v[0] == g and v[3] in t)
    for sizes in ({}, {"part_bytes": 200, "text_bytes": 500}):
        found = group_hits_join(leaves, ["id", "g"], "text", dictionary, "g", **sizes)
        assert sorted((r["id"], r["g"], r["value"]) for r in found.collect()) == want


def test_odd_rows_of_the_tables(spark):
    tables = ProfileTables(
        spark.createDataFrame([("p", "IP_ADDRESS", 2.0), ("p", "IP_ADDRESS", 0.1), ("p", None, 0.1), (None, "URL", 0.1), ("p", "URL", None)], PROFILE_THRESHOLD),
        spark.createDataFrame([("p", "PERSON", 0, "Bob", 0), ("p", "PERSON", 0, "Bob", 0), ("p", "PERSON", 0, "", 1), ("p", "PERSON", 0, None, 2), (None, "PERSON", 0, "Ann", 0)], PROFILE_ENTITY),
        spark.createDataFrame([("p", None, None, None), ("q", True, "DEFAULT", 80)], PROFILE_FUZZY),
        spark.createDataFrame([("p", None), (None, "x"), ("p", "skip me")], PROFILE_SKIP),
        default="p",
    )
    df = spark.createDataFrame([(1, "p", "Bob and Ann at 10.0.0.1"), (2, None, "Bob and Ann"), (3, "p", "Skip me"), (4, "q", "Bob and Ann")], "id long, profile string, text string")
    done = redact_column(df, "text", ["id"], tables, profile_column="profile", options=SALTED).orderBy("id").collect()
    assert [e["original"] for e in done[0]["entities"]] == ["10.0.0.1", "Bob"]
    assert done[1]["redacted"].startswith("<PERSON_") and done[1]["redacted"].endswith("> and Ann")
    assert [r["redacted"] for r in done[2:]] == ["Skip me", "Bob and Ann"]
    bad = replace(tables, entities=spark.createDataFrame([("p", "person name", 0, "Bob", 0)], PROFILE_ENTITY))
    with pytest.raises(Exception, match="entity type must match"):
        redact_column(df, "text", ["id"], bad, profile_column="profile", options=SALTED).collect()


def test_payloads_and_json_by_tables(spark):
    data = [(i, n, [("user", t)]) for i, (n, t) in enumerate((n, t) for n in [*PROFILES.names, "unknown", None] for t in TEXTS)]
    df = spark.createDataFrame(data, "id long, profile string, messages array<struct<role: string, content: string>>")
    tables = ProfileTables.of(spark, PROFILES)
    got = redact_payload(df, ["id"], ["messages"], tables, options=SALTED, profile_column="profile")
    want = redact_payload(df, ["id"], ["messages"], PROFILES, options=SALTED, profile_column="profile")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    bodies = [(i, n, json.dumps({"messages": [{"role": "user", "content": t}]})) for i, (_, n, ((_, t),)) in enumerate(data)]
    asked = spark.createDataFrame(bodies, "id long, profile string, body string")
    typed = {r["id"]: r["messages"][0]["content"] for r in want.collect()}
    for profiles in (tables, PROFILES):
        out, _, refused = redact_json(asked, ["id"], "body", profiles, options=SALTED, profile_column="profile")
        assert refused.count() == 0
        texts = {r["id"]: json.loads(r["redacted"])["messages"][0]["content"] for r in out.collect()}
        shape = lambda t: t and __import__("re").sub(r"_[0-9a-f]{8}>", ">", t)
        assert {k: shape(t) for k, t in texts.items()} == {k: shape(t) for k, t in typed.items()}


def test_rows_meet_large_dictionaries_whole(spark):
    plain = ProfileSet({n: {k: v for k, v in c.items() if k != "fuzzy_match"} for n, c in (
        ("names", {"custom_entities": {"PERSON": ["Bob", "Jonathan Smithers", "Ann Lee", "x"], "ORGANIZATION": ["Ann", "Bob"]}}),
        ("one", {"custom_entities": {"PERSON": ["Acme"]}}),
    )})
    df = rows(spark)
    folded = redact_column(df, "text", ["id"], plain, profile_column="profile", options=SALTED)
    few = replace(SALTED, fold_limit=2)
    done = redact_column(df, "text", ["id"], ProfileTables.of(spark, plain), profile_column="profile", options=few)
    assert sorted(map(repr, done.collect())) == sorted(map(repr, folded.collect()))
    assert "_text_hash" not in done._jdf.queryExecution().optimizedPlan().toString()  # rows are not joined to their texts again


def test_a_hot_group_meets_its_values_in_shares(spark):
    docs = spark.range(400).selectExpr("id", "'hot' AS g", "concat('name', id % 7, ' and ', repeat('x ', 50)) AS text", "map('k', id) AS m")
    known = spark.range(7).selectExpr("'hot' AS g", "'PERSON' AS entity_type", "0 AS type_ord", "concat('name', id) AS value", "0 AS value_ord")
    met = with_group_hits(docs, "text", known, "g", text_bytes=4_000)
    found = met.selectExpr("id", "m['k'] AS k", "transform(_hits, h -> h.value) AS v").collect()
    assert sorted((r["id"], r["k"], r["v"]) for r in found) == [(i, i, [f"name{i % 7}"]) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put small shares together
    try:
        again = with_group_hits(docs, "text", known, "g", text_bytes=4_000)
        assert again.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert with_group_hits(docs, "text", known, "g", part_bytes=5) is None
