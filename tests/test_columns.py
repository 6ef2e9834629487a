"""Redaction and restoration of text columns, with the sample conversations' outcomes."""

import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.text import eligible, is_skip_term, is_uuid_shaped
from cloakframe.operators import audit
from cloakframe.operators.restore import restore_column, round_trip_failures, unresolved_tokens
from cloakframe.operators.tokens import token_collisions
from cloakframe.options import Options
from cloakframe.plans.columns import mapping_rows, redact_column
from cloakframe.sources.profiles import ProfileSet

SALTED = Options(salt="test")
STAMP = "TIMESTAMP '2024-01-01 00:00:00'"
SHORT = {
    "short": {
        "thresholds": {"DEFAULT": 0.85},
        "custom_entities": {"PERSON": ["Lea", "Jo", "Li", "Al"], "LOCATION": ["LA"]},
        "fuzzy_match": {"enabled": True, "thresholds": {"DEFAULT": 80}},
    }
}


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def redact(spark, values, profiles=None, profile=None, **how):
    how.setdefault("options", SALTED)
    done = redact_column(texts(spark, *values), "text", ["id"], ProfileSet(profiles) if profiles else None, profile, **how)
    return done.cache()


def redacted(done):
    return [r["redacted"] for r in done.orderBy("id").collect()]


def restored(done, **how):
    known = mapping_rows(done, "text", created_at=STAMP)
    return [r["restored"] for r in restore_column(done, "redacted", known, ["id"], **how).orderBy("id").collect()]


def shape(text):
    return re.sub(r"_[0-9a-f]{8}>", "_H>", text)


def test_default_profile_outcomes(spark):
    values = [
        "My name is John Smith and my email is john.smith@example.com.",
        "My phone number is 555-123-4567 and I live in New York.",
        "Hi, I'm Sarah Johnson.",
        "Hello Sarah, how can I help you today?",
        "I need to send money to my friend. His account is 12345678 at Chase Bank.",
        "What is the capital of France?",
        "The capital of France is Paris.",
    ]
    done = redact(spark, values)
    assert [shape(t) for t in redacted(done)] == [
        "My name is <PERSON_H> and my email is <EMAIL_ADDRESS_H>.",
        "My phone number is <PHONE_NUMBER_H> and I live in New York.",
        "Hi, I'm <PERSON_H>.",
        "Hello <PERSON_H>, how can I help you today?",
        *values[4:],
    ]
    assert restored(done) == values


def test_custom_entities_round_trip(spark):
    profile = {
        "t": {
            "thresholds": {"DEFAULT": 0.85},
            "custom_entities": {"ORGANIZATION": ["Acme Test Corporation"], "PERSON": ["John Test User"]},
            "fuzzy_match": {"enabled": False},
        }
    }
    text = "I work at Acme Test Corporation and my name is John Test User."
    done = redact(spark, [text], profile, "t")
    assert shape(redacted(done)[0]) == "I work at <ORGANIZATION_H> and my name is <PERSON_H>."
    assert restored(done) == [text]


@pytest.mark.parametrize("threshold,kept", [(0.99, True), (0.85, False), (0.3, False)])
def test_thresholds_per_type(spark, threshold, kept):
    profile = {"t": {"thresholds": {"PERSON": threshold, "DEFAULT": 0.85}}}
    text = redacted(redact(spark, ["My name is Sarah Johnson."], profile, "t"))[0]
    assert ("Sarah Johnson" in text) is kept


def test_profile_default_affects_only_unlisted_types():
    resolved = ProfileSet({"h": {"thresholds": {"DEFAULT": 0.6}}}).resolve("h")
    assert resolved.threshold("PERSON") == 0.85
    assert resolved.threshold("CREDIT_CARD") == 0.6


def test_skip_terms_apply_to_the_whole_text(spark):
    profile = {
        "t": {
            "custom_entities": {"ORGANIZATION": ["TestCompany", "AnotherCompany"]},
            "skip_terms": ["TestCompany", "test@example.com"],
        }
    }
    values = ["TestCompany", "AnotherCompany", "I work at TestCompany.", "test@example.com"]
    assert [shape(t) for t in redacted(redact(spark, values, profile, "t"))] == [
        "TestCompany", "<ORGANIZATION_H>", "I work at <ORGANIZATION_H>.", "test@example.com",
    ]
    parity = redact(spark, values[:1], profile, "t", options=Options(salt="test", skip_parity=True))
    assert shape(redacted(parity)[0]) == "<ORGANIZATION_H>"


def test_short_names(spark):
    text = "My friends are Lea, Jo, Li, and Al from LA."
    done = redact(spark, [text, "Also Al"], SHORT, "short")
    assert shape(redacted(done)[0]) == (
        "My friends are <PERSON_H>, <PERSON_H>, <PERSON_H>, and <PERSON_H> from <LOCATION_H>."
    )
    assert shape(redacted(done)[1]) == "<PERSON_H>so <PERSON_H>"
    assert restored(done) == [text, "Also Al"]


def test_many_requests(spark):
    values = [f"User {i}'s email is user{i}@example.com and phone is 555-{i}{i}{i}-{i}{i}{i}{i}." for i in range(20)]
    done = redact(spark, values)
    out = redacted(done)
    assert not any("@example.com" in t for t in out)
    assert all("<PHONE_NUMBER_" in t for t in out[:10])
    assert mapping_rows(done, "text").select("mapping_id").distinct().count() == 20
    assert restored(done) == values


def test_edge_texts(spark):
    values = [None, "", "a@b", "a@b.c", "a@b.co", "0b0e9f3c-1111-2222-3333-444455556666", "a@b.co-ab-cdefghijklmnopqrstu-w-xy z"]
    assert len(values[6]) == 36 and values[6].count("-") == 4
    assert [shape(t) if t else t for t in redacted(redact(spark, values))] == [
        None, "", "a@b", "a@b.c", "<EMAIL_ADDRESS_H>", values[5], values[6],
    ]


def test_guards(spark):
    row = spark.sql(
        f"SELECT {eligible(chr(39) + 'abcd' + chr(39))} AS short, {eligible('NULL')} AS missing, "
        f"{is_uuid_shaped(chr(39) + 'a' * 32 + '----' + chr(39))} AS uuid, {is_skip_term('NULL', ['x'])} AS skip"
    ).first()
    assert tuple(row) == (False, False, True, False)


def test_left_replacement_does_not_shift_later_spans(spark):
    text = "mail john.smith@example.com then 192.168.10.20 then 4111111111111111 end"
    done = redact(spark, [text])
    assert shape(redacted(done)[0]) == "mail <EMAIL_ADDRESS_H> then <IP_ADDRESS_H> then <CREDIT_CARD_H> end"
    assert restored(done) == [text]


def test_value_like_a_type_name_does_not_touch_placeholders(spark):
    profile = {"t": {"custom_entities": {"ORGANIZATION": ["PERSON", "", "ab"], "PERSON": ["Bob Stone"]}}}
    text = "Bob Stone met PERSON, abba"
    done = redact(spark, [text], profile, "t")
    assert shape(redacted(done)[0]) == "<PERSON_H> met <ORGANIZATION_H>, <ORGANIZATION_H>ba"
    assert restored(done) == [text]


def test_overlaps_go_to_the_stronger_span(spark):
    done = redact(spark, ["see http://shop.example.com/a?b=1 or ann@mail.example.com or shop.example.com"])
    assert shape(redacted(done)[0]) == "see <URL_H> or <EMAIL_ADDRESS_H> or <DOMAIN_NAME_H>"


def test_regex_characters_in_dictionary_values(spark):
    value = r"a\E.*(b) $1"
    profile = {"t": {"custom_entities": {"PERSON": [value]}}}
    text = f"before {value} after {value}!"
    done = redact(spark, [text], profile, "t")
    assert shape(redacted(done)[0]) == "before <PERSON_H> after <PERSON_H>!"
    assert restored(done) == [text]


def test_accents_and_emoji_keep_offsets_right(spark):
    text = "é😀ü john@example.com ñ 10.0.0.1 😀"
    done = redact(spark, [text])
    assert shape(redacted(done)[0]) == "é😀ü <EMAIL_ADDRESS_H> ñ <IP_ADDRESS_H> 😀"
    assert restored(done) == [text]


def test_same_value_same_token_within_a_document(spark):
    done = redact(spark, ["a@b.co and a@b.co", "a@b.co again"])
    first, second = [re.findall(r"<\w+>", t) for t in redacted(done)]
    assert first[0] == first[1] and first[0] != second[0]
    shared = redact(spark, ["a@b.co and a@b.co", "a@b.co again"], options=Options(salt="test", scope="global"))
    tokens = {t for r in redacted(shared) for t in re.findall(r"<\w+>", r)}
    assert len(tokens) == 1


def test_tokens_are_the_same_when_computed_again(spark):
    values = ["a@b.co and 10.0.0.1"]
    assert redacted(redact(spark, values)) == redacted(redact(spark, values))
    other = redact(spark, values, options=Options(salt="another"))
    assert redacted(other) != redacted(redact(spark, values))


def test_wide_tokens_restore(spark):
    wide = Options(salt="test", token_hex=16)
    done = redact(spark, ["mail a@b.co"], options=wide)
    assert re.fullmatch(r"mail <EMAIL_ADDRESS_[0-9a-f]{16}>", redacted(done)[0])
    assert restored(done, options=wide) == ["mail a@b.co"]


def test_no_cross_restore_between_mappings(spark):
    known = spark.createDataFrame(
        [("m1", "p", "<PERSON_12345678>", "PERSON", "Ann", 1), ("m2", "p", "<PERSON_12345678>", "PERSON", "Bob", 2)],
        "mapping_id string, path string, placeholder string, entity_type string, original string, created_at int",
    )
    asked = spark.createDataFrame(
        [(1, "m1", "I am <PERSON_12345678>"), (2, "m2", "<PERSON_12345678>!"), (3, "m3", "<PERSON_12345678>?"), (4, None, "none")],
        "id long, mapping_id string, text string",
    )
    out = {r["id"]: r["restored"] for r in restore_column(asked, "text", known, ["id"]).collect()}
    assert out == {1: "I am Ann", 2: "Bob!", 3: "<PERSON_12345678>?", 4: "none"}
    anywhere = {r["id"]: r["restored"] for r in restore_column(asked, "text", known, ["id"], any_mapping=True).collect()}
    assert anywhere[3] == "Ann?"
    assert [tuple(r) for r in unresolved_tokens(asked, ["id"], "text", known).collect()] == [(3, "m3", "<PERSON_12345678>")]
    assert token_collisions(known).count() == 0


def test_response_with_handle(spark):
    known = spark.createDataFrame(
        [("m", "p", "<PERSON_12345678>", "PERSON", "John Smith", 1), ("m", "p", "<EMAIL_87654321>", "EMAIL", "john.smith@example.com", 1)],
        "mapping_id string, path string, placeholder string, entity_type string, original string, created_at int",
    )
    asked = spark.createDataFrame(
        [(1, "m", "I understand, <PERSON_12345678>. I'll send a confirmation to <EMAIL_87654321>.")], "id long, mapping_id string, text string"
    )
    assert restore_column(asked, "text", known, ["id"]).first()["restored"] == (
        "I understand, John Smith. I'll send a confirmation to john.smith@example.com."
    )


def test_type_fallback_stays_in_scope(spark):
    known = spark.createDataFrame(
        [("m1", "p", "<PERSON_00000001>", "PERSON", "Ann", 2), ("m1", "p", "<PERSON_00000002>", "PERSON", "Amy", 1),
         ("m2", "p", "<PERSON_00000003>", "PERSON", "Bob", 0)],
        "mapping_id string, path string, placeholder string, entity_type string, original string, created_at int",
    )
    asked = spark.createDataFrame(
        [(1, "m1", "<PERSON_ffffffff> and <US_PERSON_ffffffff>")], "id long, mapping_id string, text string"
    )
    assert restore_column(asked, "text", known, ["id"]).first()["restored"] == "<PERSON_ffffffff> and <US_PERSON_ffffffff>"
    out = restore_column(asked, "text", known, ["id"], type_fallback="scoped").first()["restored"]
    assert out == "Amy and <US_PERSON_ffffffff>"


def test_profile_per_row(spark):
    profiles = ProfileSet({"default": {}, "strict": {"thresholds": {"IP_ADDRESS": 1.1}}})
    df = spark.createDataFrame([(1, None, "at 10.0.0.1"), (2, "strict", "at 10.0.0.1"), (3, "unknown", "at 10.0.0.1")], "id long, profile string, text string")
    done = redact_column(df, "text", ["id"], profiles, profile_column="profile", options=SALTED)
    assert [shape(t) for t in redacted(done)] == ["at <IP_ADDRESS_H>", "at 10.0.0.1", "at <IP_ADDRESS_H>"]


def test_disabled_types_and_one_way(spark):
    done = redact(spark, ["a@b.co 10.0.0.1"], options=Options(salt="test", disabled_types=frozenset({"IP_ADDRESS"})))
    assert shape(redacted(done)[0]) == "<EMAIL_ADDRESS_H> 10.0.0.1"
    assert mapping_rows(done, "text", options=Options(keep_mappings=False)).count() == 0


def test_a_text_full_of_matches(spark):
    text = " ".join(f"u{i}@example.com" for i in range(3000))
    done = redact(spark, [text])
    assert "@" not in redacted(done)[0]
    assert restored(done) == [text]


def test_round_trip_report_and_metrics(spark):
    done = redact(spark, ["mail a@b.co", "nothing to see"])
    back = restore_column(done, "redacted", mapping_rows(done, "text", created_at=STAMP), ["id"])
    assert round_trip_failures(done, back, ["id"], "text", "restored").count() == 0
    assert round_trip_failures(done, done, ["id"], "text", "redacted").count() == 1
    watched, watch = audit.observed(done)
    watched.write.format("noop").mode("overwrite").save()
    assert watch.get == {"rows": 2, "entities": 1, "rows_with_entities": 1}


def test_redaction_plan_has_no_shuffle(spark):
    plan = redact_column(spark.range(10).selectExpr("id", "'a@b.co' AS text"), "text", ["id"], options=SALTED)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_copies_of_a_row_are_all_restored(spark):
    known = spark.createDataFrame(
        [("m1", "p", "<PERSON_12345678>", "PERSON", "Ann", 1), ("m2", "p", "<PERSON_12345678>", "PERSON", "Bob", 1)],
        "mapping_id string, path string, placeholder string, entity_type string, original string, created_at int",
    )
    rows = [(1, "m1", "hi <PERSON_12345678>")] * 50 + [(1, "m2", "hi <PERSON_12345678>")] * 3
    asked = spark.createDataFrame(rows, "id long, mapping_id string, text string")
    counts = restore_column(asked, "text", known, ["id"]).groupBy("restored").count().collect()
    assert {(r["restored"], r["count"]) for r in counts} == {("hi Ann", 50), ("hi Bob", 3)}


def test_written_products_restore(spark, tmp_path):
    from cloakframe.operators.store import read_mappings
    from cloakframe.sources.sinks import write_redacted_column

    done = redact_column(texts(spark, "mail a@b.co", "plain words"), "text", ["id"], options=SALTED)
    write_redacted_column(done, "text", str(tmp_path / "out"), str(tmp_path / "maps"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert set(written.columns) == {"id", "mapping_id", "redacted"}
    back = restore_column(written, "redacted", read_mappings(spark, str(tmp_path / "maps")), ["id"])
    assert [r["restored"] for r in back.orderBy("id").collect()] == ["mail a@b.co", "plain words"]


FUZZY = {"PERSON": ["John Doe", "Anna"], "ORGANIZATION": ["Acme Corp"]}


@pytest.mark.parametrize("threshold", [80, 60])
def test_fuzzy_profiles_and_large_dictionaries(spark, threshold):
    fuzzy = {"enabled": True, "thresholds": {"DEFAULT": threshold}}
    many = [f"Nobody {i:05d}x" for i in range(300)]
    profiles = ProfileSet({
        "small": {"custom_entities": FUZZY, "fuzzy_match": fuzzy},
        "large": {"custom_entities": {**FUZZY, "OTHER": many}, "fuzzy_match": fuzzy},
        "off": {"custom_entities": {**FUZZY, "OTHER": many}, "fuzzy_match": {"enabled": False}},
    })
    texts = ["I met Jon Doe today, and Anna.", "At Acme Corp. with JOHN DOE!", "nothing to see here", None, "", "I met Jon Doe today, and Anna."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    def redacted(name, **how):
        rows = redact_column(df, "text", ["doc_id"], profiles, name, options=Options(salt="s", **how)).collect()
        return {r["doc_id"]: re.sub("_[0-9a-f]{8}>", ">", r["redacted"] or "") for r in rows}

    small = redacted("small")
    assert "Doe" not in small[0] and "Anna" not in small[0] and "DOE" not in small[1]
    assert redacted("large") == redacted("large", fold_limit=1000)
    if threshold == 80:
        assert small[0] == "I met <PERSON> today, and <PERSON>." == small[5]
        assert redacted("large") == small
    assert redacted("off") == redacted("off", fold_limit=1000)
    assert redacted("off")[0] == "I met Jon Doe today, and <PERSON>."
    per_row = redact_column(df.withColumn("p", F.lit("small")), "text", ["doc_id"], profiles, profile_column="p", options=Options(salt="s"))
    assert {r["doc_id"]: re.sub("_[0-9a-f]{8}>", ">", r["redacted"] or "") for r in per_row.collect()} == small


def test_no_part_of_a_value_stays(spark):
    texts = {
        "My name is José García.": "My name is <PERSON>.",
        "Hello Anna Müller, hi": "Hello <PERSON>, hi",
        "Guten Tag Herr Müller.": "Guten Tag Herr <PERSON>.",
        "I'm Sean O'Brien-McDonald today": "I'm <PERSON> today",
        "q" * 80 + "@mail.example.com": "<EMAIL_ADDRESS>",
        "see shop.example.nl and site.jp": "see <DOMAIN_NAME> and <DOMAIN_NAME>",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = redact_column(df, "text", ["doc_id"], options=Options(salt="s")).collect()
    assert [re.sub("_[0-9a-f]{8}>", ">", r["redacted"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == list(texts.values())


def test_a_salt_is_required(spark):
    with pytest.raises(ValueError, match="salt"):
        redact_column(texts(spark, "mail a@b.co"), "text", ["id"])
