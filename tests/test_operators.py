"""Single operators on small inputs, against plain Python where there is a rule to check."""

import random

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.checks import iban_valid, ipv6_valid, luhn_valid
from cloakframe.functions.register import register_functions
from cloakframe.functions.similarity import indel_ratio, lcs_length, may_reach
from cloakframe.functions.text import occurrences, running_starts
from cloakframe.operators import asof, fuzzy, store
from cloakframe.operators.detect import Detector, DetectorRegistry, detect, span_rows
from cloakframe.operators.dictionary import dictionary_hits_join
from cloakframe.operators.gazetteer import gazetteer_spans, span_candidates
from cloakframe.operators.model import each_text, model_spans
from cloakframe.operators.overlap import resolve_overlaps
from cloakframe.options import Options, check_type_name
from cloakframe.plans.columns import redact_column
from cloakframe.sources.profiles import (
    ProfileSet, default_profiles, literal_table, load_profiles, write_profile_template,
)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        left = 0
        new = [0]
        for j, other in enumerate(b, 1):
            left = row[j - 1] + 1 if ch == other else max(left, row[j])
            new.append(left)
        row = new
    return row[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def test_similarity_matches_plain_python(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abcé ", k=rng.randint(0, 9))), "".join(rng.choices("abcé ", k=rng.randint(0, 9)))) for _ in range(300)]
    pairs += [("john doe", "jon doe"), ("lea", "lee"), ("smith", "smyth")]
    rows = (
        spark.createDataFrame(pairs, "a string, b string")
        .select("a", "b", F.expr(lcs_length("a", "b")).alias("l"), F.expr(indel_ratio("a", "b")).alias("r"),
                F.expr(may_reach("a", "b", "80.0D")).alias("may"))
        .collect()
    )
    for r in rows:
        assert r["l"] == lcs(r["a"], r["b"])
        assert r["r"] == pytest.approx(ratio(r["a"], r["b"]))
        assert r["may"] or r["r"] < 80
    assert {(r["a"], round(r["r"], 2)) for r in rows[-3:]} == {("john doe", 93.33), ("lea", 66.67), ("smith", 80.0)}


def brute_force(text, dictionary, threshold):
    ws = text.split()
    phrases = [" ".join(ws[i:j]) for i in range(len(ws)) for j in range(i + 1, min(i + 6, len(ws) + 1))]
    phrases = [p for p in phrases if len(p) > 2]
    out = set()
    for value in dictionary:
        if value in text:
            out.add((value, value, 100.0))
            continue
        for p in phrases:
            if ratio(p.lower(), value.lower()) >= threshold:
                out.add((value, p, round(ratio(p.lower(), value.lower()), 6)))
                break
    return out


@pytest.mark.parametrize("threshold", [67, 80, 92])
@pytest.mark.parametrize("fold_limit", [256, 5])
def test_fuzzy_hits_match_brute_force(spark, threshold, fold_limit):
    rng = random.Random(threshold)
    word = lambda lo, hi: "".join(rng.choices("aAbBcd", k=rng.randint(lo, hi)))
    values = sorted({word(3, 8) for _ in range(25)} | {"ab cd ab", "dcba ab"})
    rows = [(i, " ".join(word(1, 6) for _ in range(rng.randint(0, 14)))) for i in range(30)]
    profile = ProfileSet(
        {"t": {"custom_entities": {"PERSON": values}, "fuzzy_match": {"enabled": True, "thresholds": {"DEFAULT": threshold}}}}
    ).resolve("t")
    df = spark.createDataFrame(rows, "id long, text string")
    found = fuzzy.fuzzy_hits(df, ["id"], "text", profile, Options(fold_limit=fold_limit)).collect()
    got = {(r["id"], r["value"], r["phrase"], round(r["score"], 6)) for r in found}
    assert got == {(i, *h) for i, t in rows for h in brute_force(t, values, threshold)}


def test_fuzzy_hits_from_a_dictionary_table(spark):
    rows = [("PERSON", 0, "John Doe", 0, 80.0), ("LOCATION", 1, "Springfield", 0, 90.0), ("LOCATION", 1, "x", 1, 90.0)]
    dictionary = spark.createDataFrame(rows, fuzzy.DICTIONARY)
    df = spark.createDataFrame([(1, "jon doe of Springfeld"), (2, "John Doe"), (3, None)], "id long, text string")
    got = {(r["id"], r["value"], r["phrase"]) for r in fuzzy.fuzzy_hits(df, ["id"], "text", dictionary=dictionary).collect()}
    assert got == {(1, "John Doe", "jon doe"), (1, "Springfield", "Springfeld"), (2, "John Doe", "John Doe")}
    low = fuzzy.fuzzy_hits(df, ["id"], "text", dictionary=dictionary.withColumn("threshold", F.lit(50.0))).collect()
    texts = {1: "jon doe of Springfeld", 2: "John Doe"}
    assert {(r["id"], r["value"], r["phrase"], round(r["score"], 6)) for r in low} == {
        (i, *h) for i, t in texts.items() for h in brute_force(t, ["John Doe", "Springfield"], 50)
    }


def test_fuzzy_redaction_hides_the_misspelling(spark):
    profiles = ProfileSet(
        {"t": {"custom_entities": {"PERSON": ["John Doe"]}, "fuzzy_match": {"enabled": True, "thresholds": {"DEFAULT": 80}}}}
    )
    df = spark.createDataFrame([(1, "I met Jon Doe today"), (2, "I met John Doe."), (3, "someone named Lee")], "id long, text string")
    hits = fuzzy.fuzzy_hits(df, ["id"], "text", profiles.resolve("t"))
    extra = df.join(fuzzy.fuzzy_candidates(hits, ["id"]), "id", "left")
    out = {r["id"]: r for r in redact_column(extra, "text", ["id"], profiles, "t", options=Options(salt="test"), extra="candidates").collect()}
    assert out[1]["redacted"].startswith("I met <PERSON_") and out[1]["redacted"].endswith("> today")
    assert [(e["original"], e["source"]) for e in out[1]["entities"]] == [("Jon Doe", "fuzzy")]
    assert [(e["original"], e["source"]) for e in out[2]["entities"]] == [("John Doe", "exact")]
    assert out[3]["redacted"] == "someone named Lee"


def test_short_fuzzy_names_do_not_meet(spark):
    profile = ProfileSet(
        {"t": {"custom_entities": {"PERSON": ["Lea", "Jo"]}, "fuzzy_match": {"enabled": True, "thresholds": {"DEFAULT": 80}}}}
    ).resolve("t")
    df = spark.createDataFrame([(1, "I know someone named Lee and another named Lei.")], "id long, text string")
    assert fuzzy.fuzzy_hits(df, ["id"], "text", profile).count() == 0


def test_offsets_across_blocks(spark):
    text = "".join(f"{'x' * (i % 7)}é@" for i in range(1500))
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(
        F.expr(occurrences("t", "'é@'")).alias("o"),
        F.expr(running_starts("split(t, 'é@', -1)", "regexp_extract_all(t, 'é@', 0)")).alias("s"),
    ).first()
    want, at = [], text.find("é@")
    while at >= 0:
        want.append(at)
        at = text.find("é@", at + 2)
    assert row["o"] == want and row["s"] == want


def test_dictionary_join_is_substring_search(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abc \n", k=rng.choice([0, 3, 700, 1300])))) for i in range(12)]
    words = sorted({"".join(rng.choices("abc ", k=rng.randint(1, 6))) for _ in range(30)})
    df = spark.createDataFrame(rows, "id long, text string")
    dictionary = literal_table(spark, [("PERSON", 0, w, i) for i, w in enumerate(words)], "entity_type STRING, type_ord INT, value STRING, value_ord INT")
    got = {(r["id"], r["value"]) for r in dictionary_hits_join(df, ["id"], "text", dictionary).collect()}
    assert got == {(i, w) for i, t in rows for w in words if w in t}


def test_overlap_resolution_is_greedy_by_rank(spark):
    rng = random.Random(9)

    def greedy(spans):
        kept = []
        for s in sorted(spans, key=lambda x: (x[2], x[3], x[4], x[5], x[0], x[0] - x[1], x[1])):
            if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
                kept.append(s)
        return sorted((s[0], s[1]) for s in kept)

    docs = []
    for i in range(60):
        spans = []
        for _ in range(rng.randint(0, 14)):
            start = rng.randint(0, 40)
            spans.append((start, start + rng.randint(1, 8), rng.randint(0, 2), 0, rng.randint(0, 1), -rng.random()))
        docs.append((i, spans))
    schema = "id int, s array<struct<start:int,end:int,priority:int,type_ord:int,value_ord:int,neg_score:double>>"
    full = (
        "transform(s, x -> named_struct('start', x.start, 'end', x.end, 'priority', x.priority, 'type_ord', x.type_ord, "
        "'value_ord', x.value_ord, 'neg_score', x.neg_score, 'neg_length', x.start - x.end, 'entity_type', 'T', 'value', 'v', 'source', 's'))"
    )
    rows = spark.createDataFrame(docs, schema).select("id", "s", F.expr(resolve_overlaps(full)).alias("k")).collect()
    for r in rows:
        assert [(k["start"], k["end"]) for k in r["k"]] == greedy([tuple(x) for x in r["s"]])


def test_validators(spark):
    row = spark.sql(
        f"""SELECT {luhn_valid("'4111 1111 1111 1111'")} a, {luhn_valid("'4111111111111112'")} b,
        {iban_valid("'DE89370400440532013000'")} c, {iban_valid("'DE89370400440532013001'")} d,
        {ipv6_valid("'2001:db8::1'")} e, {ipv6_valid("'12:30:45'")} f, {ipv6_valid("'1:2:3:4:5:6:7:8'")} g, {ipv6_valid("'1::2::3'")} h"""
    ).first()
    assert tuple(row) == (True, False, True, False, True, False, True, False)


@pytest.mark.parametrize(
    "text,types",
    [
        ("ip 10.0.0.256", []),
        ("ip 1.2.3.4.5", []),
        ("v1.2.3.4x", []),
        ("at 2001:db8::ff00:42:8329 now", ["IP_ADDRESS"]),
        ("time 12:30:45", []),
        ("card 4111 1111 1111 1111", ["CREDIT_CARD"]),
        ("card 4111111111111112", []),
        ("iban DE89370400440532013000", ["IBAN_CODE"]),
        ("my ssn 078-05-1120", ["US_SSN"]),
        ("no. 078-05-1120", []),
        ("call 555-1234", ["PHONE_NUMBER"]),
        ("room 555-1234", []),
        ("born 1998-02-03", ["DATE_TIME"]),
        ("on 1998-02-03", []),
        ("born 1998-13-03", []),
        ("visit shop.example.com, please", ["DOMAIN_NAME"]),
        ("x.company", ["DOMAIN_NAME"]),  # any ending counts
        ("4465758382889437 4465758382889437", ["CREDIT_CARD"]),
    ],
)
def test_detectors_under_default_thresholds(spark, text, types):
    from cloakframe.options import DEFAULT_THRESHOLDS

    df = spark.createDataFrame([(1, text)], "id long, text string")
    found = span_rows(df, ["id"], detect("text", DetectorRegistry().all(), DEFAULT_THRESHOLDS)).collect()
    assert sorted({r["entity_type"] for r in found}) == types
    assert all(text[r["start"]:r["end"]] == r["value"] for r in found)


def test_registry_rules_from_a_table(spark):
    rules = spark.createDataFrame([("badge", "BADGE", "B-[0-9]{4}", 0.9, None)], "name string, entity_type string, pattern string, score double, lang string")
    registry = DetectorRegistry([]).add_rules(rules)
    df = spark.createDataFrame([(1, "badge B-1234")], "id long, text string")
    assert [r["value"] for r in span_rows(df, ["id"], detect("text", registry.all())).collect()] == ["B-1234"]
    with pytest.raises(ValueError):
        Detector("x", "lower1", "x", 1.0)
    with pytest.raises(ValueError):
        check_type_name("US_SSN2")


def test_gazetteer_and_model_as_extra_candidates(spark):
    df = spark.createDataFrame([(1, "We flew from New York to Paris, then New  York."), (2, None)], "id long, text string")
    places = spark.createDataFrame([("New York", "LOCATION", 0.9), ("Paris", "LOCATION", 0.9), ("Paris", "NRP", 0.1)], "value string, entity_type string, score double")
    spans = gazetteer_spans(df, ["id"], "text", places)
    assert sorted((r["start"], r["value"], r["entity_type"]) for r in spans.collect()) == [(13, "New York", "LOCATION"), (25, "Paris", "LOCATION")]
    extra = df.join(span_candidates(spans, ["id"]), "id", "left")
    out = redact_column(extra, "text", ["id"], options=Options(salt="test"), extra="candidates").where("id = 1").first()["redacted"]
    assert "Paris" not in out and "New  York" in out and out.count("<LOCATION_") == 2

    def load():
        return each_text(lambda t: [("PERSON", 0, 2, 0.9)] if t.startswith("We") else [])

    assert [(r["value"], r["source"]) for r in model_spans(df, ["id"], "text", load).collect()] == [("We", "model")]


def test_profiles_load_and_fall_back(tmp_path):
    missing = load_profiles(str(tmp_path / "none.yaml"))
    assert missing == default_profiles() and not ProfileSet(missing).resolve().fuzzy_enabled
    path = tmp_path / "sub" / "profiles.yaml"
    assert write_profile_template(str(path)) is True
    assert write_profile_template(str(path)) is False
    loaded = ProfileSet(load_profiles(str(path)))
    assert set(loaded.names) == {"default", "high_security"}
    assert loaded.resolve("high_security").fuzzy_threshold("PERSON") == 75
    assert [v.value for v in loaded.resolve("default").dictionary][:2] == ["John Doe", "Jane Smith"]
    assert loaded.resolve("nobody").dictionary == ()
    path.write_text("")
    assert load_profiles(str(path)) == default_profiles()
    for content in ("profiles: [1]", "a: b", ":\n :", "profiles: {a: 1}", "{"):
        path.write_text(content)
        with pytest.raises(ValueError):
            load_profiles(str(path))


def test_lru_follows_the_event_order(spark):
    # add 1, 2, 3; get 1, 2, 3; add 4 evicts 1; get 2, 3, 4; get 2; add 5 evicts 3
    def kept(created, accesses):
        c = spark.createDataFrame(created, "mapping_id string, created_at int")
        a = spark.createDataFrame(accesses, "mapping_id string, accessed_at int")
        return {r["mapping_id"] for r in store.keep_recent(store.last_access(c, a), 3).collect()}

    created = [("1", 1), ("2", 2), ("3", 3), ("4", 7)]
    accesses = [("1", 4), ("2", 5), ("3", 6)]
    assert kept(created, accesses) == {"2", "3", "4"}
    created = [*created[1:], ("5", 12)]
    accesses = [*accesses[1:], ("2", 8), ("3", 9), ("4", 10), ("2", 11), ("1", 13)]
    assert kept(created, accesses) == {"2", "4", "5"}


def test_large_capacity_equals_the_window(spark):
    rng = random.Random(2)
    rows = [(t, i, f"2024-01-01 00:00:{rng.randint(0, 4):02d}.{rng.randint(0, 9)}") for t in "ab" for i in range(3000)]
    access = spark.createDataFrame(rows, "tenant string, mapping_id int, at string").select(
        "tenant", "mapping_id", F.to_timestamp("at").alias("last_access")
    )
    got = {(r["tenant"], r["mapping_id"]) for r in store.keep_recent(access, 1200, ["tenant"]).collect()}
    want = set()
    for t in "ab":
        mine = sorted((r for r in access.collect() if r["tenant"] == t), key=lambda r: (-r["last_access"].timestamp(), r["mapping_id"]))
        want |= {(t, r["mapping_id"]) for r in mine[:1200]}
    assert got == want
    assert store.keep_recent(access, 5000).count() == 5000


def test_mapping_store_folder(spark, tmp_path):
    path = str(tmp_path / "mappings")
    rows = spark.sql(
        "SELECT * FROM VALUES ('m1', '<A_00000001>', 'x', TIMESTAMP '2024-01-01 10:00:00'), "
        "('m1', '<A_00000001>', 'y', TIMESTAMP '2024-01-02 10:00:00'), ('m2', '<A_00000002>', 'z', TIMESTAMP '2024-01-03 10:00:00') "
        "AS t(mapping_id, placeholder, original, created_at)"
    )
    store.append_mappings(rows, path)
    everything = store.read_mappings(spark, path)
    assert everything.count() == 3
    assert store.read_mappings(spark, path, "2024-01-02").count() == 2
    latest = store.latest_mappings(everything.drop("created_date"), ["created_at"])
    assert {(r["mapping_id"], r["original"]) for r in latest.collect()} == {("m1", "y"), ("m2", "z")}
    assert store.unexpired(everything, F.expr("TIMESTAMP '2024-01-03 10:00:00'"), 86400).count() == 2
    assert store.get_mapping(everything, "m2").count() == 1
    recent = store.keep_recent(everything.groupBy("mapping_id").agg(F.max("created_at").alias("last_access")), 1)
    assert [r["mapping_id"] for r in store.drop_evicted(everything, recent).collect()] == ["m2"]


def test_asof_matches_brute_force(spark):
    rng = random.Random(4)
    requests = [(rng.randint(0, 3), rng.randint(0, 400), i) for i in range(60)]
    responses = [(rng.randint(0, 4), rng.randint(0, 400), i) for i in range(80)]
    ts = lambda n: F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.col(n))
    q = spark.createDataFrame(requests, "s int, t int, rid int").withColumn("at", ts("t")).drop("t")
    r = spark.createDataFrame(responses, "s int, t int, k int").withColumn("at", ts("t")).drop("t")
    answers = asof.asof_latest(q, r, "s", "at", "rid", ["k"])
    got = {row["k"]: row["latest_id"] for row in answers.collect()}
    want = {}
    for s, t, k in responses:
        before = [(qt, rid) for qs, qt, rid in requests if qs == s and qt <= t]
        want[k] = max(before)[1] if before else None
    assert got == want
    close = {row["k"] for row in asof.within_ttl(answers, "at", 30).collect()}
    times = {rid: qt for _, qt, rid in requests}
    assert close == {k for s, t, k in responses if want[k] is not None and t - times[want[k]] <= 30}


def test_sql_functions(spark):
    names = register_functions(spark, Options(salt="test"))
    assert "anonymize_text" in names
    row = spark.sql(
        "SELECT is_uuid_shaped('x') a, round(indel_ratio('lea', 'lee'), 2) b, mint_token('s', 'PERSON', 'Ann') c, "
        "anonymize_text('mail a@b.co', 's').text d, size(detect_spans('a@b.co')) e"
    ).first()
    assert (row["a"], row["b"]) == (False, 66.67)
    assert row["c"].startswith("<PERSON_") and row["d"].startswith("mail <EMAIL_ADDRESS_") and row["e"] >= 1


def test_patterns_must_not_look_around():
    for pattern in ("^a", "a$", r"\bx", "(?=a)b", "(?<!a)b"):
        with pytest.raises(ValueError):
            Detector("x", "T", pattern, 1.0)
    Detector("x", "T", r"[^a][$]\^b", 1.0)


def test_adjacent_and_repeated_matches_are_located(spark):
    rule = Detector("r", "T", "a+b?", 1.0)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("aabc ", k=rng.choice([0, 1, 20, 400])))) for i in range(40)]
    import re

    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r["id"], r["start"], r["value"]) for r in span_rows(df, ["id"], detect("text", [rule])).collect()}
    assert got == {(i, m.start(), m.group()) for i, t in rows for m in re.finditer("a+b?", t)}


def test_thresholds_per_row_profile(spark):
    from cloakframe.operators import audit

    profiles = ProfileSet({"default": {}, "p": {"thresholds": {"PERSON": 0.2, "DEFAULT": 0.4}}})
    rows = [("PERSON", 0.3, "p"), ("PERSON", 0.3, None), ("OTHER", 0.5, "p"), ("OTHER", 0.5, "who"), ("URL", 0.8, "p"), ("URL", 0.79, "p")]
    df = spark.createDataFrame(rows, "entity_type string, score double, profile string")
    kept = audit.apply_thresholds(df, profiles)
    assert {(r["entity_type"], r["score"], r["profile"]) for r in kept.collect()} == {("PERSON", 0.3, "p"), ("OTHER", 0.5, "p"), ("URL", 0.8, "p")}
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    counts = {r["entity_type"]: (r["default"], r["p"]) for r in audit.compare_profiles(df, profiles, ["default", "p"]).collect()}
    assert counts == {"PERSON": (0, 2), "OTHER": (0, 2), "URL": (1, 1)}
    both = {(r["profile"], r["entity_type"]): r["threshold"] for r in profiles.resolved_thresholds(spark).collect()}
    assert both[("p", "PERSON")] == 0.2 and both[("p", "URL")] == 0.8 and both[("default", "DEFAULT")] == 0.85
