"""Automaton, sweep, tagger, pruned lookups and eviction."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.operators import dictionary, store, sweep, tagger
from cloakframe.operators.automaton import Values
from cloakframe.operators.detect import BUILT_IN, detect, span_rows
from cloakframe.operators.model import model_spans
from cloakframe.operators.redact import redact_candidates
from cloakframe.operators.restore import restore_column
from cloakframe.options import Options
from cloakframe.plans.columns import mapping_rows, redact_column
from cloakframe.schemas import CANDIDATES

SALTED = Options(salt="test")


@given(st.text("ab ", max_size=40), st.lists(st.text("ab ", min_size=1, max_size=4), max_size=6))
@settings(max_examples=200, deadline=None)
def test_automaton_finds_what_replace_would(text, values):
    found = Values(values)
    assert found.in_text(text) == {v for v in values if v in text}
    places = {}
    for start, value in found.places(text):
        assert text[start : start + len(value)] == value
        places.setdefault(value, []).append(start)
    assert {v: len(p) for v, p in places.items()} == {v: text.count(v) for v in set(values) if v in text}


@pytest.mark.parametrize("part_bytes", [None, 400])
def test_large_dictionaries_by_automaton(spark, part_bytes):
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(80)] + [(100, None), (101, ""), (101, "abcabc")]
    values = sorted(set(rng.sample(words, 120)) | {"b c", "", "é"})
    known = spark.createDataFrame([("T", 0, v, n) for n, v in enumerate(values)], "entity_type string, type_ord int, value string, value_ord int")
    df = spark.createDataFrame(texts, "id long, text string")
    got = dictionary.dictionary_hits_join(df, ["id"], "text", known, part_bytes).select("id", "value").collect()
    assert sorted(map(tuple, got)) == sorted({(i, v) for i, t in texts if t for v in values if v and v in t})


def rows_of(text, candidates):
    names = ("priority", "type_ord", "value_ord", "neg_score", "entity_type", "value", "source")
    return [dict(zip(names, c, strict=True)) for c in candidates]


def test_sweep_equals_the_expression(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab é1 ") for _ in range(rng.randrange(5, 120)))
        own = []
        for _ in range(rng.randrange(1, 25)):
            a = rng.randrange(len(text))
            value = text[a : a + rng.randrange(1, 7)]
            own.append((rng.randrange(3), rng.randrange(2), rng.randrange(3), -rng.choice([0.5, 0.85, 1.0]), rng.choice(["A", "B_C"]), value, rng.choice(["exact", "pattern"])))
        rows.append((i, text, own))
    df = spark.createDataFrame(rows, f"id long, text string, found {CANDIDATES}")
    done = df.withColumn("r", F.expr(redact_candidates(SALTED, "text", "concat('m', id)", "found"))).collect()
    for r, (i, text, own) in zip(sorted(done, key=lambda r: r["id"]), rows, strict=True):
        new, entities = sweep.redacted(text, f"m{i}", rows_of(text, own), "test", 8)
        assert (r["r"]["text"], [e.asDict() for e in r["r"]["entities"]]) == (new, entities)


def test_many_values_take_time_in_proportion(spark):
    def seconds(n):
        text = " ".join(f"user{i}@mail.example.com" for i in range(n))
        df = spark.createDataFrame([(1, text)], "id long, text string")
        started = time.perf_counter()
        row = redact_column(df, "text", ["id"], options=SALTED).first()
        assert "@" not in row["redacted"] and len(row["entities"]) == n
        return time.perf_counter() - started

    seconds(1000)
    assert seconds(8000) <= 10 * seconds(1000)


def test_nothing_is_left_of_long_addresses_and_rare_endings(spark):
    long = "q" * 1010 + "@example.com"
    texts = [(1, f"write to {long} now"), (2, "see shop.photography, please"), (3, "a@b.co.x@y.de and ab@c@d.org"), (4, "Ends here.The next one."), (5, "." * 30_000 + "@")]
    df = spark.createDataFrame(texts, "id long, text string")
    done = {r["id"]: (r["redacted"], [e["original"] for e in r["entities"]]) for r in redact_column(df, "text", ["id"], options=SALTED).collect()}
    assert done[1][1] == [long] and "q" not in done[1][0]
    assert done[2][1] == ["shop.photography"] and done[4][1] == []
    assert sorted(done[3][1]) == [".x@y.de", "a@b.co", "c@d.org"]


def test_restoration_reads_what_is_asked_for(spark):
    df = spark.createDataFrame([(i, f"mail a{i}@b.co") for i in range(20)], "id long, text string")
    done = redact_column(df, "text", ["id"], options=SALTED)
    known = mapping_rows(done, "text", created_at="TIMESTAMP '2024-01-01 00:00:00'", options=SALTED)
    back = restore_column(done.where("id < 3").drop("entities"), "redacted", known, ["id"], options=SALTED)
    assert sorted(r["restored"] for r in back.collect()) == [f"mail a{i}@b.co" for i in range(3)]
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("min_by") < plan.index("LeftSemi")  # the aggregate stands above the pruned store


def test_global_scope_combines_rows(spark):
    options = Options(salt="test", scope="global")
    df = spark.createDataFrame([(1, "mail a@b.co"), (1, "again a@b.co")], "id long, text string")
    assert mapping_rows(redact_column(df, "text", ["id"], options=options), "text", options=options).count() == 1


def test_eviction_with_one_hot_second(spark):
    rows = [("t", i, "2024-01-01 00:00:07") for i in range(4000)] + [("t", 5000 + i, f"2024-01-01 00:00:{8 + i % 50:02d}") for i in range(700)]
    rows += [("u", i, "2024-01-01 00:00:07") for i in range(10)]
    access = spark.createDataFrame(rows, "tenant string, mapping_id long, at string").selectExpr("tenant", "mapping_id", "timestamp(at) AS last_access")
    kept = store.keep_recent(access, 1500, ["tenant"]).select("tenant", "mapping_id").collect()
    want = {("t", i) for i in range(800)} | {("t", 5000 + i) for i in range(700)} | {("u", i) for i in range(10)}
    assert {tuple(r) for r in kept} == want and len(kept) == len(want)


# -- tagger ----------------------------------------------------------------------------------


@given(st.integers(1, 5), st.integers(0, 1000))
@settings(max_examples=60, deadline=None)
def test_viterbi_against_all_paths(n, seed):
    from itertools import product

    rng = np.random.default_rng(seed)
    tags = tagger.tag_names(["A", "B"])
    allowed, first = tagger.order_of(tags)
    emit, trans = rng.normal(size=(n, len(tags))), rng.normal(size=(len(tags), len(tags)))
    paths = [p for p in product(range(len(tags)), repeat=n) if first[p[0]] and all(allowed[a, b] for a, b in zip(p, p[1:]))]
    value = lambda p: sum(emit[i, t] for i, t in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
    assert tuple(tagger.viterbi(emit, trans, allowed, first)) == max(paths, key=value)


def test_tagger_learns_names_it_has_not_seen(spark):
    rng = random.Random(2)
    syllables = "ka lo mi ren tas vo bel dor fin gu han jor".split()
    name = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4))).capitalize()
    frames = [("yesterday {} called about the house", "PERSON"), ("our friend {} wrote a letter", "PERSON"), ("they moved to {} last year", "LOCATION"), ("the road near {} was closed", "LOCATION"), ("The weather was fine and Nothing happened", None)]

    def sentence():
        frame, kind = rng.choice(frames)
        if kind is None:
            return frame, []
        own = f"{name()} {name()}" if kind == "PERSON" else name()
        at = frame.index("{}")
        return frame.format(own), [(at, at + len(own), kind)]

    rows = [(i, *sentence()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<start int, end int, entity_type string>>")
    model = tagger.fit(df.where("id < 300"), sample=200, epochs=4)
    assert model.types == ["LOCATION", "PERSON"]
    found = {(r["id"], r["start"], r["end"], r["entity_type"]) for r in model_spans(df.where("id >= 300"), ["id"], "text", model.load).collect()}
    want = {(i, *s) for i, _, spans in rows if i >= 300 for s in spans}
    assert len(found & want) >= 0.95 * max(len(found), len(want))
    again = tagger.fit(df.where("id < 300").repartition(7), sample=200, epochs=4)
    assert np.array_equal(again.at, model.at) and np.allclose(again.weight, model.weight)


def test_tagger_without_labels(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "id long, text string").withColumn("spans", F.expr(detect("text", BUILT_IN)))
    assert span_rows(df, ["id"], "spans").count() == 0
    model = tagger.fit(df)
    assert model.types == [] and model_spans(df, ["id"], "text", model.load).count() == 0
