"""Fuzzy matching in Arrow batches gives what the row expression gives."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cloakframe.operators.fuzzy import folded_fuzzy, fuzzy_bounds, fuzzy_literal, near_candidates, near_column
from cloakframe.operators.near import NearValues
from cloakframe.options import Options
from cloakframe.sources.profiles import ProfileSet

VALUES = ["pathetic", "the and", "Müller", "Ann", "a b c", "x" * 40 + "y" * 40, "ΣΑΣ", "\U0001f600\U0001f600ab"]
FUZZY = {"custom_entities": {"PERSON": VALUES[:4], "LOCATION": VALUES[4:]}, "fuzzy_match": {"enabled": True, "thresholds": {"PERSON": 80, "DEFAULT": 70}}}


def _texts() -> list[str | None]:
    rng = random.Random(1)
    out: list[str | None] = [None, "", "   ", "　 \n", "pathetic", "Σας σας ΣΑΣ", "pathetik, PATHETI the  ant"]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 12)):
            w = list(rng.choice([*VALUES, "the", "and", "a", "b", "of", "", "MÜLER", "Ånn"]))
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(["", "e", "T", "ü", " ", "."])
            words.append("".join(w))
        out.append(rng.choice([" ", "  ", "\t", " "]).join(words))
    return out


def test_batches_find_what_the_expression_finds(spark):
    options, profile = Options(), ProfileSet({"t": FUZZY}).resolve("t")
    known = fuzzy_literal(profile, options)
    docs = spark.createDataFrame(list(enumerate(_texts())), "id long, text string").withColumn("v", F.expr(known))
    found = docs.withColumn("near", near_column("text", "v", options)).select(
        "id", F.expr(f"coalesce({folded_fuzzy('text', 'v', fuzzy_bounds(profile, options), options)}, array())").alias("old"),
        F.expr(near_candidates("text", "near", "v")).alias("new"),
    )
    rows = found.collect()
    assert sum(len(r["old"]) for r in rows) > 100
    for r in rows:
        assert sorted(map(repr, r["old"])) == sorted(map(repr, r["new"])), r["id"]


def test_rows_of_a_batch_may_have_values_of_their_own(spark):
    rows = [(0, "jon smith", ["john"], [80.0]), (1, "jon smith", [], []), (2, "jon smith", ["smyth", "john"], [75.0, 90.0]), (3, None, ["john"], [80.0])]
    docs = spark.createDataFrame(rows, "id long, text string, lowered array<string>, threshold array<double>").coalesce(1)
    values = docs.withColumn("v", F.expr("zip_with(lowered, threshold, (l, t) -> named_struct('lowered', l, 'threshold', t))"))
    got = {r["id"]: [(h["v"], h["i"], h["n"], h["phrase"]) for h in r["near"]] for r in values.select("id", near_column("text", "v").alias("near")).collect()}
    assert got == {0: [(0, 0, 1, "jon")], 1: [], 2: [(0, 1, 1, "smith")], 3: []}


def test_few_windows_are_scored():
    import numpy as np
    import pyarrow as pa

    near = NearValues(("pathetik",), (85.0,), 5, 2)
    words = [f"word{i}" for i in range(5000)] + ["pathetic"]
    assert [h[:5] for h in near.hits(pa.array(words), np.array([len(words)]))] == [(0, 0, 5000, 1, "pathetic")]
    assert len(near.seen[0]) == 1


def test_hits_of_a_small_dictionary_join_no_windows(spark):
    from cloakframe.operators.fuzzy import fuzzy_hits

    docs = spark.createDataFrame([(1, "a pathetik man"), (1, "Pathetic"), (2, "pathetic")], "id long, text string")
    hits = fuzzy_hits(docs, ["id"], "text", ProfileSet({"t": FUZZY}).resolve("t"))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "stack(" not in plan
    assert sorted((r["id"], r["phrase"], r["score"]) for r in hits.collect()) == [(1, "Pathetic", 100.0), (2, "pathetic", 100.0)]


def test_texts_are_split_where_they_are_matched(spark):
    """At the white space of functions.text, read once for both kinds of hits, and sent whole."""
    from cloakframe.functions.text import words
    from cloakframe.operators.fuzzy import fuzzy_hits

    every = "".join(f"jon{chr(c)}x{chr(c)}{chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000)
    docs = spark.createDataFrame([(1, every), (2, None), (3, " \n"), (4, "\u3000jon\x1fsmith ")], "id long, text string")
    split = docs.select("id", F.expr(f"filter({words('text')}, w -> w = 'jon' OR w = 'smith')").alias("w")).collect()
    values = "array(named_struct('lowered', 'jon', 'threshold', 100.0D), named_struct('lowered', 'smith', 'threshold', 100.0D))"
    known = docs.withColumn("v", F.expr(values)).select("id", near_column("text", "v", Options(max_phrase_words=1)).alias("near")).collect()
    assert {r["id"]: sorted({w for w in r["w"] or []}) for r in split} == {r["id"]: sorted(h["phrase"] for h in r["near"]) for r in known}

    plan = fuzzy_hits(docs, ["id"], "text", ProfileSet({"t": FUZZY}).resolve("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("ArrowEvalPython") == 1 and "Union" not in plan


def test_few_candidates_leave_texts_where_they_lie(spark):
    from cloakframe.operators.fuzzy import fuzzy_hits, with_fuzzy_candidates

    rows = [(1, "a pathetik man"), (1, "no more"), (2, "nothing"), (None, "pathetik"), (3, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = with_fuzzy_candidates(docs, ["id"], fuzzy_hits(docs, ["id"], "text", ProfileSet({"t": FUZZY}).resolve("t")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    got = [(r["id"], r["text"], [c["value"] for c in r["candidates"] or []]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted([(1, "a pathetik man", ["pathetik"]), (1, "no more", ["pathetik"]), (2, "nothing", []), (None, "pathetik", []), (3, None, [])], key=repr)
