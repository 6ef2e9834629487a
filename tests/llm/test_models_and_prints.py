import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import imatch, language_id, quality

WORDS = {"en": "the of and that with from this which their would", "de": "und der nicht über für schön größer weiß möchte auch", "fr": "été où garçon voilà être même très déjà après cœur"}


def documents(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 40))), lang))
    return rows


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def test_languages_are_found(spark):
    rows = documents(random.Random(1), 400)
    wrong = [(i, t, "xx" if held(i, 4, 2) else lang) for i, t, lang in rows]  # held-out labels must not matter
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_documents(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i]["held_out"] == held(i, 4, 2) for i, _, _ in rows)
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if held(i, 4, 2)]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    other = spark.createDataFrame(wrong, "doc_id long, text string, lang string")
    again = {r["doc_id"]: r for r in language_id.identify(docs, language_id.fit_documents(other)).collect()}
    assert again == got
    assert (model.weights == 0).mean() > 0.5  # the penalty keeps the weights sparse


def test_languages_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit_documents(odd_docs)
    rows = language_id.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[107][0] == "en"
    nothing = language_id.fit_documents(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0
    digits = spark.createDataFrame([(1, "12 34 !?"), (2, "漢字")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.identify(digits, model).orderBy("doc_id").collect()] == ["und", "en"]


def test_gram_counts_cover_whole_texts():
    at, n = language_id.gram_counts("ab " * 50_000)
    assert n.sum() == 150_001 + 150_000 + 149_999 and len(at) < 20
    assert language_id.gram_counts("A,b") is not None
    assert [x.tolist() for x in language_id.gram_counts("A,,  B")] == [x.tolist() for x in language_id.gram_counts("a b")]


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    truth = rng.normal(size=(4000, 3))
    langs = np.array([rng.choice(3, p=np.exp(s) / np.exp(s).sum()) for s in truth])
    assert language_id.temperature(truth * 5, langs) == pytest.approx(5, rel=0.15)


def test_quality_is_learned(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(500):
        good = rng.random() < 0.8
        words = [rng.choice(["lorem", "ipsum", "dolor", "amet", "elit"]) for _ in range(rng.randrange(1, 60))]
        rows.append((i, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)))
        marks.append((i, int(good) if not held(i, 5, 0) else rng.randrange(2)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    assert np.mean([got[i]["predicted"] == ("!" not in t) for i, t in rows if held(i, 5, 0)]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"], 5, 0) for r in got.values())
    bad = np.mean([m == 0 for i, m in marks if not held(i, 5, 0)])  # the default threshold is the scores' quantile there
    assert np.mean([r["predicted"] == 0 for r in got.values()]) == pytest.approx(bad, abs=0.02)
    third = quality.score_documents(docs, labels, quantile=1 / 3)
    assert third.where("predicted = 0").count() == pytest.approx(500 / 3, abs=60)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(100, 1, 0), (101, 0, 0), (None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, raw int")
    rows = quality.score_documents(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    same = {r["score"] for r in rows if r["doc_id"] in (100, 101)}
    assert len(same) == 1 and same.pop() is not None
    assert {r["score"] for r in quality.score_documents(odd_docs, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.score_documents(no_docs, labels).count() == 0


def edited(rows):
    """(id, text, edited text), rows in id order."""
    out = []
    for at, (id_, text) in enumerate(rows):
        after, k = rows[(at + 1) % len(rows)][1], len(text) // 4
        out.append((id_, text, text[: len(text) - k] + after[:k]))
    return out


@pytest.mark.parametrize("range_rows", [2_000, 3])
def test_prints_and_edits(spark, monkeypatch, sentences, range_rows):
    monkeypatch.setattr(imatch, "RANGE_ROWS", range_rows)
    rng = random.Random(6)
    rows = [(i * 7 - 50, sentences(rng, rng.choice([1, 3, 30, 200]), vocabulary=3000)) for i in range(60)]
    rows += [(1000, ""), (1001, "\U0001f600é漢 " * 9), (1002, rows[3][1]), (1003, "!!! ???")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as fp", "3 as range").repartition(5)
    got = {r["doc_id"]: r for r in imatch.fingerprint_pairs(docs).select("*", imatch.as_string(F.col("fp")).alias("f"), imatch.as_string(F.col("edited_fp")).alias("e")).collect()}
    for id_, text, new in edited(rows):
        assert (got[id_]["text"], got[id_]["edited"]) == (text, new)
        assert 0 <= got[id_]["near_edited"] <= 1 and 0 <= got[id_]["near_next"] <= 1
        assert text != new or (got[id_]["f"] == got[id_]["e"] and got[id_]["near_edited"] == 1)
    assert got[1002]["f"] == got[-29]["f"]  # equal texts
    long = [r for r in got.values() if len(r["text"]) > 500]
    assert np.mean([r["near_edited"] for r in long]) > 0.3 > 0.1 > np.mean([r["near_next"] for r in long])


def test_prints_odd_rows(odd_docs, no_docs, spark):
    rows = imatch.fingerprint_pairs(odd_docs).select("doc_id", F.sha2("edited", 256).alias("h"), "near_next", "near_edited").collect()
    assert len(rows) == odd_docs.count()
    assert all(r["near_next"] is not None and r["near_edited"] is not None for r in rows)
    assert imatch.fingerprint_pairs(no_docs).count() == 0
    one = imatch.fingerprint_pairs(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()[0]
    assert one["edited"] == "abcdefab"
    assert hashlib.sha256(b"").hexdigest() in {r["h"] for r in rows}
