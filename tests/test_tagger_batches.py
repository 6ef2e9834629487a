"""Tagging texts together gives what tagging them one by one gives."""

from __future__ import annotations

import random
import zlib

import numpy as np

from cloakframe.operators import tagger


def test_texts_are_tagged_together_as_alone():
    rng = np.random.default_rng(1)
    allowed, first = tagger.order_of(tagger.tag_names(["A", "B"]))
    trans = rng.integers(-2, 3, (5, 5)).astype(float)  # whole numbers: many ties
    emits = [rng.integers(-3, 4, (n, 5)).astype(float) for n in (3, 0, 1, 50, 7, 7, 2, 0, 400)]
    together = tagger.viterbi_of_many(emits, trans, allowed, first)
    assert [t.tolist() for t in together] == [tagger.viterbi(e, trans, allowed, first).tolist() for e in emits]
    assert tagger.viterbi_of_many([], trans, allowed, first) == []


def test_features_are_those_of_each_word_in_its_place():
    rng = random.Random(1)
    words = [rng.choice(["Ann", "555", "@", "straße", "x" * 20, "ÄB", "a1b"]) for _ in range(60)]
    low, shapes = [w.lower() for w in words], [tagger.shape(w) for w in words]
    at = lambda xs, i: xs[i] if 0 <= i < len(xs) else "<>"
    rows = tagger.Features().rows(words)
    for i in (0, 1, 2, 30, 58, 59):
        assert rows[i][9] == zlib.crc32(f"2{at(low, i - 2)}|{at(low, i - 1)}".encode()) & (tagger.BUCKETS - 1)
        assert rows[i][6] == zlib.crc32(f"a{at(low, i + 1)}".encode()) & (tagger.BUCKETS - 1)
        assert rows[i][11] == zlib.crc32(f"4{shapes[i]}{at(shapes, i + 1)}{at(shapes, i + 2)}".encode()) & (tagger.BUCKETS - 1)
    assert tagger.Features().rows([]).shape == (0, 12)


def test_segments_of_a_kind(spark):
    texts = spark.sql("""SELECT * FROM VALUES ('call 555 1234 now', array(struct(5 AS start, 13 AS end, 'PHONE' AS entity_type))),
        (repeat('word ', 50), NULL), (NULL, NULL), ('', NULL) AS t(text, spans)""")
    every = [(r["labelled"], r["words"], r["tags"]) for r in tagger.segments(texts).collect()]
    assert (True, ["call", "555", "1234", "now"], ["O", "B-PHONE", "I-PHONE", "O"]) in every and [len(e[1]) for e in every] == [4, 40, 10]
    for mark in (True, False):
        assert [(r["labelled"], r["words"], r["tags"]) for r in tagger.segments(texts, mark=mark).collect()] == [e for e in every if e[0] == mark]
