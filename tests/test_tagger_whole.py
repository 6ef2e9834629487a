"""The tagger learns from all segments, with the weights that learning from one after the other gives."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from cloakframe.operators import tagger


def test_all_segments_are_learned_from(spark):
    rare = {7: "A", 1007: "B", 2007: "C", 5007: "D", 7007: "E"}
    rows = [(i, f"call {i} now", [(5, 5 + len(str(i)), rare.get(i, "PHONE"))]) for i in range(8000)]
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<start int, end int, entity_type string>>")
    assert tagger.fit(df, epochs=1).types == ["A", "B", "C", "D", "E", "PHONE"]
    packed = tagger.packed(tagger.segment_lines(df), 4).collect()
    assert sum(len(r["sizes"]) // 4 for r in packed) == 8000 and len(packed) == 4


def test_hashes_of_words_behind_each_other():
    rng = random.Random(3)
    words = [rng.choice(["Ann", "x" * 300, "é9" * 50, "@", "<>"]) for _ in range(40)]
    rows = tagger.Features().rows(words + words, [40, 40])
    assert (rows[:40] == rows[40:]).all()
    low, shapes = [w.lower() for w in words], [tagger.shape(w) for w in words]
    for i in range(2, 38):
        for k, text in ((7, f"B{shapes[i - 1]}{shapes[i]}"), (8, f"A{shapes[i]}{shapes[i + 1]}"), (9, f"2{low[i - 2]}|{low[i - 1]}"),
                        (10, "3" + "".join(shapes[i - 2 : i + 1])), (11, "4" + "".join(shapes[i : i + 3]))):
            assert rows[i][k] == zlib.crc32(text.encode()) & (tagger.BUCKETS - 1)


def test_segments_decoded_together_learn_as_one_by_one(spark):
    rng = random.Random(4)
    texts = []
    for i in range(300):
        text = " ".join(rng.choice(["call", "Ann", "555", "1234", "the", "Bob"]) for _ in range(rng.randrange(1, 60)))
        at = text.find("555 1234")
        texts.append((text, [(at, at + 8, "PHONE")] if at >= 0 and rng.random() < 0.9 else []))
    df = spark.createDataFrame(texts, "text string, spans array<struct<start int, end int, entity_type string>>")
    shard = tagger.packed(tagger.segment_lines(df).coalesce(1), 1).first().asDict()
    tags = tagger.tag_names(["PHONE"])
    weights, trans = np.zeros((tagger.BUCKETS, 3)), np.zeros((3, 3))
    at, by = tagger._pass(shard, tags, weights, trans)

    lines = sorted({(r["line"], r["tags"]) for r in tagger.segment_lines(df).collect()})
    assert lines
    allowed, first = tagger.order_of(tags)
    sizes = np.frombuffer(shard["sizes"], np.int32)
    gold = np.frombuffer(shard["gold"], np.int16)  # O, B-PHONE and I-PHONE in the order of tags, as B comes first
    assert shard["names"].split(" ") == tags
    rows = tagger.coded_rows(np.frombuffer(shard["numbers"], np.uint32), np.frombuffer(shard["codes"], np.int32), sizes.astype(np.int64))
    w, t = weights.copy(), trans.copy()
    sums = np.zeros(w.size + t.size)
    start = 0
    for step, n in enumerate(sizes.tolist()):
        own, want = rows[start : start + n], gold[start : start + n]
        start += n
        was = tagger.viterbi(w[own].sum(axis=1), t, allowed, first)
        before = np.concatenate([w.ravel(), t.ravel()])
        for i in range(n):
            if was[i] != want[i]:
                np.add.at(w[:, want[i]], own[i], 1.0)
                np.add.at(w[:, was[i]], own[i], -1.0)
            if i and (was[i - 1], was[i]) != (want[i - 1], want[i]):
                t[want[i - 1], want[i]] += 1
                t[was[i - 1], was[i]] -= 1
        sums += (np.concatenate([w.ravel(), t.ravel()]) - before) * step
    want = np.concatenate([w.ravel(), t.ravel()]) - sums / len(sizes)
    got = np.zeros_like(want)
    got[at] = by / tagger.FINE
    assert np.abs(got - want).max() < 1e-6 and np.abs(want).max() > 0


def test_texts_without_tags_are_not_searched():
    rng = np.random.default_rng(5)
    allowed, first = tagger.order_of(tagger.tag_names(["A", "B"]))
    for _ in range(50):
        sizes = rng.integers(0, 6, 8)
        emit = rng.normal(size=(sizes.sum(), 5)) + np.array([rng.choice([0, 2, 6]), 0, 0, 0, 0])
        trans = rng.normal(size=(5, 5))
        ends = np.cumsum(sizes)
        want = [p for n, e in zip(sizes, ends) for p in tagger.viterbi(emit[e - n : e], trans, allowed, first)]
        assert tagger.decoded(emit, sizes, trans, allowed, first).tolist() == want


def test_shards_of_odd_texts(spark):
    df = spark.createDataFrame([(None, None), ("", []), ("  ", None), ("one two", None)], "text string, spans array<struct<start int, end int, entity_type string>>")
    assert [(r["line"], r["tags"]) for r in tagger.segment_lines(df).collect()] == [("one two", "")]
    (row,) = tagger.packed(tagger.segment_lines(df), 4).collect()
    assert row["names"] == "O" and np.frombuffer(row["gold"], np.int16).tolist() == [0, 0]
    assert pa.array([row["sizes"]]).to_pylist() == [np.array([2], np.int32).tobytes()]
