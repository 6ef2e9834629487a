import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloakframe.llm import packing, topk_search
from cloakframe.llm.queries import QUERIES


def brute_top(rows, k):
    usable = {}
    for id_, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[id_] = [math.floor(1024 * x) for x in v]
    out = {}
    for q, own in usable.items():
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in usable.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("k", [1, 10])
def test_top_k_against_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(40)]) for i in range(900)]
    rows += [(i, rows[5][1]) for i in range(900, 960)]  # ties
    rows += [(1000, None), (1001, [None] * 40), (1002, [float("nan")] * 40), (1003, [float("inf")] + [0.0] * 39), (1100, []), (1101, [3.0])]
    vectors = topk_search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)))
    found = topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), k).collect()
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_top(floats, k)


def test_top_k_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "GROUP_ROWS", 50)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 2)
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(400)]
    vectors = topk_search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_top(rows, 10)
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_of_large_numbers_repeated_ids_and_small_batches(spark, monkeypatch):
    rng = random.Random(3)
    for name, value in (("GROUP_ROWS", 40), ("SAMPLE", 3), ("CHUNK", 16), ("BLOCK", 2), ("QUERY_BATCH", 2)):
        monkeypatch.setattr(topk_search, name, value)
    for scale in (1.0, 1e5):  # sums within doubles, and beyond them
        rows = [(i, [rng.gauss(0, scale) * 0.5**d for d in range(9)]) for i in range(500)]
        vectors = topk_search.scaled(spark.createDataFrame([*rows, (None, rows[0][1])], "vec_id long, embedding array<double>"))
        found = topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), 4).collect()
        got = {}
        for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got == brute_top(rows, 4)
    twice = spark.createDataFrame([(0, [1]), (0, [2]), (1, [5]), (1, [7]), (2, [6])], "vec_id long, v array<long>")
    found = topk_search.top_k(twice, twice.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 7), (0, 2, 6)]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def ranked():
    return packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))


@given(st.text(alphabet=st.sampled_from("ab' .\n\t\xa0é漢1\x1c\x85sS<|>\U0001f600"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_by_rank_equal_ids_by_merging(tokenizer, ranked, text):
    assert isinstance(ranked, packing._Ranked)
    assert ranked.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    special = text + "<|endoftext|>" + text
    assert ranked.ids(special).tolist() == tokenizer.encode(special, add_special_tokens=False).ids


def test_other_vocabularies_are_encoded_by_their_own_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    text = "A few Words, and <|endoftext|>."
    assert isinstance(packing.encoder(path), packing._Whole)
    assert packing.encoder(path).ids(text).tolist() == own.encode(text, add_special_tokens=False).ids


def check_packing(rows, tokenizer, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for id_, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[id_], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids)
        assert len(own) == 1 if len(ids) <= 2048 else all(r["length"] == 2048 for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_packing_round_trip(odd_docs, tokenizer):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    check_packing(packing.pack_documents(docs).collect(), tokenizer, texts)
    rows = packing.pack_documents(odd_docs).collect()  # repeated ids and a null id are packed too
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_packing_is_tight_and_repeats(spark, no_docs):
    assert packing.pack_documents(no_docs).count() == 0
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.randrange(1, 2049), i) for i in range(5000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces, packers=2).collect()
    assert len(packed) == 5000
    assert packed == packing.pack(pieces.repartition(7), packers=2).collect()
    used = len({r["sequence_id"] for r in packed})
    assert used <= 1.04 * sum(r[3] for r in rows) / 2048


def test_bounded_bins():
    bins = packing.OpenBins(10, most=2)
    assert [bins.place(n) for n in (6, 5, 7)] == [(0, 0), (1, 0), (2, 0)]  # 0, the fuller of two, closes
    assert bins.place(3) == (2, 7)
    assert bins.place(4) == (1, 5)


def plain_best_fit(lengths, size, most):
    """(bin, offset) of each piece by looking at every open bin."""
    free, out, opened = [], [], 0  # open bins: [free space, when it came to this space, number]
    for turn, n in enumerate(lengths):
        fits = [b for b in free if b[0] >= n]
        if fits:
            bin_ = min(fits, key=lambda b: (b[0], -b[1]))
            out.append((bin_[2], size - bin_[0]))
            free.remove(bin_)
            space, number = bin_[0] - n, bin_[2]
        else:
            if len(free) >= most:
                free.remove(min(free, key=lambda b: (b[0], -b[1])))
            out.append((opened, 0))
            space, number, opened = size - n, opened, opened + 1
        if space:
            free.append([space, turn, number])
    return out


@given(st.lists(st.integers(1, 40), max_size=200), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_bins_against_a_plain_best_fit(lengths, most):
    bins = packing.OpenBins(40, most)
    assert [bins.place(n) for n in lengths] == plain_best_fit(lengths, 40, most)


def test_packing_of_repeated_and_null_ids(spark, tokenizer):
    rows = [(1, "one text"), (1, "one text"), (1, "another one"), (None, "no id"), (None, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
    assert sorted(map(str, ((r["doc_id"], r["ids_crc32"]) for r in got))) == sorted(map(str, ((i, crc(t)) for i, t in rows)))
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(rows)


def test_registered_top_k(spark):
    rows = QUERIES["op1_topk_search"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 50


def test_texts_are_packed_in_small_batches(spark, monkeypatch):
    """A batch of long texts is bounded by bytes, not by 10,000 rows, and the session's own limit stays."""
    from cloakframe.llm import common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)

    def sizes(batches):
        for batch in batches:
            yield type(batch).from_pydict({"n_bytes": [batch.nbytes]})

    texts = spark.range(0, 600, 1, 1).select("id", F.repeat(F.lit("some words "), 5000).alias("text"))
    whole = [r["n_bytes"] for r in common.staged(texts.mapInArrow(sizes, "n_bytes long")).collect()]
    small = [r["n_bytes"] for r in common.staged(texts.mapInArrow(sizes, "n_bytes long"), small=True).collect()]
    assert max(whole) > 4 * common.BATCH_BYTES and max(small) < 2 * common.BATCH_BYTES
    assert spark.conf.get(name, None) == before

    seen = []
    monkeypatch.setattr(packing, "tokenized", lambda docs, *args, **how: docs.mapInArrow(sizes, "n_bytes long"))
    monkeypatch.setattr(packing, "pack", lambda pieces, *args: seen.extend(r["n_bytes"] for r in pieces.collect()))
    packing.pack_documents(texts, doc_id="id")
    assert seen and max(seen) < 2 * common.BATCH_BYTES
