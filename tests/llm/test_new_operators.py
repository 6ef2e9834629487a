import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.llm import embedding_dedup, fill_middle, lexical_search
from cloakframe.llm.queries import QUERIES

# -- op11 ------------------------------------------------------------------------------------


def brute_ranks(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document; docs and items are (id, text) rows."""
    own = [(i, lexical_search.terms(t)) for i, t in docs]
    own = [(i, w) for i, w in own if w]
    n_docs, n_terms = len(own), sum(len(w) for _, w in own)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        asked = lexical_search.terms(text)
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in own) + 1))) for t in set(asked) if any(t in w for _, w in own)}
        for doc, w in own:
            m = 25 + (75 * len(w) * n_docs) // n_terms
            score = sum(weights.get(t, 0) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in asked if t in w)
            if score > 0:
                scored.append((-score, -math.inf if doc is None else doc, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return out


@pytest.mark.parametrize(("k", "shard_docs"), [(10, 10_000), (3, 40)])
def test_lexical_search_against_brute_force(spark, odd_docs, sentences, k, shard_docs):
    rng = random.Random(8)
    more = [(1000 + i, sentences(rng, rng.randrange(1, 60), vocabulary=120)) for i in range(300)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    items = [(i, sentences(rng, 12, vocabulary=150)) for i in range(25)]
    items += [(30, None), (31, ""), (32, "W1 w1 w1, w2"), (33, "nothing known"), (34, "w7 w8"), (34, "w9"), (34, "w7 w8"), (None, "w3 漢字 Ünïcödé")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("x"))
    found = lexical_search.rank_documents(docs, asked, k, shard_docs=shard_docs)
    got = sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str)
    want = brute_ranks([tuple(r) for r in docs.collect()], [x for x in items if x[1]], k)
    assert got == sorted(want, key=str)


def test_lexical_search_in_groups_of_items(spark, odd_docs, monkeypatch):
    items = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(12)], "item_id long, text string")
    one = sorted(map(tuple, lexical_search.rank_documents(odd_docs, items).collect()), key=str)
    monkeypatch.setattr(lexical_search, "GROUP_BYTES", 50)
    assert sorted(map(tuple, lexical_search.rank_documents(odd_docs, items).collect()), key=str) == one


def test_lexical_search_of_nothing(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert lexical_search.rank_documents(no_docs, items).count() == 0
    assert lexical_search.rank_documents(odd_docs, items.limit(0)).count() == 0
    assert lexical_search.rank_documents(odd_docs.where("text is null"), items).count() == 0


@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.data())
@settings(max_examples=100, deadline=None)
def test_range_maxima(values, data):
    numbers = np.array(values)
    maxima = lexical_search.RangeMaxima(numbers, len(numbers))
    left = data.draw(st.integers(0, len(values) - 1))
    right = data.draw(st.integers(left + 1, len(values)))
    at = int(maxima.at(np.array([left]), np.array([right]))[0])
    assert left <= at < right and numbers[at] == numbers[left:right].max()


# -- op12 ------------------------------------------------------------------------------------


def brute_units(text):
    out = []
    for c in text:
        letter = c.isascii() and c.isalpha()
        if letter and out and out[-1][-1].isascii() and out[-1][-1].isalpha():
            out[-1] += c
        else:
            out.append(c)
    return out


@given(st.text(alphabet=st.sampled_from("abZ [`{@é漢\n\U0001f600"), max_size=300))
@settings(max_examples=150, deadline=None)
def test_skip_list_reaches_every_rank(text):
    units = brute_units(text)
    widths = fill_middle.unit_widths(text)
    assert widths.tolist() == [len(u) for u in units]
    lanes = fill_middle.SkipList(widths)
    assert [lanes.code_points(r) for r in range(len(units) + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]
    for units_, points, _ in lanes.lanes:
        assert sum(units_) == len(units) and sum(points) == len(text)


def test_long_texts_have_express_lanes():
    lanes = fill_middle.SkipList(np.ones(100_000, np.int64)).lanes
    assert [len(x[0]) for x in lanes[:3]] == pytest.approx([100_000, 25_000, 6_250], rel=0.1)
    assert len(lanes) >= 6


def test_fill_in_middle_round_trip(odd_docs, spark, no_docs):
    marked = spark.createDataFrame([(200, "has <M> inside"), (201, "<S"), (202, "a<"), (203, "<P<S<M")], "doc_id long, text string")
    many = spark.createDataFrame([(300 + i, f"text {i}, of wörds\n<{i}>") for i in range(300)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(marked).unionByName(many)
    done = fill_middle.fill_in_middle(docs, keep=["doc_id", "text"])
    rows = done.select("doc.*", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(rows) == docs.count()
    forms = {}
    for r in rows:
        text = r["text"] or ""
        assert r["back"] == text and r["n"] == len(brute_units(text))
        forms[r["form"]] = forms.get(r["form"], 0) + 1
        if r["form"] == "plain":
            assert r["output"] == text and r["prefix_chars"] is None and r["middle_chars"] is None
        else:
            h = fill_middle.draws(r["doc_id"])
            a, b = sorted(x % (r["n"] + 1) for x in h[:2])
            units = brute_units(text)
            assert r["prefix_chars"] == len("".join(units[:a])) and r["middle_chars"] == len("".join(units[a:b]))
            assert r["output"].startswith("<S>" if r["form"] == "spm" else "<P>")
    assert forms["psm"] > forms["spm"] > 20 and forms["plain"] > 10
    assert {r["form"] for r in rows if r["doc_id"] in (100, 101, 200)} == {"plain"}
    assert fill_middle.fill_in_middle(no_docs).count() == 0


def test_other_sentinels(spark):
    plan = fill_middle.Plan(prefix="[PRE]", suffix="[SUF.]", middle="[MID]", plain_percent=0, spm_percent=50, seed="9")
    docs = spark.createDataFrame([(i, f"some text {i} <P> <S>") for i in range(60)], "doc_id long, text string")
    done = fill_middle.fill_in_middle(docs, keep=["text"], plan=plan).select("*", fill_middle.restored(F.col("output"), F.col("form"), plan).alias("back"))
    rows = done.collect()
    assert {r["form"] for r in rows} == {"psm", "spm"} and all(r["back"] == r["doc"]["text"] for r in rows)


# -- op13 ------------------------------------------------------------------------------------


def brute_links(rows, least=0.95):
    """{row: (n_links, component)} of rows (id, vector) by all pairs in double precision."""
    known = {}
    for r, (id_, v) in enumerate(rows):
        if id_ is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            known[r] = np.array(v, dtype=np.float64)
    links = {r: set() for r in range(len(rows))}
    for a in known:
        for b in known:
            if a < b and len(known[a]) == len(known[b]) and known[a] @ known[b] / (np.linalg.norm(known[a]) * np.linalg.norm(known[b])) >= least:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for r, (id_, _) in enumerate(rows):
        seen, todo = {r}, [r]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[r] = (len(links[r]), min(rows[x][0] for x in seen) if r in known else id_)
    return out


@pytest.mark.parametrize(("kind", "tile", "pivot_rows"), [("float", 4096, 4096), ("float", 40, 20), ("double", 25, 30)])
def test_embedding_links_against_brute_force(spark, monkeypatch, kind, tile, pivot_rows):
    monkeypatch.setattr(embedding_dedup, "PIVOT_ROWS", pivot_rows)
    monkeypatch.setattr(embedding_dedup, "VISITORS", 16)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(150, 16))
    rows = [(i, x) for i, x in enumerate(base)]
    rows += [(200 + i, base[i % 40] + rng.normal(size=16) * 0.3) for i in range(200)]  # about the threshold
    rows += [(500 + i, base[3]) for i in range(20)] + [(600 + i, 2.5 * base[4]) for i in range(5)]
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in rows]
    rows += [(700, None), (701, []), (702, [0.0] * 16), (703, [None] * 16), (704, [math.nan] + [1.0] * 15), (705, [math.inf] + [1.0] * 15)]
    rows += [(706, [1.0, 2.0]), (707, [2.0, 4.0]), (708, [1.0, 2.0, 0.0]), (None, rows[0][1]), (5, rows[0][1]), (5, rows[5][1])]
    rows += [(709, [1e-30, 2e-30]), (710, [1e30, 2e30])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    for clash in ("cls", "v", "n", "cell", "links", "place"):
        df = df.withColumn(clash, F.lit("x"))
    got = sorted(map(tuple, embedding_dedup.dedup_embeddings(df, tile=tile).collect()), key=str)
    own = zip(rows, brute_links(rows).values(), strict=True)
    assert got == sorted(((i, n, c, i is None or i == c) for (i, _), (n, c) in own), key=str)


def test_quantised_bounds_hold():
    rng = np.random.default_rng(3)
    x = embedding_dedup.unit(rng.normal(size=(300, 64)) + rng.normal(size=64) * 2)
    tile, other = embedding_dedup.Tile(x), embedding_dedup.Quantised(x[:100])
    exact = x[:100] @ x.T
    near = other.products(tile) * other.step[:, None] * tile.step
    error = np.outer(other.near, tile.rest) + other.rest[:, None]
    assert (np.abs(near - exact) <= error + 1e-12).all()
    for least in (0.5, 0.8, 0.95):
        i, j, computed = tile.linked(other, least)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(exact >= least))))
        assert computed < exact.size / 4


def test_embeddings_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.dedup_embeddings(df).count() == 0
    with pytest.raises(ValueError):
        embedding_dedup.dedup_embeddings(df, least=0)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_fill_middle", "op13_embedding_dedup"])
def test_registered(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
