import random
import re

import numpy as np
import pytest

from cloakframe.llm import ngram_join, substring_dedup
from cloakframe.llm.components import components

WORD = re.compile(r"[^ \t-\r]+")


def brute_substrings(rows, window):
    first, out = {}, []
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for id_, text in known:
        w = WORD.findall(text or "")
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), id_)
    for id_, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for j in range(len(w) - window + 1) if id_ is not None else []:
            if first[tuple(w[j : j + window])] < id_:
                gone |= set(range(j, j + window))
        out.append((id_, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("hot", [1, 200_000])
def test_substrings_against_brute_force(spark, monkeypatch, sentences, hot):
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", hot)
    rng = random.Random(hot)
    passages = [sentences(rng, n) for n in (49, 50, 51, 80, 200)]
    rows = [(i, " ".join([sentences(rng, rng.randrange(80)), rng.choice(passages), sentences(rng, rng.randrange(40))])) for i in range(120)]
    rows += [(i, rows[i - 200][1]) for i in range(200, 210)]
    rows += [(300, None), (301, ""), (302, "a b c"), (None, rows[3][1]), (303, "x " * 3000), (304, "x " * 70), (305, rows[1][1]), (305, rows[1][1])]
    rows += [(306, rows[2][1].replace(" ", "\n\t")), (307, sentences(rng, 70) + " a\x1cb " + passages[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as packed", "2 as bucket", "3 as k1")
    ranges = substring_dedup.removed_ranges  # the limit is an argument's default
    monkeypatch.setattr(substring_dedup, "removed_ranges", lambda rows_, window: ranges(rows_, window, bucket_windows=hot))
    got = [tuple(r) for r in substring_dedup.dedup_substrings(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_substrings(rows, 50)))


def test_substrings_empty(no_docs, odd_docs):
    assert substring_dedup.dedup_substrings(no_docs).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in substring_dedup.dedup_substrings(odd_docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_substrings(rows, 50)))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 16])
def test_runs_and_minima(k):
    codes = np.random.default_rng(k).integers(0, 5, 200).astype(np.uint64)
    runs = substring_dedup.runs_of(codes, k)
    seen = {}
    for i in range(len(codes) - k + 1):
        assert seen.setdefault(tuple(codes[i : i + k]), runs[i]) == runs[i]
    assert len(set(seen.values())) == len(seen)
    assert len(runs) == len(codes) - k + 1
    least = substring_dedup.window_minimum(runs, 7)
    assert least.tolist() == [runs[i : i + 7].min() for i in range(len(runs) - 6)]


def brute_components(rows, n, percent):
    nodes = [(i, t) for i, t in rows if i is not None]
    sets = []
    for _, text in nodes:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = {i: i for i, _ in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(nodes[a][0]), root(nodes[b][0])))
                label[y] = x
    return sorted((i, len(s), root(i)) for (i, _), s in zip(nodes, sets, strict=True))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("block", [512, 3])
def test_near_against_brute_force(spark, monkeypatch, sentences, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SHARE", 4)
    rng = random.Random(n)
    rows = []
    for g in range(14):
        text = sentences(rng, rng.choice([4, 8, 15, 40, 90, 300]), vocabulary=300).split()
        for _ in range(rng.randrange(1, 9)):  # a chain of copies that drift apart
            rows.append((len(rows), " ".join(text)))
            for _ in range(max(1, len(text) // 90)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
        if g % 3 == 0:
            rows.append((len(rows), rows[-1][1].upper() + "\n"))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "É è"), (906, "é è"), (None, rows[0][1]), (907, rows[5][1]), (907, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "3 as key", "4 as component", "'x' as counts")
    got = ngram_join.join_near(docs, n=n, percent=percent)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.where("doc_id is not null").collect())
    assert found == brute_components(rows, n, percent)
    assert [r["component_id"] for r in got.where("doc_id is null").collect()] == [None]


def test_near_with_a_large_group(spark, sentences):
    rng = random.Random(2)
    base = sentences(rng, 150).split()
    rows = []
    for i in range(1200):
        own = list(base)
        own[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = ngram_join.join_near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_near_empty(no_docs, odd_docs):
    assert ngram_join.join_near(no_docs).count() == 0
    assert ngram_join.join_near(odd_docs).count() == odd_docs.count()


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (300, ngram_join.GROUPS)).astype(np.int64)
    points[150:] = np.maximum(0, points[:150] + (rng.random((150, ngram_join.GROUPS)) < 0.03))
    sizes = points.sum(axis=1)
    tree = ngram_join.CountTree(points, sizes)
    for i in range(0, 300, 7):
        bound = np.minimum(points, points[i]).sum(axis=1)
        want = np.flatnonzero(190 * bound >= 90 * (sizes + sizes[i]))
        assert sorted(tree.near(points[i], int(sizes[i])).tolist()) == want.tolist()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_ids_have_the_links_of_all_their_texts(spark, sentences):
    rng = random.Random(5)
    a, z = sentences(rng, 80), sentences(rng, 80, stem="v")
    rows = [(1, a), (2, z + " more"), (2, a + " 1"), (3, z), (4, sentences(rng, 50)), (None, a)]
    got = ngram_join.join_near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=str) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (None, None)]
    assert {r["n_shingles"] for r in got.where("doc_id is null or doc_id = 1").collect()} == {78}
