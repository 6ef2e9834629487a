import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cloakframe.llm.queries import QUERIES
from cloakframe.llm import line_dedup, source_mix

WORD = re.compile(r"[^ \t-\r]+")


def targets_by_rounds(sizes):
    """Shares by weight, capped at three times the size, the excess shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: 1 + i % 3 for i, s in enumerate(names)}
    out, free, left = {}, list(names), float(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total >= 3 * sizes[s]]
        if not over:
            out |= {s: left * weights[s] / total for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def check_mix(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    want, taken = targets_by_rounds(sizes), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1


def test_mix_odd_rows(odd_docs):
    columns = [F.col("doc.source").alias("source"), "size", "source_size", "target", "taken"]
    mixed = source_mix.mix_documents(odd_docs)
    rows = mixed.select(F.col("doc.doc_id"), F.col("doc.text"), *columns).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["size"] == len(WORD.findall(r["text"] or "")) for r in rows)
    check_mix(rows)
    again = source_mix.mix_documents(odd_docs.repartition(5)).select("doc.doc_id", "taken").collect()
    assert sorted(map(str, ((r[0], r[1]) for r in again))) == sorted(map(str, ((r["doc_id"], r["taken"]) for r in rows)))


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_uneven_sources(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([1, 3, 50, 400]), rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(300)]
    mixed = source_mix.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    check_mix(mixed.select(F.col("doc.source").alias("source"), "size", "source_size", "target", "taken").collect())


def test_mixed_rows_hold_what_is_taken(odd_docs):
    mixed = source_mix.mix_documents(odd_docs)
    want = mixed.groupBy(F.col("doc.doc_id").alias("doc_id")).agg(F.sum("taken").alias("n")).collect()
    out = source_mix.mixed_rows(mixed)
    assert out.columns == odd_docs.columns
    got = defaultdict(int)
    for r in out.select("doc_id", "text").collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert {r["doc_id"]: r["n"] for r in want if r["n"]} == {k: v for k, v in got.items() if v}


def test_mix_empty(no_docs):
    assert source_mix.mix_documents(no_docs).count() == 0
    assert source_mix.mixed_rows(source_mix.mix_documents(no_docs)).count() == 0


def brute_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    key = lambda x: x.strip(" \t\r")
    low = -(2**63)
    for id_, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            sites[key(line)].add(site)
            first[key(line)] = min(low if id_ is None else id_, first.get(key(line), 2**63))
    out = []
    for id_, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        gone = [bool(key(x)) and len(sites[key(x)]) >= min_sites and (low if id_ is None else id_) > first[key(x)] for x in lines]
        kept = None if text is None else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((id_, len(lines), sum(gone), kept))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(60)] + ["", "  ", "\t"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(6))), f"s{rng.randrange(14)}") for i in range(200)]
    rows += [(None, "line 1\nline 2", "s1"), (500, None, "s1"), (501, "", None), (502, "line 3\n" * 3000, None), (503, "line 4", "s0"), (503, "line 4", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (3, 10, 12):
        done = line_dedup.dedup_lines(docs.withColumn("line", F.lit(1)).withColumn("first", F.lit(2)), min_sites=least)
        got = [tuple(r) for r in done.select("doc.doc_id", "n_lines", "n_removed", "kept_text").collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows, least)))


def test_lines_hot_and_empty(spark, no_docs):
    rows = [(i, f"only {i}\nsame for all", f"s{i % 20}") for i in range(2000)]
    done = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert [r[0] for r in done.where("n_removed = 0").select("doc.doc_id").collect()] == [0]
    assert done.where("n_removed = 1").count() == 1999
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_digest_is_of_whole_text(odd_docs):
    rows = line_dedup.dedup_lines(odd_docs, min_sites=50).select("doc.text", F.sha2("kept_text", 256).alias("h")).collect()
    assert all(r["h"] == (None if r["text"] is None else hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows)


def test_null_texts_are_in_the_query(spark, tmp_path):
    rows = [(1, "a\nb", "s"), (2, None, "s"), (3, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["kept_sha256"] is None) for r in got) == [(1, 2, False), (2, 0, True), (3, 1, False)]
