"""Queries take all words of each text and of the benchmark, on a small fixture."""

from cloakframe.queries import text_queries


def docs(spark):
    rows = [(1, "alpha b gamma  delta"), (2, "zeta"), (3, ""), (4, None), (5, "one last gamma delta, Epsilon")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def benchmark(spark):
    return spark.createDataFrame([(1, "one two three gamma delta, epsilon Epsilon")], "item_id long, text string")


def test_every_word_of_every_document_is_replaced(spark):
    got = {(r["doc_id"], r["value"]): r for r in text_queries.replaced_words(docs(spark)).collect()}
    assert set(got) == {
        (1, "alpha"), (1, "b"), (1, "gamma"), (1, "delta"), (2, "zeta"),
        (5, "one"), (5, "last"), (5, "gamma"), (5, "delta,"), (5, "Epsilon"),
    }
    assert got[1, "b"]["n"] == 1 and got[1, "alpha"]["replaced"].startswith("<WORD_")
    assert got[1, "gamma"]["replaced"].split(" ")[0] == "alpha" and got[1, "gamma"]["replaced"].endswith("  delta")
    inside = spark.createDataFrame([(1, "an ant and Jan. an")], "doc_id long, text string")
    (an,) = [r for r in text_queries.replaced_words(inside).collect() if r["value"] == "an"]
    token = an["replaced"][:15]
    assert an["n"] == 5 and an["replaced"] == "an ant and Jan. an".replace("an", token)


def test_ratios_of_all_neighbours(spark):
    got = {(r["doc_id"], r["a"], r["b"]): r["ratio"] for r in text_queries.word_ratios(docs(spark)).collect()}
    assert set(got) == {
        (1, "alpha", "delta"), (1, "alpha", "b"), (1, "b", "gamma"), (1, "gamma", "delta"), (2, "zeta", "zeta"),
        (5, "one", "epsilon"), (5, "one", "last"), (5, "last", "gamma"), (5, "gamma", "delta,"), (5, "delta,", "epsilon"),
    }
    assert got[2, "zeta", "zeta"] == 100 and got[1, "gamma", "delta"] == 20


def test_all_words_of_the_benchmark_are_looked_for(spark):
    found = text_queries.benchmark_places(docs(spark), benchmark(spark)).select("doc_id", "start", "value").collect()
    assert sorted(map(tuple, found)) == [(5, 9, "gamma delta"), (5, 22, "Epsilon")]
    hits = text_queries.benchmark_hits(docs(spark), benchmark(spark)).select("doc_id", "value").collect()
    assert sorted(map(tuple, hits)) == [(1, "gamma"), (5, "Epsilon"), (5, "delta,"), (5, "gamma")]


def test_ratios_by_batches_are_those_of_the_expression(spark):
    from pyspark.sql import functions as F

    from cloakframe.functions.similarity import indel_ratio, indel_ratio_column

    odd = ["", "a", "ab\0", "\0ba", "straße", "😀é😀", "abc" * 20 + "de", "abc" * 21, "cab" * 30, "x" * 100, None]
    pairs = spark.createDataFrame([(a, b) for a in odd for b in odd], "a string, b string")
    rows = pairs.select("a", "b", F.expr(indel_ratio("a", "b")).alias("r"), indel_ratio_column("a", "b").alias("s")).collect()
    assert len(rows) == 121 and all(r["r"] == r["s"] for r in rows)


def test_ratios_of_texts_need_no_shuffle_and_keep_rows_of_equal_ids(spark):
    twice = spark.createDataFrame([(1, "a b a b"), (1, "a b a b"), (None, "c")], "doc_id long, text string")
    done = text_queries.word_ratios(twice)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(str, map(tuple, done.collect())))
    assert got == ["(1, 'a', 'b', 0.0)"] * 2 + ["(1, 'b', 'a', 0.0)"] * 2 + ["(None, 'c', 'c', 100.0)"]


def test_replacing_each_value_is_what_the_row_expressions_do(spark):
    from pyspark.sql import functions as F

    from cloakframe.functions.sqltext import struct, transform
    from cloakframe.functions.text import occurrences
    from cloakframe.operators.redact import rebuild

    texts = ["aa aaa a aaaa", "é éa 😀é aé", "an ant and Jan. an", "one  two one", "", None, "ab " * 300 + "b a"]
    rows = [(i % 5, t) for i, t in enumerate(texts)] + [(None, "null id")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    words = odd.select("doc_id", "text", F.explode(F.expr("array_distinct(filter(split(text, ' '), w -> w <> ''))")).alias("value"))
    places = transform(occurrences("text", "value"), lambda s: struct(start=s, end=f"{s} + length(value)"))
    known = text_queries.replaced_words(odd)
    tokens = known.select("value", F.regexp_extract("replaced", "<WORD_[0-9a-f]{8}>", 0).alias("token")).distinct()
    plain = words.join(tokens, "value").withColumn("s", F.expr(places)).select(
        "doc_id", "value", F.size("s").alias("n"), F.expr(rebuild("text", "s", "array_repeat(token, size(s))")).alias("replaced")
    )
    want = sorted(map(str, map(tuple, plain.collect())))
    assert len(want) == 19 and sorted(map(str, map(tuple, known.collect()))) == want
    digests = text_queries.replaced_words(odd, digest=True).collect()
    hashed = plain.withColumn("replaced", F.md5("replaced")).collect()
    assert sorted(map(str, map(tuple, digests))) == sorted(map(str, map(tuple, hashed)))
    assert "BatchEvalPython" not in known._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in known._jdf.queryExecution().executedPlan().toString()
