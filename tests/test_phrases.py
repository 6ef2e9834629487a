"""Windows of words counted in the row of their text are those that phrase_rows gives."""

from pyspark.sql import functions as F

from cloakframe.operators import fuzzy


def test_summaries_are_those_of_all_windows(spark):
    texts = ["one two  three\tfour five six", "a b c", "ab", "", None, "É e ß 😀 zz", "x " * 30, "  lead and trail "]
    docs = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)] + [(None, "no id here")], "doc_id long, text string")
    rows = fuzzy.phrase_rows(docs, ["doc_id"], "text").withColumn("phrase", F.expr(fuzzy.written_phrase()))
    want = rows.groupBy("doc_id", "n").agg(
        F.count("*").alias("n_phrases"), F.sum(F.length("phrase")).alias("n_chars"),
        F.min("phrase").alias("first_phrase"), F.max("phrase").alias("last_phrase"),
    )
    got = fuzzy.phrase_summaries(docs, ["doc_id"], "text")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect()))) and want.count() == 15


def test_the_query_groups_a_few_rows_a_text(spark, tmp_path):
    from cloakframe.queries import QUERIES

    spark.createDataFrame([(1, "w " * 5000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["phrases"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "stack(" not in plan and "Expand" not in plan and "posexplode" not in plan
