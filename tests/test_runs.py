"""Tables written by runs: repeated, lost and replaced ones."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.restore import restore_column
from cloakframe.options import Options
from cloakframe.plans.columns import redact_column
from cloakframe.sources import runs
from cloakframe.sources.sinks import write_redacted_column
from cloakframe.streaming import streams

SALTED = Options(salt="test")


def ids(spark, path, **how):
    return sorted(r["id"] for r in runs.read_runs(spark, path, **how).collect())


def numbers(spark, *which):
    return spark.createDataFrame([(i,) for i in which], "id long")


def test_a_repeated_run_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert runs.write_run(numbers(spark, 1, 2), path, "001")
    assert not runs.write_run(numbers(spark, 8, 9), path, "001")
    assert runs.write_run(numbers(spark, 2, 3), path, "1")
    assert ids(spark, path) == [1, 2, 2, 3]


def test_a_lost_run_shows_nothing_until_it_is_done_again(spark, tmp_path):
    path = str(tmp_path / "t")
    runs.write_run(numbers(spark, 1), path, "a")
    runs.write_rows(numbers(spark, 5, 6, 7), path, "b")
    assert ids(spark, path) == [1]
    runs.write_run(numbers(spark, 6), path, "b")
    assert ids(spark, path) == [1, 6]


def test_compaction_keeps_rows_and_earlier_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    for i, run in enumerate(("a", "b", "c")):
        runs.write_run(numbers(spark, i, i), path, run)
    before = runs.run_log(spark, path).agg(F.max("committed_at")).first()[0]
    runs.write_rows(numbers(spark, 99), path, "lost")
    assert runs.compact(spark, path, "all", partitions=1) and not runs.compact(spark, path, "all")
    assert ids(spark, path) == [0, 0, 1, 1, 2, 2]
    assert [r["run"] for r in runs.live_runs(spark, path).collect()] == ["all"]
    runs.write_run(numbers(spark, 3), path, "d")
    assert ids(spark, path) == [0, 0, 1, 1, 2, 2, 3] and ids(spark, path, as_of=before) == [0, 0, 1, 1, 2, 2]
    assert len(runs.live_runs(spark, path, as_of=before).collect()) == 3
    assert not runs.write_run(numbers(spark, 7), path, "a")


def test_empty_runs_odd_names_and_missing_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not runs.compact(spark, path, "x") and runs.run_log(spark, path).count() == 0
    runs.write_run(numbers(spark).where("false"), path, "none")
    assert ids(spark, path) == []
    for name in ("", "a/b", "a=b", "x" * 200):
        with pytest.raises(ValueError):
            runs.write_run(numbers(spark, 1), path, name)


def test_batch_and_stream_share_a_store(spark, tmp_path):
    texts, maps, feed = (str(tmp_path / n) for n in ("texts", "maps", "feed"))
    df = spark.createDataFrame([(1, "mail a@b.co"), (2, "host 10.0.0.1"), (3, "plain"), (4, None)], "id long, text string")
    for _ in range(2):
        done = redact_column(df.where("id = 1"), "text", ["id"], options=SALTED)
        write_redacted_column(done, "text", texts, maps, SALTED, run="job")
    df.where("id > 1").write.parquet(feed)
    for checkpoint in ("c1", "c1"):
        stream = spark.readStream.schema(df.schema).parquet(feed)
        streams.redact_stream(stream, "text", ["id"], texts, maps, str(tmp_path / checkpoint), SALTED, runs=True).awaitTermination()
    written = runs.read_runs(spark, texts)
    assert set(written.columns) == {"id", "mapping_id", "redacted"} and written.count() == 4
    back = restore_column(written, "redacted", runs.read_runs(spark, maps), ["id"], options=SALTED)
    assert [r["restored"] for r in back.orderBy("id").collect()] == ["mail a@b.co", "host 10.0.0.1", "plain", None]


def test_texts_of_a_lost_job_wait_for_its_mappings(spark, tmp_path):
    """The job was lost between both products: the mappings stay as they are, the texts come with the next try."""
    texts, maps = str(tmp_path / "texts"), str(tmp_path / "maps")
    df = spark.createDataFrame([(1, "mail a@b.co and c@d.org")], "id long, text string")
    done = redact_column(df, "text", ["id"], options=SALTED)
    write_redacted_column(done, "text", str(tmp_path / "other"), maps, SALTED, run="job")
    write_redacted_column(done, "text", texts, maps, SALTED, run="job")
    assert runs.read_runs(spark, texts).count() == 1 and runs.read_runs(spark, maps).count() == 2
