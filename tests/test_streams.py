"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from cloakframe.options import Options
from cloakframe.plans.columns import redact_column
from cloakframe.streaming import streams

SALTED = Options(salt="test")


def test_redact_then_restore(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "mail a@b.co"), (2, "plain text"), (3, "host 10.0.0.1 again 10.0.0.1")]
    df = spark.createDataFrame(rows, "id long, text string")
    df.where("id < 3").write.parquet(source)
    stream = lambda: spark.readStream.schema(df.schema).parquet(source)
    where = {n: str(tmp_path / n) for n in ("texts", "mappings", "restored", "unresolved", "c1", "c2")}
    streams.redact_stream(stream(), "text", ["id"], where["texts"], where["mappings"], where["c1"], options=SALTED).awaitTermination()
    df.where("id = 3").write.mode("append").parquet(source)
    streams.redact_stream(stream(), "text", ["id"], where["texts"], where["mappings"], where["c1"], options=SALTED).awaitTermination()
    written = spark.read.parquet(where["texts"])
    assert "text" not in written.columns and "entities" not in written.columns
    batch = redact_column(df, "text", ["id"], options=SALTED)
    assert {(r["id"], r["redacted"]) for r in written.collect()} == {(r["id"], r["redacted"]) for r in batch.collect()}

    mappings = lambda: spark.read.parquet(where["mappings"]).where("entity_type <> 'IP_ADDRESS'")
    responses = spark.readStream.schema(written.schema).parquet(where["texts"])
    streams.restore_stream(
        responses, "redacted", ["id"], mappings, where["restored"], where["unresolved"], where["c2"]
    ).awaitTermination()
    out = {r["id"]: r["restored"] for r in spark.read.parquet(where["restored"]).collect()}
    assert out[1] == "mail a@b.co" and out[2] == "plain text" and "<IP_ADDRESS_" in out[3]
    assert [r["id"] for r in spark.read.parquet(where["unresolved"]).collect()] == [3]


def test_ttl_join_gives_late_responses_no_original(spark, tmp_path):
    mapping_in, response_in = str(tmp_path / "m"), str(tmp_path / "r")
    mappings = spark.sql(
        "SELECT * FROM VALUES ('m1', TIMESTAMP '2024-01-01 10:00:00', 'Ann'), ('m2', TIMESTAMP '2024-01-01 08:00:00', 'Bob') AS t(mapping_id, created_at, original)"
    )
    responses = spark.sql(
        "SELECT * FROM VALUES ('m1', TIMESTAMP '2024-01-01 10:30:00'), ('m2', TIMESTAMP '2024-01-01 10:30:00') AS t(mapping_id, asked_at)"
    )
    late_m = spark.sql("SELECT 'm9' AS mapping_id, TIMESTAMP '2024-01-01 20:00:00' AS created_at, 'Zoe' AS original")
    late_r = spark.sql("SELECT 'm9' AS mapping_id, TIMESTAMP '2024-01-01 20:00:00' AS asked_at")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        left = spark.readStream.schema(mappings.schema).parquet(mapping_in)
        right = spark.readStream.schema(responses.schema).parquet(response_in)
        joined = streams.ttl_join(left, right, "mapping_id", "created_at", "asked_at", 3600, how="left_outer")
        streams.append_to(joined, out, checkpoint).awaitTermination()

    mappings.write.parquet(mapping_in)
    responses.write.parquet(response_in)
    run()
    for _ in range(2):
        late_m.write.mode("append").parquet(mapping_in)
        late_r.write.mode("append").parquet(response_in)
        run()
    rows = {(r["mapping_id"], r["original"]) for r in spark.read.parquet(out).collect()}
    assert ("m1", "Ann") in rows and ("m2", None) in rows and ("m2", "Bob") not in rows


def test_counts_are_the_same_as_batch(spark):
    events = spark.sql(
        "SELECT timestamp_seconds(1704067200 + id * 240) AS ts, concat('t', id % 2) AS kind, id % 3 AS user FROM range(100)"
    )
    hourly = streams.window_counts(events, "ts", "kind", "1 hour")
    assert hourly.agg(F.sum("n")).first()[0] == 100 and hourly.count() == 14
    sliding = streams.window_counts(events, "ts", "kind", "1 hour", "30 minutes")
    assert sliding.agg(F.sum("n")).first()[0] == 200
    assert streams.session_counts(events, "ts", "user", "10 minutes").count() == 100
    assert streams.session_counts(events, "ts", "user", "20 minutes").count() == 3


def test_payload_requests_and_responses(spark, tmp_path):
    import json

    where = {n: str(tmp_path / n) for n in ("in", "out", "maps", "refused", "back", "c1", "c2")}
    rows = [
        (1, json.dumps({"messages": [{"role": "system", "content": "x@y.org"}, {"role": "user", "content": "mail a@b.co"}]})),
        (2, '{"messages": [broken a@b.co'),
    ]
    df = spark.createDataFrame(rows, "id long, body string")
    df.write.parquet(where["in"])
    schema = "STRUCT<messages: ARRAY<STRUCT<role: STRING, content: STRING>>>"
    streams.redact_payload_stream(
        spark.readStream.schema(df.schema).parquet(where["in"]), ["id"], "body", schema,
        where["out"], where["maps"], where["refused"], where["c1"], options=SALTED,
    ).awaitTermination()
    written = spark.read.parquet(where["out"])
    row = written.first()
    assert written.count() == 1 and row["messages"][0]["content"] == "x@y.org"
    assert row["messages"][1]["content"].startswith("mail <EMAIL_ADDRESS_")
    assert [(r["id"], r["reason"]) for r in spark.read.parquet(where["refused"]).collect()] == [(2, "invalid_json")]
    streams.restore_payload_stream(
        spark.readStream.schema(written.drop("batch_id", "mapping_id").schema).parquet(where["out"]), ["id"],
        lambda: spark.read.parquet(where["maps"]), where["back"], where["c2"],
    ).awaitTermination()
    assert spark.read.parquet(where["back"]).first()["messages"][1]["content"] == "mail a@b.co"


def test_streamed_counts_hold_open_windows_and_late_rows(spark, tmp_path):
    def rows(ids):
        return spark.sql(f"SELECT timestamp_seconds(1704067200 + id * 240) AS ts, concat('t', id % 2) AS kind FROM range({ids})")

    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    for ids in ("50, 100", "0, 50"):  # the second batch is later than the delay
        rows(ids).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows(ids).schema).parquet(source)
        first = streams.count_windows(stream, "ts", "kind", "1 hour", out, checkpoint)
        first.awaitTermination()
    want = streams.window_counts(rows("0, 100"), "ts", "kind", "1 hour").collect()
    assert sorted(streams.counted_windows(spark, out).collect()) == sorted(want) and len(want) == 14
    # another run into the same folder gives its own counts, and those of the first one stay
    other = str(tmp_path / "other")
    rows("0, 30").write.parquet(other)
    stream = spark.readStream.schema(rows("0, 1").schema).parquet(other)
    second = streams.count_windows(stream, "ts", "kind", "1 hour", out, str(tmp_path / "c2"))
    second.awaitTermination()
    few = streams.window_counts(rows("0, 30"), "ts", "kind", "1 hour").collect()
    assert sorted(streams.counted_windows(spark, out).collect()) == sorted(few)
    assert sorted(streams.counted_windows(spark, out, str(first.id)).collect()) == sorted(want)


def test_bounded_store_in_state_follows_the_event_order(spark, tmp_path):
    from cloakframe.streaming.store import bounded_contents, keep_bounded

    feed, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    schema = "tenant string, id string, ts timestamp"

    def batch(*rows):
        values = ", ".join(f"('{t}', '{i}', timestamp_seconds(1704067200 + {s}))" for t, i, s in rows)
        spark.sql(f"SELECT * FROM VALUES {values} AS v(tenant, id, ts)").coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).parquet(feed)
        keep_bounded(stream, "tenant", "id", "ts", 3, 100, out, checkpoint).awaitTermination()
        return {(r["tenant"], r["mapping_id"]) for r in bounded_contents(spark, out).collect()}

    a = lambda *ids: {("a", str(i)) for i in ids}
    assert batch(("a", 1, 1), ("a", 2, 2), ("a", 3, 3)) == a(1, 2, 3)
    assert batch(("a", 1, 4), ("a", 4, 5)) == a(1, 3, 4)  # 2 was used least recently
    assert batch(("a", 10, 6), ("a", 9, 6), ("b", 1, 60)) == a(4, 9, 10) | {("b", "1")}
    assert batch(("b", 2, 90)) == a(4, 9, 10) | {("b", "1"), ("b", "2")}
    batch(("b", 3, 110))
    assert batch(("b", 3, 120)) == {("b", "1"), ("b", "2"), ("b", "3")}  # all of a have expired


def test_unresolved_responses_leave_the_state(spark, tmp_path):
    feeds = {n: str(tmp_path / n) for n in ("m", "r", "out", "c")}
    rows = lambda name, *v: spark.sql(f"SELECT * FROM VALUES {', '.join(f'({i!r}, timestamp_seconds({s}))' for i, s in v)} AS t(id, {name})")

    def run(created, asked):
        rows("created_at", *created).write.mode("append").parquet(feeds["m"])
        rows("asked_at", *asked).write.mode("append").parquet(feeds["r"])
        m = spark.readStream.schema("id string, created_at timestamp").parquet(feeds["m"])
        r = spark.readStream.schema("id string, asked_at timestamp").parquet(feeds["r"])
        lost = streams.unresolved_responses(m, r, "id", "created_at", "asked_at", 60, "1 second")
        streams.append_to(lost, feeds["out"], feeds["c"]).awaitTermination()

    run([("x", 1000), ("y", 1000)], [("x", 1030), ("y", 1100), ("z", 1001)])
    for at in (9000, 9500):
        run([("end", at)], [("end", at)])
    assert sorted(r["id"] for r in spark.read.parquet(feeds["out"]).collect()) == ["y", "z"]


def test_window_counts_query_counts_every_event(spark):
    from cloakframe.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = QUERIES["stream_window_counts"](spark, folder).agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{folder}/events.parquet").count()


def test_a_stream_over_a_table_reads_a_file_and_a_folder_of_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for kind in ("many", "one"):
        rows.limit(1).write.parquet(str(tmp_path / kind / "others.parquet"))
        stream = streams.table_stream(spark, str(tmp_path / kind), "documents")
        streams.append_to(stream, str(tmp_path / f"{kind}-out"), str(tmp_path / f"{kind}-checkpoint")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"{kind}-out")).count() == 6


def test_registered_restore_stream_over_a_folder_of_files(spark, tmp_path):
    from cloakframe.queries import QUERIES

    rows = spark.createDataFrame([(1, "mail a@b.co"), (2, "plain"), (3, None)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["restored"] for r in QUERIES["stream_restore"](spark, str(tmp_path)).collect()}
    assert got == {1: "mail a@b.co", 2: "plain", 3: None}
