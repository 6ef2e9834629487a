"""Long conversations are several payloads, and the queries give a row for each."""

import duckdb
import pytest

from cloakframe.queries import ORACLE, QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    turns = [(c, t, "user", None if t == 65 else f"text {t}") for c, n in ((1, 150), (2, 3)) for t in range(n)]
    df = spark.createDataFrame([*turns, (3, 70, "user", None)], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def rows(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES[name](spark, folder).collect()))
    assert got == sorted(con.execute(ORACLE[name]).fetchall())
    return got


def test_parsed_payloads_are_counted_one_by_one(spark, folder):
    got = rows(spark, folder, "src_payload_json")
    assert [r[:3] for r in got] == [(1, 0, 64), (1, 1, 64), (1, 2, 22), (2, 0, 3), (3, 1, 1)] and got[-1][3] is None


def test_metadata_of_each_payload_is_kept_and_emptied(spark, folder):
    got = rows(spark, folder, "strip_metadata")
    assert got[:3] == [(1, 0, '{"turns":64}', "{}"), (1, 1, '{"turns":64}', "{}"), (1, 2, '{"turns":22}', "{}")]
