"""What redaction by tables of profiles holds at once in its workers."""

from __future__ import annotations

import pyarrow as pa

from cloakframe.operators.automaton import hits_by_part
from cloakframe.operators.dictionary import with_group_hits
from cloakframe.options import Options
from cloakframe.plans.columns import redact_column
from cloakframe.schemas import PROFILE_ENTITY, PROFILE_FUZZY, PROFILE_SKIP, PROFILE_THRESHOLD
from cloakframe.sources import tables
from cloakframe.sources.profile_tables import ProfileTables

HIT = pa.struct([("entity_type", pa.string()), ("type_ord", pa.int32()), ("value", pa.string()), ("value_ord", pa.int32())])


def test_batches_are_worked_on_in_pieces():
    own = lambda *values: [{"entity_type": "A", "type_ord": 0, "value": v, "value_ord": n} for n, v in enumerate(values)]
    values = [own("ab", "c"), *[None] * 600, own("c"), *[None] * 400]
    texts = [None, *["ab c"] * 599, None, None, *["ab c"] * 400]
    parts = ["p"] * 601 + ["q"] * 401
    batch = pa.RecordBatch.from_arrays(
        [pa.array(texts), pa.array(parts), pa.array([0] * 1002), pa.array(values, pa.list_(HIT))], ["text", "_part", "_salt", "_values"]
    )
    done = list(hits_by_part(["text"], "text", HIT)(iter([batch])))
    assert max(len(b) for b in done) <= 256
    found = [[h["value"] for h in hits] for b in done for hits in b.column("_hits").to_pylist()]
    assert found == [["ab", "c"]] * 599 + [[]] + [["c"]] * 400


def test_settings_do_not_go_to_the_workers_and_no_values_are_looked_for_without_fuzzy_ones(spark):
    names = [("p", "PERSON", 0, f"name{i}", i) for i in range(5)]
    known = ProfileTables(
        spark.createDataFrame([("p", "IP_ADDRESS", 0.1)], PROFILE_THRESHOLD), spark.createDataFrame(names, PROFILE_ENTITY),
        spark.createDataFrame([], PROFILE_FUZZY), spark.createDataFrame([], PROFILE_SKIP),
    )
    df = spark.createDataFrame([(1, "p", "name1 and name4 at 10.0.0.1"), (2, "q", "name1 here"), (3, None, None)], "id long, profile string, text string")
    done = redact_column(df, "text", ["id"], known, profile_column="profile", options=Options(salt="s", fold_limit=2))
    assert {r["id"]: [e["original"] for e in r["entities"]] for r in done.collect()} == {1: ["10.0.0.1", "name1", "name4"], 2: [], 3: []}
    plan = done._jdf.queryExecution().optimizedPlan().toString().splitlines()
    workers = [line for line in plan if "MapInArrow" in line or "ArrowEvalPython" in line]
    assert len(workers) == 2 and not any("_settings" in line for line in workers)  # one for the hits, one for the sweep


def test_rows_meet_many_values_in_small_shares(spark):
    known = spark.range(50).selectExpr("'g' AS g", "'A' AS entity_type", "0 AS type_ord", "concat('value', id) AS value", "0 AS value_ord")
    docs = spark.range(100).selectExpr("id", "'g' AS g", "concat('value', id % 50, ' ') AS text")
    met = with_group_hits(docs, "text", known, "g", text_bytes=10)
    assert met.count() == 100 and met.where("size(_hits) = 0").isEmpty()
    assert met.columns == [*docs.columns, "_hits"]


def test_small_batches_hold_while_a_result_is_written(spark):
    from pyspark.sql import functions as F

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    df = spark.range(60, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"]) for b in batches), "n long")
    assert max(r["n"] for r in tables.stage(sizes, "sizes", small=True).collect()) <= 6
    assert spark.conf.get(name, None) == before
