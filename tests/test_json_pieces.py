"""JSON texts of an Arrow batch are worked on in pieces; the rows are the same."""

import json

import pandas as pd
from pyspark.sql import functions as F

from cloakframe.operators import nested


def test_a_batch_leaves_in_pieces():
    texts = pd.Series(["x" * (nested.PIECE // 2)] * 5 + [None, ""], dtype=object)
    pieces = list(nested.in_pieces((texts,), lambda t: None if t is None else len(t)))
    assert [len(p) for p in pieces] == [2, 2, 3] and pd.concat(pieces).tolist() == [nested.PIECE // 2] * 5 + [None, 0]
    assert [len(p) for p in nested.in_pieces((texts[:0],), len)] == [0]


def test_large_bodies_keep_their_rows(spark):
    bodies = [json.dumps({"n": i, "t": f"{i}" * (nested.PIECE // 3)}) for i in range(7)]
    df = spark.createDataFrame([*enumerate(bodies), (7, None)], "id long, body string").coalesce(1)
    leaves = nested.json_leaf_rows(df, ["id"], "body").select("id", "path", F.length("text"), F.substring("text", 1, 1))
    assert sorted(map(tuple, leaves.collect())) == [(i, "t", nested.PIECE // 3, str(i)) for i in range(7)]
    stamped = df.withColumn("s", nested.stamp_json("body", F.concat(F.lit("h"), "id")))
    handle = F.get_json_object("s", "$.metadata.privacy_mapping_id")
    assert [r[0] for r in stamped.orderBy("id").select(handle).collect()] == [f"h{i}" for i in range(7)] + [None]
    back = stamped.select("id", nested.strip_json("s").alias("b")).orderBy("id").collect()
    assert all(json.loads(r["b"])["n"] == r["id"] for r in back[:7]) and back[7]["b"] is None
