"""JSON redaction whose results are used together: leaves are redacted once, bodies are joined once."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cloakframe.options import Options
from cloakframe.plans.columns import mapping_rows
from cloakframe.plans.payloads import redact_json, restore_json

SALTED = Options(salt="s")
BODIES = ['{"a": "mail a@b.co \\"now\\"", "n": 1.50}', '{"a": ["plain", {"b": "c@d.org"}]}', '{"a": "plain\\\\"}', None, "[1]"]


def test_redaction_that_is_used_twice_is_written_once(spark):
    docs = spark.createDataFrame(list(enumerate(BODIES)), "id long, body string")
    once, lazy = (redact_json(docs, ["id"], "body", options=SALTED, stamp=True, once=mark) for mark in (True, False))
    for left, right in zip(once, lazy, strict=True):
        assert sorted(map(repr, left.collect())) == sorted(map(repr, right.collect()))
    plan = once[1]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan  # leaves are read, not redacted again
    known = mapping_rows(once[1], F.col("path"), options=SALTED)
    back = {r["id"]: r["restored"] for r in restore_json(once[0].select("id", "redacted"), ["id"], "redacted", known, SALTED).collect()}
    for i in range(3):
        whole = json.loads(back[i])
        assert whole.pop("metadata") == {}
        assert whole == json.loads(BODIES[i])
    assert sorted(back) == [0, 1, 2]


def test_bodies_are_joined_once(spark):
    docs = spark.createDataFrame(list(enumerate(BODIES)), "id long, body string")
    out = redact_json(docs, ["id"], "body", options=SALTED, once=True)[0]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
