"""Tokens that tell all values of a scope apart."""

from dataclasses import dataclass

import pytest

from cloakframe.operators.restore import restore_column
from cloakframe.operators.sweep import redacted as swept
from cloakframe.operators.tokens import token_collisions
from cloakframe.operators.unique import settle_tokens, unique_tokens
from cloakframe.options import Options
from cloakframe.plans.columns import mapping_rows, redact_column


@dataclass(frozen=True)
class Narrow(Options):
    """One digit more each time, so that many rounds are needed."""

    def digits(self, again: int) -> int:
        return self.token_hex + again // 8


def mails(spark, n, per_row=1):
    """Rows of one document, each with `per_row` addresses, every third one repeated in the next row."""
    rows = []
    for i in range(n):
        own = [f"a{i}n{j}@site{i % 7}.org" for j in range(per_row)]
        again = [f"a{i - 1}n0@site{(i - 1) % 7}.org"] if i and i % 3 == 0 else []
        rows.append((1, i, "mail " + " or ".join(own + again) + " now"))
    return spark.createDataFrame(rows + [(1, -1, None), (1, -2, ""), (2, -3, "plain")], "doc long, row long, text string")


def as_rows(df, *columns):
    return sorted(((tuple(r) for r in df.select(*columns).collect())), key=str)


@pytest.mark.parametrize("per_row", [1, 70])
def test_short_tokens_of_a_document_restore(spark, per_row):
    options = Options(salt="test", token_hex=2)
    df = mails(spark, 90 if per_row == 1 else 6, per_row)
    done = redact_column(df, "text", ["doc"], options=options)
    before = mapping_rows(done, "text", options=options)
    if per_row == 1:
        assert token_collisions(before).count() > 0
    else:  # texts of many values were minted again on their own, with more digits
        assert before.where("length(placeholder) > 30").count() > 0
    settled = unique_tokens(done, options)
    assert settled.columns == done.columns and settled.schema["entities"].dataType == done.schema["entities"].dataType
    known = mapping_rows(settled, "text", options=options)
    assert token_collisions(known).count() == 0
    values = known.select("mapping_id", "original", "placeholder").distinct()
    assert values.count() == values.select("mapping_id", "original").distinct().count()
    back = restore_column(settled, "redacted", known, ["row"], options=options)
    assert as_rows(back, "row", "restored") == as_rows(df, "row", "text")
    again = unique_tokens(redact_column(df.repartition(5), "text", ["doc"], options=options), options)
    assert as_rows(again, "row", "redacted") == as_rows(settled, "row", "redacted")


def test_equals_rounds_in_plain_python(spark):
    import hashlib

    options = Narrow(salt="test", token_hex=1 + 1)
    values = [("s", "PERSON", f"v{i}") for i in range(240)] + [("t", "PERSON", f"v{i}") for i in range(30)]
    df = spark.createDataFrame(values * 2, "_scope string, entity_type string, original string")
    got = {(r["_scope"], r["original"]): r["placeholder"] for r in settle_tokens(df, options).collect()}
    want, waiting, again = {}, sorted(values), 0
    while waiting:
        taken = {(s, t) for (s, _), t in want.items()}
        for s, kind, v in list(waiting):
            tail = f"|{again}" if again else ""
            digest = hashlib.sha256(f"test|{s}|{kind}|{v}{tail}".encode()).hexdigest()
            token = f"<{kind}_{digest[: options.digits(again)]}>"
            if (s, token) not in taken:
                taken.add((s, token))
                want[s, v] = token
                waiting.remove((s, kind, v))
        again += 1
    assert again > 3 and got == want and len(set(want.items())) == 270


def test_known_values_keep_their_tokens(spark):
    options = Options(salt="test", scope="global", token_hex=2)
    first = unique_tokens(redact_column(mails(spark, 40), "text", ["doc"], options=options), options)
    store = mapping_rows(first, "text", options=options)
    held = {r["original"]: r["placeholder"] for r in store.collect()}
    second = unique_tokens(redact_column(mails(spark, 60), "text", ["doc"], options=options), options, known=store)
    now = {r["original"]: r["placeholder"] for r in mapping_rows(second, "text", options=options).collect()}
    assert {v: now[v] for v in held} == held and len(set(now.values())) == len(now) == 60


def test_no_entities_leaf_scope_and_too_many_values(spark):
    options = Options(salt="test", token_hex=2)
    none = redact_column(mails(spark, 5).where("row < 0"), "text", ["doc"], options=options)
    assert as_rows(unique_tokens(none, options), "row", "redacted") == as_rows(none, "row", "redacted")
    empty = none.where("false")
    assert unique_tokens(empty, options).count() == 0
    leaf = Options(salt="test", scope="leaf")
    done = redact_column(mails(spark, 3), "text", ["doc"], options=leaf)
    assert unique_tokens(done, leaf) is done
    for digits in (1, 33):
        with pytest.raises(ValueError):
            Options(salt="test", token_hex=digits)


def test_a_text_of_very_many_values_has_no_shared_token():
    values = [{"priority": 0, "type_ord": 0, "value_ord": i, "neg_score": -1.0, "entity_type": "PERSON", "value": f"v{i:04d}", "source": "exact"} for i in range(200)]
    text = " ".join(v["value"] for v in values)
    new, entities = swept(text, "m", values, "test", 2)
    assert len({e["placeholder"] for e in entities}) == 200
    for e in entities:
        new = new.replace(e["placeholder"], e["original"])
    assert new == text
