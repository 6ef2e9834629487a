import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, stem="w", vocabulary=400):
    return " ".join(f"{stem}{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use themselves."""
    rng = random.Random(4)
    base = [sentence(rng, 120) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [
        (100, None, None, None, None),
        (101, "", "en", "s1", 0),
        (102, " \t\n ", None, "s1", 4),
        (None, base[0], "en", "s2", 1),
        (103, base[1], "en", "s2", 1),  # an exact copy
        (104, base[2] + " one more", "en", "s0", 1),  # a near copy
        (105, base[3], "en", "s0", 1),
        (105, base[3], "en", "s0", 1),  # a repeated row
        (106, sentence(rng, 20_000), "en", "s1", 1),
        (107, "Ünïcödé wörds \U0001f600 漢字 a\x1cb", "en", "s9", 1),
        (108, "word", "en", None, 4),
    ]
    plain = spark.createDataFrame(rows, DOCS)
    clash = "size taken target id key range first line site k1 k2 packed partner component level fp edited raw score piece start length".split()
    for name in clash:
        plain = plain.selectExpr("*", f"'x' as {name}")
    return plain


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def sentences():
    return sentence
