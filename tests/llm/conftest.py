import random

import pytest

from sleuthwork.llm._common import reachable


@pytest.fixture(scope="session", autouse=True)
def _importable(spark):
    reachable(spark)


@pytest.fixture(scope="session")
def hard(spark):
    """Rows with everything that a table may hold: nulls in all columns, empty, blank and long texts, ties,
    repeated rows, rows that share a doc_id, extra columns with awkward names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    base = " ".join(word() for _ in range(200))
    long = " ".join(word() for _ in range(20_000))
    rows = [
        (1, base, "en", "s1"), (2, base, "en", "s1"), (3, base.replace(" ", "  ", 5), "en", "s1"), (4, base + " one two three", "en", "s2"), (5, None, "en", "s1"), (6, "", "fr", None),
        (7, " \n\t ", None, "s2"), (8, "one", "fr", "s1"), (8, "one", "fr", "s1"), (9, "é ß 日本 \U0001f600 end.", "de", "s3"), (9, long, "de", "s3"), (None, "no id here", "en", None),
        (None, None, None, None), (11, "12 34 !!", "en", "s1"), (12, "a" * 5000, "en", "s1"), (13, "x | y | z.\n\n\nNext para. <|endoftext|> done", "en", "s1"), (-5, base.upper(), "en", "s2"),
    ]
    df = spark.createDataFrame([(d, t, g, s, None if t is None else len(t), 7, "v") for d, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int, size string")
    return df


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
