from __future__ import annotations

import pytest
from pyspark.sql import functions as F

WORDS = "the of and ering thand erble tion with from house stone river paper green light seven walk bring carry under".split()


def prose(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, blanks, ties, repeated rows, a long text and columns with names the operators use themselves."""
    long = prose(6000, 1)
    rows = [
        (1, "alpha beta gamma delta", "en", "a"),
        (2, "", "en", "a"),
        (3, None, "en", "b"),
        (4, " \t\n ", None, None),
        (5, long, "fr", "b"),
        (6, long, "fr", "b"),
        (6, long, "fr", "b"),
        (7, long.replace("river", "lake", 1), "de", None),
        (None, prose(50, 2), "en", "c"),
        (None, prose(50, 2), "en", "c"),
        (9, "ÀÉÎ straße İstanbul 漢字 test\nline two\nline two", "es", "c"),
        *[(20 + k, prose(80 + k, 30 + k), "en", "abc"[k % 3]) for k in range(12)],
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = {"size": F.lit(-1), "key": F.lit("x"), "n_words": F.lit("y"), "__row": F.lit(2), "fp": F.lit(0), "score": F.lit(1), "end": F.lit(3), "items": F.lit(4)}
    return made.withColumns(odd)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
