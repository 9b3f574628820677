import os
import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and further columns whose names the
    operators use themselves."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "b", None), (3, base + " x", "de", None, 3), (4, None, "en", "a", 0), (5, "", None, "b", 0),
        (6, " \t\n ", "en", "c", 3), (7, prose(30_000), "en", "a", 9), (8, "ok ok ok ok", "en", "c", 1), (8, "ok ok ok ok", "en", "c", 1),
        (9, "1234 5678 !!", "de", "c", 1), (None, "no id here", "en", "a", 1), (None, base, "en", "a", 1), (10, "A  B\tC", "en", "d", 1), (11, "A B C", "en", "d", 1),
        (12, "Straße ÉCOLE ſecret Kelvin İstanbul 😀", "de", "d", 1), (13, prose(60), None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("hash", "key", "norm", "size", "fp", "part", "id", "row", "range", "spans", "score", "word"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    return path
