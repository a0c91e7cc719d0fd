import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("label", T.IntegerType()), T.StructField("set", T.StringType())])  # the last two clash with inner names


def base_text(n, seed=1):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "été", "naïve", "über"]) + str(r.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and blank texts, a very long one, copies, near copies, repeated rows, a null id."""
    long_text = base_text(9000, 2)
    a = base_text(200, 3)
    near = a.replace("alpha", "Alpha", 1) + " tail words here"
    half = " ".join(a.split()[:60]) + " " + base_text(120, 4)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, long_text), (4, a), (5, a), (6, near), (7, half), (7, half), (8, "one"), (9, "one"),
            (10, "漢字 😀 word"), (None, a), (11, "x" * 900), (12, "ab" * 500), (13, "12345 !!! ***"), (14, base_text(80, 9))]
    return spark.createDataFrame([(i, t, "xx", 1, "s") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
