import os
import random
import sys

import pytest
from pyspark.sql import types as Ty

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, kept string, score string, times string, node string, length string, rest string"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with extra columns whose names clash with the operators' own."""
    def make(rows):
        full = [(r[0], r[1], "xx", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "f", None, "s", "t", "n", "l", "r") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)
    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls in any column, empty, blank, short, very long and repeated texts, repeated rows and ids."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta,", "eta.", "x", "1234", "word glued"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    some = [(i, " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 90)))) for i in range(40, 80)]
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "one two three"), (7, long), (8, long), (9, long + " tail"), (10, passage), (11, "lead " + passage),
            (12, passage + " " + passage), (13, "a\x0bb\x0cc d"), (13, "a\x0bb\x0cc d"), (14, None), (None, "no id here " + passage), (None, None), (15, "x" * 5000), (16, "same " * 60),
            (17, "Licensed under the Apache License, Version 2.0."), (18, "you idiot and moron"), (19, "hello   world  \n \n end  "), *some]


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, Ty.StructType([Ty.StructField("doc_id", Ty.LongType()), Ty.StructField("quality", Ty.IntegerType()), Ty.StructField("toxic", Ty.IntegerType()),
                                                          Ty.StructField("text", Ty.StringType())]))
    return make
