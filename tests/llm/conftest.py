import random

import pytest

#: Columns whose names an operator might use itself.
EXTRA = "size long, shard int, score double, ids string, vertex string, __x string"


def corpus(n: int = 60, seed: int = 3) -> list[tuple]:
    """(doc_id, text, source) with null, empty, long, repeated and near equal texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéüñ中") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)).capitalize() + "."
    rows = [(i, say(rng.randint(20, 90)), f"s{i % 5}") for i in range(n)]
    rows += [(100, None, "s0"), (101, "", "s1"), (102, " \t\n ", None), (103, "x", ""), (104, rows[3][1], "s2"), (105, rows[3][1], "s3")]
    near = rows[7][1].split()
    near[4:4] = ["inserted"]
    rows += [(106, " ".join(near), "s4"), (107, say(40_000), "s0"), (108, "a" * 50_000, "s1"), (109, "two  spaces\n\n and\ttabs  <|endoftext|>  end ", "s1"), (110, "it's 12 o'clock!!'s <|endoftext|>", "s2")]
    rows += [(111, rows[9][1], None), (111, rows[9][1], None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for x in EXTRA.split(", "):
        name, kind = x.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"doc_id long, text string, source string, {EXTRA}")
