import random

import pytest
from pyspark.sql import types as T

#: A documents table with columns of its own whose names clash with results.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("copies", T.DoubleType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("ids", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


def as_rows(texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, "en", source(i), None if t is None else len(t), *["x", "x", 0.5, "x", "x", "x", "x", "x", "x"]) for i, t in enumerate(texts)]


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "é", "ti", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    out = [None, "", "   \n\t ", "one", "one two", base, base, near, base.upper(), base + "\n" + base, "a\x00b ퟿ é́   x"]
    out += [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    out += [prose(rng, 6000), "the " * 400, "#### $$ || " * 30, base, base]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, ties, copies, a long text, null keys, a row that occurs three times."""
    rows = as_rows(odd_texts())
    rows += [rows[5], rows[5]]
    rows.append((None, "no id here at all", None, None, None, *rows[0][5:]))
    rows.append((3, "same id as another", "en", None, 5, *rows[0][5:]))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
