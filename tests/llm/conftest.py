"""Small documents with everything that may go wrong, and an empty table of the same columns."""

import pytest
from pyspark.sql import types as T

# Columns that documents need not have; their names are used inside the operators.
EXTRA = (
    "row k1 k2 fp fp2 line size ids doc component times s n keep word words value shared places "
    "copy clean label u v limit score lang_ decoded tie shard block payload code cost unit p"
).split()

LONG = " ".join(f"token{i % 977} alpha beta" for i in range(150_000))  # over two pieces of text

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog and runs away from the old farm.", "en", "a"),
    (1, "the QUICK brown fox jumps over the lazy dog and runs away from the old farm.", "en", "b"),
    (2, "", "en", "a"),
    (3, None, "fr", "a"),
    (4, " \t\n\r\x0b\x0c ", "en", None),
    (5, "one", None, "b"),
    (6, "one two", "de", "b"),
    (7, "one two", "de", "b"),
    (7, "one two", "de", "b"),  # a repeated row
    (8, LONG, "en", "c"),
    (None, "no identity at all here", "en", "c"),
    (None, None, None, None),
    (9, "Ünïcödé ﬀ 中文 😀 ▁ ́x\x00y\x01z\x02\x03 <|endoftext|> end", "xx", "d"),
    (9, "the same id with another text", "xx", "d"),
    (10, "a" * 70_000, "en", "d"),
    (11, "Licensed under CC BY-NC 4.0. All rights reserved.\n\nshared line\nown line", "en", "e"),
]


def _schema(extra: bool) -> T.StructType:
    fields = [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
    return T.StructType(fields + [T.StructField(c, T.StringType()) for c in EXTRA if extra])


def documents(spark, rows, extra=False):
    full = [(*r, None if r[1] is None else len(r[1]), *(["x"] * len(EXTRA) if extra else [])) for r in rows]
    return spark.createDataFrame(full, _schema(extra))


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ROWS, extra=True)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [], extra=True)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
